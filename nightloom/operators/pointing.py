"""Directions averaged as they come: an exponential average of direction vectors, taken at most once an interval.

A sample counts if it comes an interval or more after the last that did; the average moves towards each that counts by `alpha`.
Both are sequential, so a session is cut into blocks of time that tasks fold apart. What a block does to an average depends only
on which of its samples is the first to count, and those are the ones of its first interval: for each, a block gives the time of
its last sample that counts and the affine map it applies. Composing these, one row a block, gives what every block begins with;
then blocks are run, apart again. No task and no window holds a session's samples. A task takes many blocks at once, as arrays: step
by step, every block goes on to its next sample that counts.

Vectors, not angles, are averaged, so a direction near north does not wrap. samples: session, ts (milliseconds), idx, x, y, z; one of no
length, or with a null, counts for nothing. Results, one row a sample that counts: session, idx, x, y, z (the average, of unit length).
Finer times are taken as they are if `ticks` says how many of them a millisecond has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far the average moves, and the least time between samples that count.
ALPHA, INTERVAL_MS = 0.20, 100
BLOCK_MS = 60_000
#: Rows that a task takes at a time, in whole groups.
CHUNK_ROWS = 65_536
_VECTORS = ["bx", "by", "bz", "fx", "fy", "fz"]
_SUMMARY = f"session long, block long, start long, last long, a double, {', '.join(c + ' double' for c in _VECTORS)}"
_ROW = "session long, block long, sample boolean, ts long, idx long, x double, y double, z double"
_NONE = -(2**63)  # stands for a null session


def _groups(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Sorted rows in chunks of whole groups, with every row's group and every group's first row."""
    def begins(rows: pd.DataFrame) -> np.ndarray:
        keys = rows[by].to_numpy()
        return np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])

    def chunk(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        new = begins(rows)
        return rows.reset_index(drop=True), np.cumsum(new) - 1, np.flatnonzero(new)

    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= CHUNK_ROWS:
            rows = pd.concat(held)
            last = int(np.flatnonzero(begins(rows))[-1])  # this group may go on
            held, n = [rows[last:]], 0
            if last:
                yield chunk(rows[:last])
    if held and sum(map(len, held)):
        yield chunk(pd.concat(held))


class _Times:
    """Times of sorted rows by group, to look up in all groups at once."""

    def __init__(self, ts: np.ndarray, group: np.ndarray, first: np.ndarray) -> None:
        self.begin = ts[first]
        self.distinct = np.unique(ts - self.begin[group])
        self.keys = self._key(group, ts)

    def _key(self, group: np.ndarray, ts: np.ndarray) -> np.ndarray:
        # Ranks, not times, so that many groups of long spans do not overflow.
        return group * (len(self.distinct) + 1) + np.searchsorted(self.distinct, ts - self.begin[group], "left")

    def at_least(self, group: np.ndarray, ts: np.ndarray) -> np.ndarray:
        """The first row of each group that is not before a time; the next group's first row if there is none."""
        return np.searchsorted(self.keys, self._key(group, ts), "left")


def _chains(following: np.ndarray, group: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Step by step: which chains go on, and the samples that count of each, if the starts are the first of them."""
    going, at, own = np.arange(len(starts)), starts, group[starts]
    while len(going):
        yield going, at
        at = following[at]
        on = at < len(group)
        on[on] = group[at[on]] == own[going[on]]
        going, at = going[on], at[on]


def average(samples: DataFrame, alpha: float = ALPHA, interval_ms: int = INTERVAL_MS, block_ms: int = BLOCK_MS, ticks: int = 1) -> DataFrame:
    interval, long = interval_ms * ticks, block_ms * ticks
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    session = F.coalesce(F.col("session").cast("long"), F.lit(_NONE)).alias("session")
    s = samples.withColumn("length", length).where("length > 0").select(session, F.col("ts").cast("long").alias("ts"), F.col("idx").cast("long").alias("idx"), *[(F.col(c) / F.col("length")).alias(c) for c in "xyz"])
    s = s.where("ts IS NOT NULL").withColumn("block", F.expr(f"(ts - pmod(ts, {long}L)) div {long}L"))
    by = ["session", "block"]

    def summary(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group, first in _groups(parts, by):
            ts, v, block = rows.ts.to_numpy(), rows[["x", "y", "z"]].to_numpy(), rows.block.to_numpy()
            times = _Times(ts, group, first)
            following = times.at_least(group, ts + interval)
            # The last sample that counted lies before the block, so the first one here lies within an interval of its begin.
            able = times.at_least(np.arange(len(first)), block[first] * long + interval)
            new = np.concatenate([[True], (ts[1:] != ts[:-1]) | (group[1:] != group[:-1])])
            starts = np.flatnonzero(new & (np.arange(len(ts)) <= able[group]))
            count, last, b, fresh = np.zeros(len(starts)), np.zeros(len(starts), np.int64), np.zeros((len(starts), 3)), v[starts]
            for going, at in _chains(following, group, starts):
                count[going] += 1
                last[going] = ts[at]
                b[going] += alpha * (v[at] - b[going])
                fresh[going] += alpha * (v[at] - fresh[going])  # nothing in the first step
            out = pd.DataFrame({"session": rows.session.to_numpy()[starts], "block": block[starts], "start": ts[starts], "last": last, "a": (1 - alpha) ** count})
            yield out.assign(**dict(zip(_VECTORS, np.hstack([b, fresh]).T, strict=True)))

    def compose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group, first in _groups(parts, ["session"]):
            session, block, start, last = (rows[c].to_numpy() for c in ("session", "block", "start", "last"))
            a, b, fresh = rows.a.to_numpy(), rows[_VECTORS[:3]].to_numpy(), rows[_VECTORS[3:]].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (group[1:] != group[:-1])]))
            ends = np.append(begins[1:], len(rows))
            times = _Times(start, group, first)
            rank = np.arange(len(begins)) - np.searchsorted(group[begins], group[begins], "left")  # of a block in its session
            done, state = np.zeros(len(first), np.int64), np.full((len(first), 3), np.nan)
            carry, before = np.zeros(len(begins), np.int64), np.full((len(begins), 3), np.nan)
            order = np.argsort(rank, kind="stable")
            for blocks in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1):  # every session's first block, then the second
                g = group[begins[blocks]]
                carry[blocks], before[blocks] = done[g], state[g]
                new = np.isnan(state[g, 0])
                at = np.where(new, begins[blocks], np.maximum(begins[blocks], times.at_least(g, done[g] + interval)))
                takes = at < ends[blocks]
                g, at, new = g[takes], at[takes], new[takes]
                state[g] = np.where(new[:, None], fresh[at], a[at, None] * state[g] + b[at])
                done[g] = last[at]
            out = pd.DataFrame({"session": session[begins], "block": block[begins], "sample": False, "ts": carry, "idx": 0})
            yield out.assign(**dict(zip("xyz", before.T, strict=True)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group, first in _groups(parts, by):
            # Each block's first row is what it begins with.
            begin, rest = rows.iloc[first], np.delete(np.arange(len(rows)), first)
            rows, group, first = rows.iloc[rest], group[rest], first - np.arange(len(first))
            ts, v = rows.ts.to_numpy(), rows[["x", "y", "z"]].to_numpy()
            times = _Times(ts, group, first)
            following = times.at_least(group, ts + interval)
            state, own = begin[["x", "y", "z"]].to_numpy(), np.arange(len(first))
            new = np.isnan(state[:, 0])
            starts = np.where(new, first, times.at_least(own, begin.ts.to_numpy() + interval))
            takes = starts < np.append(first[1:], len(rows))
            state, starts, new = state[takes], starts[takes], new[takes]
            state[new] = v[starts[new]]
            d, counts = np.empty_like(v), np.zeros(len(v), bool)
            for going, at in _chains(following, group, starts):
                state[going] += alpha * (v[at] - state[going])
                d[at], counts[at] = state[going], True
            d = d[counts]
            d = d / np.maximum(np.sqrt((d**2).sum(axis=1, keepdims=True)), 1e-300)
            yield pd.DataFrame({"session": rows.session.to_numpy()[counts], "idx": rows.idx.to_numpy()[counts], "x": d[:, 0], "y": d[:, 1], "z": d[:, 2]})

    def ordered(df: DataFrame, keys: list[str], *then: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, *then)

    carry = ordered(ordered(s, by, "ts", "idx").mapInPandas(summary, _SUMMARY), ["session"], "block", "start").mapInPandas(compose, _ROW)
    # A union, as a join on a block's keys would do without the repartition by them, and adaptive execution may then read its side in parts.
    both = carry.unionByName(s.withColumn("sample", F.lit(True)))
    got = ordered(both, by, "sample", "ts", "idx").mapInPandas(run, "session long, idx long, x double, y double, z double")
    return got.withColumn("session", F.nullif("session", F.lit(_NONE)))
