"""Line dedup, fingerprints and decontamination against brute force, with odd cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import decontaminate, fingerprint, line_dedup, queries, sharding
from tests.compare import DATA, check, duck
from tests.llm import helpers as H

BLANKS = " \t\n\x0b\f\r"


def deduped(pairs, min_chars=20, min_docs=3):
    key = lambda x: x.strip(BLANKS).translate(H.LOWER)
    lines = [(i, (t or "").split("\n")) for i, t in pairs]
    held = {}
    for i, ls in lines:
        for x in ls:
            held.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    return sorted((i, len(ls), "\n".join(x for x in ls if gone.get(key(x), i) == i)) for i, ls in lines)


LONG = "This line is longer than twenty letters"
TEXTS = [(i, t) for i, t in enumerate([
    None, "", "short\nshort", f"{LONG}\nown one of the first text here", f"\t{LONG.upper()} \nx", f"{LONG}\n{LONG}\n", "É" + "é" * 25 + f"\n{LONG}", "a\n\n\nb",
    "é" * 26, "É" + "é" * 25, "é" * 26 + "\r", " " + LONG, "exactly twenty chars", "EXACTLY twenty chars", "exactly twenty chars ", "x" * 5000 + "\n" + LONG,
])]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(spark, batches):
    got = line_dedup.dedup_lines(H.table(spark, TEXTS, extra=True), batches=batches, fanout=2).collect()
    assert sorted((r.doc_id, r.lines, r.kept_text) for r in got) == deduped(TEXTS)


def test_line_dedup_repeated_rows_and_null_ids(spark):
    rows = [(None, LONG), (None, LONG), (1, LONG), (1, LONG), (2, LONG)]
    got = [(r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(H.table(spark, rows)).collect()]
    # Three documents hold the line: null, 1 and 2; the largest keeps it, all rows of the others lose it.
    assert sorted(got, key=str) == sorted([(None, ""), (None, ""), (1, ""), (1, ""), (2, LONG)], key=str)
    assert line_dedup.dedup_lines(H.empty(spark)).count() == 0


def test_line_dedup_carries_columns(spark):
    docs = H.table(spark, TEXTS, extra=True)
    got = line_dedup.dedup_lines(docs, carry=True)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((i, t) for i, _, t in deduped(TEXTS))


def test_runs_are_levelled(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=2)
    for top in (50, 40, 30, 20, 10):
        batch = spark.createDataFrame([(k, k, 1, top) for k in (1, 2, top)], line_dedup.RUN_SCHEMA)
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {r.k1: (r.n_docs, r.keeper) for r in runs.merged().collect()}
    assert got[1] == (5, 50) and got[10] == (1, 10)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item), (2, "Tiny Item"), (3, None), (4, ""), (5, item.upper()), (None, item)], "item_id long, text string")
    texts = {
        1: "x " * 400 + item + " y" * 400, 2: "one two three four five six seven eight nine ten", 3: "one two three four five six seven x eight nine ten eleven", 4: "tiny\titem",
        5: "a tiny item", 6: None, 7: "", 8: "z " * 3000,
    }
    want = {(d, i) for d, t in texts.items() for i, s in ((1, item), (2, "Tiny Item"), (5, item)) for a in [H.shingles(t, 5)] for b in [H.shingles(s, 5)] if len(a & b) >= 0.8 * len(b)}
    got = decontaminate.find_leaks(H.table(spark, texts, extra=True), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (1, 1) in want and (4, 2) in want and (3, 1) not in want
    assert decontaminate.find_leaks(H.empty(spark), items).count() == 0
    assert decontaminate.find_leaks(H.table(spark, texts), items.limit(0)).count() == 0


def test_leaks_by_shuffle_are_the_same(spark):
    docs, items = C.table(spark, DATA, "documents"), C.table(spark, DATA, "benchmark")
    sent = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == sent and sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_leaks_in_rows_that_share_an_id(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, item), (1, "something else"), (1, item), (2, " ".join(item.split()[:15])), (2, " ".join(item.split()[15:])), (None, item + " x" * 50_000)]
    got = decontaminate.find_leaks(H.table(spark, rows, extra=True), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shared) for r in got) == [("1", 26), ("None", 26)]


def test_fingerprint_edits(spark):
    texts = {r[0]: r[1] for r in duck().sql("SELECT doc_id, text FROM documents").fetchall()}
    texts |= {1000: None, 1001: "", 1002: "é" * 9, 1003: "a b c", 1004: texts[5], 1005: "x" * 3000}
    made = fingerprint.fingerprint_pairs(H.table(spark, texts, extra=True)).collect()
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for r in made:
        t, n = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        half = len(t) // 2
        assert r.n_chars == len(t) and r.edited == t[: len(t) - half] + n[:half]
    by = {r.doc_id: r for r in made}
    assert by[1004].sketch == by[5].sketch and by[1000].sketch == [] == by[1001].sketch and len(made) == len(texts)
    assert sum(len(r.sketch) for r in made) > 0


def test_fingerprint_query(spark):
    rows = fingerprint.op7_fingerprint(spark, DATA).collect()
    long = [r for r in rows if r.n_chars > 400]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long) and 0.2 < sum(r.near_edited for r in long) / len(long) < 0.6


def test_syncmers_are_context_free(spark):
    body = " ".join(f"w{i * i % 97}" for i in range(60))
    docs = H.table(spark, {1: body, 2: "before it there were words " + body + " and after"})
    got = {}
    for r in fingerprint.anchors(docs).collect():
        got.setdefault(r.doc_id, {})[r.place] = r.anchor
    assert all(got[2][p + 5] == a for p, a in got[1].items())
    assert fingerprint.anchors(H.table(spark, {1: None, 2: "  "})).count() == 0


def test_fingerprints_against_brute_force(spark):
    """Choice of syncmers, fingerprints and likeness restated over Spark's hashes of pairs."""
    texts = {r[0]: r[1] for r in duck().sql("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 60").fetchall()} | {900: None, 901: "a b c", 902: "é è ê ë " * 9, 903: "z" * 40}
    docs = H.table(spark, texts)
    words = {i: re.findall(fingerprint.TOKEN, t or "") for i, t in texts.items()}
    pairs = sorted({p for w in words.values() for p in zip(w, w[1:])})
    hashed = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h"))
    h = {(r.a, r.b): r.h for r in hashed.collect()}
    chosen = {}
    for i, w in words.items():
        x = [h[p] for p in zip(w, w[1:])]
        chosen[i] = [(k, x[k], x[k + 2]) for k in range(len(x) - 2) if min(x[k], x[k + 2]) <= x[k + 1]]
    edges = sorted({c[1:] for cs in chosen.values() for c in cs})
    anchor = {(r.a, r.b): r.h for r in spark.createDataFrame(edges, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    want = {i: [(k, anchor[a, b]) for k, a, b in cs] for i, cs in chosen.items()}
    got = {}
    for r in fingerprint.anchors(docs).collect():
        got.setdefault(r.doc_id, []).append((r.place, r.anchor))
    for i, w in words.items():
        if len(w) >= 4:
            assert sorted(got.get(i, [])) == want[i]
        else:
            assert len(got.get(i, [])) == (1 if w else 0)
    made = {r.doc_id: r for r in fingerprint.op7_fingerprint_of(docs).collect()}
    ids = sorted(texts)
    sketch = {i: sorted({a & 0xFFFFFFFF for _, a in got.get(i, [])})[:128] for i in ids}
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        assert made[i].fingerprint == "".join(f"{x:08x}" for x in sketch[i])
        union = sorted(set(sketch[i]) | set(sketch[after]))[:128]
        both = set(sketch[i]) & set(sketch[after]) & set(union)
        assert made[i].near_next == pytest.approx(len(both) / len(union) if union else 1.0)


@pytest.mark.parametrize("range_rows", [1, 3, 50])
def test_next_rows_across_ranges(spark, range_rows):
    rows = [(None, "n"), (None, "m"), *[(5, f"t{k}") for k in range(40)], *[(10 + k, f"u{k}") for k in range(60)]]
    docs = H.table(spark, rows).select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    order = [(r.doc_id, r.text) for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), "tie").collect()]
    got = {(r.doc_id, r.text): r.next for r in fingerprint.with_next(docs.select("doc_id", "text"), F.col("text"), range_rows).collect()}
    assert got == {a: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_fingerprint_of_few_rows(spark):
    assert fingerprint.fingerprint_pairs(H.empty(spark)).count() == 0
    one = fingerprint.fingerprint_pairs(H.table(spark, {7: "abcdef"})).first()
    assert one.edited == "abcabc"
    twins = fingerprint.fingerprint_pairs(H.table(spark, [(7, "ab cd"), (7, "ab cd"), (None, "zz yy")])).collect()
    assert len(twins) == 3


def test_sharding(spark):
    texts = {i: "x" * (i * 37 % 900) for i in range(700)} | {900: None, 901: "", 902: "é" * 5000}
    got = sharding.shard_documents(H.table(spark, texts, extra=True)).collect()
    assert len(got) == len(texts)
    loads, places = {}, {}
    for r in got:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= 1000
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(H.empty(spark)).count() == 0
    assert hashlib.sha256(str(sorted((r.doc_id, r.shard, r.slot) for r in got)).encode()).digest() == hashlib.sha256(str(sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(H.table(spark, texts)).collect())).encode()).digest()


def test_sharding_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "a"), (None, "a"), (None, None), (3, "b"), (3, "b"), (3, "c")] + [(k, "same text") for k in range(2000)]
    got = sharding.shard_documents(H.table(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    loads = [sum(r.size for r in part) for part in by.values()]
    assert len(loads) == 8 and max(loads) - min(loads) <= 60  # copies of one text spread over all shards


def test_slot_maps_have_versions(spark, tmp_path):
    weights = {s: 100 + s % 7 for s in range(64)}
    held = sharding.SlotMap(spark, f"file://{tmp_path}/map", 64)
    first = {r.slot: r.shard for r in held.create(weights, 4).collect()}
    second = {r.slot: r.shard for r in held.edit(weights, 5).collect()}
    moved = [s for s in first if first[s] != second[s]]
    assert all(second[s] == 4 for s in moved) and 10 <= len(moved) <= 14
    loads = [sum(weights[s] for s in second if second[s] == k) for k in range(5)]
    assert max(loads) - min(loads) <= 250
    third = {r.slot: r.shard for r in held.edit(weights, 3).collect()}
    assert set(third.values()) == {0, 1, 2}
    assert {r.slot: r.shard for r in held.read(1).collect()} == first and held.version == 3


def test_repeated_tables_do_not_clash(spark):
    docs = H.table(spark, TEXTS, extra=True).withColumn("keeper", F.lit("x")).withColumn("drop", F.lit("y"))
    assert line_dedup.dedup_lines(docs).count() == len(TEXTS)
