"""MinHash near-dedup with an LSH forest.

1. One pass over the texts gives each document's number of distinct shingles, a digest of the set, and a MinHash
   signature of `orders` x 4 values. Documents with equal sets are joined at once; one of each goes on.
2. The forest: the signature, turned by four values at a time, gives `orders` sorted orders. In each, all
   documents are sorted by the whole turned signature (a range sort, so a dense region spreads over many tasks) and
   each is paired with its next `near` neighbours. How long a prefix neighbours share follows from how dense the
   region is: that is the forest's adaptive depth. Pairs that share fewer than `least_depth` values, or whose
   signatures agree far too little for the threshold, go.
3. Candidates are confirmed on full shingle sets made from the whole texts: first the most alike partner of each
   document, then, of the others, those that still join two different components.
4. Where more documents share a shortest prefix than a row's neighbourhood holds, alike or not, a partner may stand
   beyond the neighbours. All documents of such crowded prefixes are compared exactly on their shingles: each posts the
   rarest fifth of its set and stands in one block, with others that hold its most common posting. A document visits
   the blocks that hold any of its postings, but for lists in which its own component is the largest; there it is
   counted against all residents at once, and pairs of different components that share enough postings for the
   threshold are confirmed on full sets. Blocks and their visitors are cut into cells of bounded size, and no row is
   made for a pair that falls short. Rows of a prefix that is not crowded are never cut apart by the range sort. So no
   partner is lost to the limit.
5. Components come from repeated contraction of the links, as joins and sums in Spark.

Defined results: without words n_shingles is 0 and the document stands alone; with fewer words than a shingle the
whole sequence is the one shingle; a row with a null doc_id is kept, with a null component; a repeated row
is judged like its twin (and both have the same component); rows that share a doc_id but not the text are judged each
by its own text, and a component is named by the least doc_id of its rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import wordhash as H

TURN = 4
SIGNATURE_SCHEMA = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, signature binary"


def _sets(words: H.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a slice, sorted by text, and the text of each."""
    h, of = H.shingle_hashes(words, width)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def _signer(width: int, values: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(seed))
        factors = rng.integers(1, 2**63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for i, j, data, off in H.slices(batch.column(1)):
                h, of = _sets(H.Words(data, off), width)
                n = np.bincount(of, minlength=j - i)
                full = np.flatnonzero(n)
                at = np.searchsorted(of, full)
                d = np.zeros((2, j - i), np.int64)
                signature = np.full((j - i, values), 2**32 - 1, ">u4")
                if len(full):
                    d[0, full] = np.add.reduceat(H.mix(h), at).view(np.int64)
                    d[1, full] = np.add.reduceat(H.mix(h ^ np.uint64(P2)), at).view(np.int64)
                    for k, f in enumerate(factors):
                        signature[full, k] = np.minimum.reduceat((h * f) >> np.uint64(32), at)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(values * 4), j - i, [None, pa.py_buffer(signature.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n, pa.int64()), pa.array(d[0]), pa.array(d[1]), rows.cast(pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "d1", "d2", "signature"],
                )

    return sign


P2 = 0x5851F42D4C957F2D


def _neighbours(near: int, least_depth: int, least_alike: float):
    """Pairs of each row with the next `near` in the order it comes in; rows: turn, doc_id, n_shingles, turned."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            signature = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(len(ids), -1)
            fresh = 0
            if tail is not None:
                fresh = len(tail[0])
                turn, ids, n, signature = (np.concatenate(x) for x in zip(tail, (turn, ids, n, signature), strict=True))
            for step in range(1, near + 1):
                a, b = np.arange(max(0, fresh - step), len(ids) - step), np.arange(max(0, fresh - step) + step, len(ids))
                if not len(a):
                    continue
                same = signature[a] == signature[b]
                alike = same.mean(axis=1)
                good = (turn[a] == turn[b]) & same[:, :least_depth].all(axis=1) & (alike >= least_alike)
                good &= 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])  # sizes that the threshold allows
                a, b, alike = a[good], b[good], alike[good]
                lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(alike)], ["a", "b", "alike"])
            tail = tuple(x[-near:] for x in (turn, ids, n, signature))

    return pair


def _confirm(width: int):
    """Keeps the pairs whose full sets reach 80 in 100; rows: a, b, text_a, text_b."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in H.slices(batch.column(2)):
                left, left_of = _sets(H.Words(data, off), width)
                right, right_of = [], []
                for p, _, more, at in H.slices(batch.column(3).slice(i, j - i)):
                    h, of = _sets(H.Words(more, at), width)
                    right.append(h)
                    right_of.append(of + p)
                h, of = np.concatenate([left, *right]), np.concatenate([left_of, *right_of])
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                both = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=j - i)
                union = np.bincount(of, minlength=j - i) - both
                good = pa.array((100 * both >= 80 * union) & (union > 0))
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(good), rows.column(1).filter(good)], ["a", "b"])

    return confirm


#: Shingles are called rare by the counts of this many ranges of their hashes: a table of bounded size.
RANGES = 1 << 20
#: Postings that a block of documents, or its visitors in one cell, hold in all, about.
BLOCK_POSTINGS = 1 << 15
POSTING_SCHEMA = "node long, part long, n int, token long"


def _range_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)


def _range_counts(width: int):
    """Rows node, part, text -> range, n: in how many sets the shingles of each range stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RANGES, np.int64)
        for batch in batches:
            for _, _, data, off in H.slices(batch.column(2)):
                n += np.bincount(_range_of(_sets(H.Words(data, off), width)[0]), minlength=RANGES)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000].astype(np.int32)), pa.array(n[at[i : i + 100_000]])], ["range", "n"])

    return count


def _postings(width: int, counts: np.ndarray):
    """The prefix of each set, rarest shingles first: two sets at 80 in 100 share one of their first n - ceil(0.8 n) + 1.
    A shingle that is alone in its range is in no other set and is left out."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, data, off in H.slices(batch.column(2)):
                h, of = _sets(H.Words(data, off), width)
                often = counts[_range_of(h)]
                order = np.lexsort((h, often, of))
                h, of, often = h[order], of[order], often[order]
                n = np.bincount(of, minlength=j - i)
                place = np.arange(len(h)) - (np.cumsum(n) - n)[of]
                good = (place <= n[of] - (4 * n[of] + 4) // 5) & (often > 1)
                of, h = of[good], h[good]
                yield pa.RecordBatch.from_arrays([pa.array(node[i + of]), pa.array(part[i + of]), pa.array(n[of].astype(np.int32)), pa.array(h.view(np.int64))], ["node", "part", "n", "token"])

    return post


def _cell(table: pa.Table) -> pa.Table:
    """Residents and visitors of a cell -> their pairs of different parts that may reach 80 in 100: a, b, x, y, alike."""
    node, part, n = (table.column(c).to_numpy() for c in ("node", "part", "n"))
    visits = table.column("visitor").to_numpy().astype(bool)
    tokens = table.column("tokens").combine_chunks()
    flat, edge = tokens.values.to_numpy(), tokens.offsets.to_numpy()
    size = np.diff(edge)
    of = np.repeat(np.arange(len(node)), size)
    home = np.flatnonzero(~visits)
    order = np.argsort(flat, kind="stable")
    order = order[~visits[of[order]]]
    sorted_, owner = flat[order], np.searchsorted(home, of[order])
    found = []
    step = max(1, (1 << 22) // max(len(home), 1))
    guests = np.flatnonzero(visits)
    for i in range(0, len(guests), step):
        some = guests[i : i + step]
        at = np.repeat(edge[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
        guest = np.repeat(np.arange(len(some)), size[some])
        shared = np.zeros(len(some) * len(home), np.int32)
        begin, end = np.searchsorted(sorted_, flat[at]), np.searchsorted(sorted_, flat[at], side="right")
        for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(end - begin) >> 22)) + 1):  # about 4 million meetings at once
            m = end[k] - begin[k]
            place = np.repeat(begin[k] - np.cumsum(m) + m, m) + np.arange(m.sum())
            shared += np.bincount(np.repeat(guest[k], m) * len(home) + owner[place], minlength=len(shared)).astype(np.int32)
        met = np.flatnonzero(shared)
        a, b, alike = some[met // len(home)], home[met % len(home)], shared[met]
        lo, hi = np.minimum(n[a], n[b]).astype(np.int64), np.maximum(n[a], n[b]).astype(np.int64)
        # Beyond their prefixes two sets share at most what the one set has there whose prefix ends first.
        good = (part[a] != part[b]) & (5 * lo >= 4 * hi) & (9 * (alike + (4 * hi + 4) // 5 - 1) >= 4 * (lo + hi))
        found.append((a[good], b[good], alike[good]))
    a, b, alike = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    turn = node[a] > node[b]
    a, b = np.where(turn, b, a), np.where(turn, a, b)
    return pa.table({"a": node[a], "b": node[b], "x": part[a], "y": part[b], "alike": alike.astype(np.int64)})


def _crowded_pairs(rows: DataFrame, width: int, path: str) -> DataFrame:
    """Every pair of rows (node, part, text) of different parts whose sets may reach 80 in 100: a, b, x, y (their parts),
    alike (shared prefix shingles). See step 4 above."""
    counts = np.zeros(RANGES, np.int64)
    got = rows.mapInArrow(_range_counts(width), "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).where("n > 1").toPandas()  # RANGES rows at most
    counts[got["range"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    postings = C.stored(rows.mapInArrow(_postings(width, np.minimum(counts, 2**31 - 1).astype(np.int32)), POSTING_SCHEMA), f"{path}/postings")
    parts = postings.groupBy("token", "part").agg(F.count("*").alias("m"))
    heads = parts.groupBy("token").agg(F.sum("m").alias("all"), F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    heads = C.stored(heads.select("token", "all", F.col("top.part").alias("main")), f"{path}/heads")
    lists = C.stored(postings.join(heads, "token"), f"{path}/lists")
    sets = lists.groupBy("node").agg(F.first("part").alias("part"), F.first("n").alias("n"), F.collect_list("token").alias("tokens"), F.max_by("token", F.struct("all", "token")).alias("block"))
    sets = C.stored(sets, f"{path}/sets")
    cells = lambda weight: F.ceil(F.sum(weight) / BLOCK_POSTINGS).cast("int")
    spot = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    homes = sets.select("node", "block", F.size("tokens").alias("size"))
    homes = homes.join(homes.groupBy("block").agg(cells("size").alias("cut")), "block").select("node", "size", "block", spot("cut").alias("at"))
    homes = C.stored(homes, f"{path}/homes")
    where = lists.select("token", "node").join(homes, "node").select("token", "block", "at").distinct()
    visits = C.stored(lists.where("part <> main").select("token", "node").join(where, "token").select("node", "block", "at").distinct(), f"{path}/visits")
    sizes = homes.select("node", "size")
    cut = visits.join(sizes, "node").groupBy("block", "at").agg(cells("size").alias("cut"))
    guests = visits.join(cut, ["block", "at"]).select("node", "block", "at", spot("cut").alias("cell"), F.lit(True).alias("visitor"))
    hosts = homes.join(cut, ["block", "at"]).select("node", "block", "at", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("cell"), F.lit(False).alias("visitor"))
    met = guests.unionByName(hosts).join(sets.select("node", "part", "n", "tokens"), "node")
    pairs = met.groupBy("block", "at", "cell").applyInArrow(_cell, "a long, b long, x long, y long, alike long")
    return C.stored(pairs.groupBy("a", "b", "x", "y").agg(F.max("alike").alias("alike")), f"{path}/crowded")


def components(links: DataFrame, path: str) -> DataFrame:
    """node, label (least node reachable) of every node of links (a, b), by contraction: each round every node
    hooks on its least neighbour, and links between what has become one node go."""
    links = C.stored(links.select("a", "b").where("a <> b").distinct(), f"{path}/links-0")
    labels = None
    for k in range(1, 64):  # each round at least halves the nodes that still have links
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        least = C.stored(least, f"{path}/least-{k}")
        jump = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        hooked = C.stored(least.join(jump, "to", "left").select("node", F.coalesce("further", "to").alias("label")), f"{path}/hooked-{k}")
        if labels is None:
            labels = hooked
        else:
            step = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = C.stored(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), f"{path}/labels-{k}")
        at = lambda old, new: hooked.select(F.col("node").alias(old), F.col("label").alias(new))  # noqa: B023, E731
        links = C.stored(links.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{path}/links-{k}")
        if links.isEmpty():
            return labels
    raise RuntimeError("links did not contract")


def near_duplicates(docs: DataFrame, width: int = 4, orders: int = 12, near: int = 4, least_depth: int = 2, least_alike: float = 0.5, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text). Links: Jaccard of full sets >= 0.8."""
    spark = docs.sparkSession
    path = C.shared_dir(spark)
    docs = C.documents_only(docs)
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    signed = C.stored(docs.mapInArrow(_signer(width, orders * TURN, seed), SIGNATURE_SCHEMA), f"{path}/signed")
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A group of equal sets has a number of its own, which is fixed once it is written, and one row of it stands for all.
    equal = named.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("signature").alias("signature"))
    groups = C.stored(equal.select("d1", "d2", "n_shingles", "row.doc_id", "row.text_hash", "signature", F.monotonically_increasing_id().alias("node")), f"{path}/groups")

    # The forest. Only documents that share a shortest prefix with another in some order are sorted in that order.
    turned = lambda t: F.concat(F.expr(f"substring(signature, {t} * {TURN * 4} + 1)"), F.expr(f"substring(signature, 1, {t} * {TURN * 4})"))
    heads = F.array(*[F.xxhash64(F.lit(t), F.substring(turned(t), 1, 4 * least_depth)) for t in range(orders)])
    short = groups.select("node", F.posexplode(heads).alias("turn", "head"))
    shared = short.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head", (F.col("n") > near + 1).alias("crowded"))
    where = short.join(shared, "head").groupBy("node").agg(F.collect_set(F.struct("turn", "crowded")).alias("turns"))
    rows = groups.join(where, "node").select("node", "n_shingles", F.explode("turns").alias("at"), "signature").select("node", "n_shingles", "at.turn", "at.crowded", "signature")
    rows = rows.select("turn", "node", "n_shingles", F.expr(f"concat(substring(signature, turn * {TURN * 4} + 1), substring(signature, 1, turn * {TURN * 4}))").alias("turned"), "crowded")
    rows = C.stored(rows, f"{path}/forest")
    crowd = C.stored(rows.where("crowded").select("node").distinct(), f"{path}/crowd")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = [F.when(F.col("crowded"), F.col(c)) for c in ("turned", "node")]
    ordered = rows.repartitionByRange(parts, "turn", F.substring("turned", 1, 4 * least_depth), *spread).sortWithinPartitions("turn", "turned", "node").drop("crowded")
    pairs = ordered.mapInArrow(_neighbours(near, least_depth, least_alike), "a long, b long, alike double")
    pairs = C.stored(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")), f"{path}/pairs")

    # Confirmation, on the texts of the documents that any pair names or that are crowded.
    ends = pairs.select("a").union(pairs.select("b")).union(crowd).distinct().withColumnRenamed("a", "node")
    ends = groups.select("doc_id", "text_hash", "node").join(ends, "node")
    texts = C.stored(docs.join(ends.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]), f"{path}/texts")

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        with_texts = some.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return C.stored(with_texts.mapInArrow(_confirm(width), "a long, b long"), f"{path}/{name}")

    each = pairs.select("a", "b", "alike").union(pairs.select("b", "a", "alike"))
    best = each.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b"))
    best = best.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().toDF("a", "b")
    best = C.stored(best, f"{path}/best")
    first = confirmed(best, "first")
    so_far = components(first, f"{path}/components-1")
    named_as = lambda old, new: so_far.select(F.col("node").alias(old), F.col("label").alias(new))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(named_as("a", "x"), "a", "left").join(named_as("b", "y"), "b", "left")
    rest = rest.where(F.coalesce("x", "a") != F.coalesce("y", "b"))
    second = confirmed(rest, "second")
    links = first.unionByName(second)
    so_far = components(links, f"{path}/components-2")
    rows = texts.join(crowd, "node").join(so_far, "node", "left").select("node", F.coalesce("label", "node").alias("part"), "text")
    met = _crowded_pairs(rows, width, path)
    # First the most alike partner of each document in each other component, then what still joins two components.
    each = met.select("a", "b", "y", "alike").union(met.select("b", "a", "x", "alike"))
    best = each.groupBy("a", "y").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b"))
    best = C.stored(best.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().toDF("a", "b"), f"{path}/best-crowded")
    third = confirmed(best, "third")
    links = links.unionByName(third)
    so_far = components(links, f"{path}/components-3")
    rest = met.select("a", "b").join(best, ["a", "b"], "left_anti").join(named_as("a", "x"), "a", "left").join(named_as("b", "y"), "b", "left")
    fourth = confirmed(rest.where(F.coalesce("x", "a") != F.coalesce("y", "b")), "fourth")
    labels = components(links.unionByName(fourth), f"{path}/components-4")

    classes = groups.select("d1", "d2", "n_shingles", "node", F.col("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = C.stored(classes.join(names, "label").select("d1", "d2", "n_shingles", "component_id"), f"{path}/classes")
    C.keep_only(spark, path, "signed", "classes")
    alone = signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)


#: The name of a row's number beside a table's own columns.
_ROW = "nightloom row"


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, one of each component: that with the least doc_id (a null last), of equal ones
    the first written. Rows are numbered, so that texts under one doc_id, copies under none and repeated rows are rows of
    their own; a row without words stays."""
    path = C.shared_dir(docs.sparkSession)
    rows = C.stored(docs.withColumn(_ROW, F.monotonically_increasing_id()), f"{path}/numbered")
    classes = near_duplicates(rows.select(F.col(f"`{_ROW}`").alias("doc_id"), "text"), width)
    ids = rows.select(F.col(f"`{_ROW}`").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    ranked = classes.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias(_ROW))
    return rows.join(kept.hint("shuffle_hash"), _ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
