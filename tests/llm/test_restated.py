"""Sharding's sizes and checksums, and the quality score, restated in plain Python."""

import math
import zlib

import zstandard
from pyspark.sql import functions as F

from nightloom.llm import common as C
from nightloom.llm import quality as Q
from nightloom.llm import sharding
from tests.compare import DATA, duck

TEXTS = duck().sql("SELECT doc_id, text FROM documents").fetchall()


def test_sizes_and_checksums(spark):
    got = sorted((r.doc_id, r.size, r.text_crc32) for r in sharding.op6_sharding(spark, DATA).collect())
    assert got == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)


def test_shards_are_near_equal_and_gapless(spark):
    rows = sharding.op6_sharding(spark, DATA).collect()
    size, slots = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= max(r.size for r in rows)


def test_quality_score_restated(spark):
    docs = C.documents_only(C.table(spark, DATA, "documents"))
    model = Q.train(docs, C.table(spark, DATA, "labels").where(C.fold(F.col("doc_id"), 3) != 1))
    coders = [zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(model[k]), write_checksum=False, write_content_size=False, write_dict_id=False) for k in ("good", "bad")]

    def score(text):
        raw = (text or "").encode()
        n = max(1, round(len(raw) / Q.BLOCK))
        step = math.ceil(len(raw) / n) or 1
        blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
        if not blocks:
            x = [0.0, 0.0, 4.0]
        else:
            good, bad = ([len(c.compress(b)) for b in blocks] for c in coders)
            saved, few = [b - g for g, b in zip(good, bad, strict=True)], max(1, len(blocks) // 4)
            unit = len(blocks[0]) + Q.STEADY
            x = [8 * sum(saved) / (len(raw) + Q.STEADY), 8 * sum(sorted(saved)[:few]) / few / unit, 8 * (sum(sorted(good)[:few]) / few + Q.STEADY / 2) / unit]
        *slopes, start = model["logit"]
        return 1 / (1 + math.exp(-(start + sum(a * b for a, b in zip(slopes, x, strict=True)))))

    got = {r.doc_id: r.score for r in Q.score_quality(docs, model).collect()}
    assert len(got) == len(TEXTS) and all(abs(got[i] - score(t)) < 1e-9 for i, t in TEXTS)
