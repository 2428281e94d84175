"""Pieces against the reference library on the given model, and exact round trips."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from nightloom.llm import sentence_pieces as S
from tests.compare import duck
from tests.llm import helpers as H

PARTS = ["a", "b", "th", "e", "er", " ", "  ", "the", "\n", "\t", "é", "ing", "你", "🙂", "x", "   ", "tion", "0", "12", "www", "...", "http", "==", "\r\n", "\x00", "<s>", "ﬁ"]


@pytest.fixture(scope="module")
def both():
    return S.Codec(S.load()), sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_same_ids_as_the_library(both):
    codec, library = both
    rng = random.Random(1)
    texts = [r[0] for r in duck().sql("SELECT text FROM documents").fetchall()] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", " " * 77, "x" * 5000, "ab" * 3000 + "=" * 2000, "thequickbrownfox" * 300]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == library.encode(t) and codec.decode(ids) == t


def test_stream_commits_early(both):
    codec, library = both
    text = "hello world " * 300
    taken = 0

    def characters():
        nonlocal taken
        for c in S.BLANK + text.replace(" ", S.BLANK):
            taken += 1
            yield c

    out, first = [], None
    for i in codec.stream(characters()):
        first = taken if first is None else first
        out.append(i)
    assert out == library.encode(text) and first <= 6 * codec.longest


def test_many_stretches_at_once_are_the_streams(both):
    """Stretches of all lengths, with blanks, without pieces, repeated, over several parts of a column, from a slice of it."""
    codec, library = both
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS + ["▁", "ab" * 200, "  x", "\n\n"]) for _ in range(rng.randint(0, 30))) or None for _ in range(150)] * 2
    column = pa.array([None, *texts], pa.string()).slice(1)
    got = codec.encode_column(column)
    assert got.to_pylist() == library.encode([t or "" for t in texts])
    assert codec.decode_column(got).to_pylist() == [(t or "").replace("▁", " ") for t in texts]
    assert got.to_pylist() == [codec._one(" " + t) if t else [] for t in texts]
    assert codec.decode_column(pa.array([[codec.byte[0xC3]], [], None], pa.list_(pa.int32()))).to_pylist() == ["\ufffd", "", ""]


def test_a_small_memory_gives_the_same(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(S, "REMEMBERED", 50)
    monkeypatch.setattr(S, "PART_BYTES", 1000)
    fresh = S.Codec(S.load())
    texts = [r[0] for r in duck().sql("SELECT text FROM documents LIMIT 60").fetchall()]
    assert fresh.encode_column(pa.array(texts, pa.string())).to_pylist() == library.encode([t or "" for t in texts])
    assert len(fresh.memo[0]) < 2000


def test_paths_that_never_meet_are_kept_whole():
    pieces = [("<unk>", 0.0, "unknown"), ("▁", -1.0, "normal"), ("a", -9.0, "normal"), ("aa", -1.0, "normal"), ("aaa", -1.4, "normal")]
    codec = S.Codec({"name": "toy", "bpe": False, "dummy": True, "pieces": pieces})
    ids = list(codec.stream(["▁" + "a" * 30_001]))
    assert codec.decode(ids) == "a" * 30_001 and len(ids) == 1 + 30_001 // 3 + 1


def test_unigram_path_has_the_best_score():
    pieces = [("<unk>", 0.0, "unknown"), *[(p, s, "normal") for p, s in (("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -2.5), ("▁a", -3.5), ("ba", -2.2), ("abab", -6.0))]]
    codec = S.Codec({"name": "toy", "bpe": False, "dummy": True, "pieces": pieces})
    score = {p: s for p, s, _ in pieces}

    def best(s):
        return 0.0 if not s else max(score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score)

    for t in ("ab", "abab", "babab", "aabbab a b", "ab" * 9):
        got = sum(pieces[i][1] for i in codec.encode(t))
        assert got == pytest.approx(best("▁" + t.replace(" ", "▁"))) and codec.decode(codec.encode(t).tolist()) == t


def test_round_trip_of_a_table(spark):
    texts = {1: None, 2: "", 3: "a▁b", 4: "É\n\n x " * 500, 5: "same", 6: "same"}
    docs = H.table(spark, texts, extra=True)
    got = {r.doc_id: r for r in S.round_trip(docs, S.load()).collect()}
    assert all(r.exact for r in got.values()) and got[1].n_ids == 0 and got[5].ids == got[6].ids
    decoded = {r.doc_id: r.decoded for r in S.decode(S.encode(docs, S.load()), S.load()).collect()}
    assert decoded == {i: (t or "").replace("▁", " ") for i, t in texts.items()}
    assert S.round_trip(H.empty(spark), S.load()).count() == 0
