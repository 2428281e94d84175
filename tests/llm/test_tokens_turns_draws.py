"""Token files, conversation repair and importance resampling against brute force, with odd cases."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nightloom.llm import common as C
from nightloom.llm import conversation_repair as R
from nightloom.llm import importance as I
from nightloom.llm import token_files as T
from tests.compare import DATA, duck
from tests.llm import helpers as H

ODD = [(5, "Many words. " * 30), (5, "other text"), (5, "other text"), (None, "null id"), (None, "null id"), (1, None), (2, ""), (9, "x" * 3000), (3, "É漢字 <|endoftext|> it's 42"), (-4, "neg\n\tative  "), (7, "漢" * 900)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.vocabulary())


# Token files


def filed(pairs):
    t = library()
    rows = [(i, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for i, x in pairs]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), crc(r[1])))
    out, start = [], 0
    for i, ids in rows:
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_files_odd_rows(spark):
    folder = C.shared_dir(spark)
    listed = T.write_documents(H.table(spark, ODD, extra=True), folder)
    got = [tuple(r) for r in T.digests(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(filed(ODD), key=str)
    assert sum(r.documents for r in listed.collect()) == len(ODD)
    # One document by its index, without the others.
    t = library()
    found = 0
    for r in listed.collect():
        f = T.TokenFile(folder, r.file)
        for k in f.find(9):
            assert f.ids(k).tolist() == [*t.encode("x" * 3000, add_special_tokens=False).ids, 2]
            found += 1
        found += 10 * len(f.find(None)) + 100 * len(f.find(12345))
    assert found == 21


def test_token_files_empty_table_and_wrong_dictionary(spark):
    folder = C.shared_dir(spark)
    assert T.write_documents(H.empty(spark), folder).count() == 0
    assert T.read_documents(spark, folder).count() == 0
    name = T.write_documents(H.table(spark, {1: "some text"}), folder + "-b").first().file
    digest = T.TokenFile(folder + "-b", name).head["dictionary"]
    T._dictionary.cache_clear()
    T._put(f"{folder}-b/dictionary-{digest}", lambda out: out.write(b"another"))
    with pytest.raises(ValueError, match="dictionary"):
        T.TokenFile(folder + "-b", name)


def test_token_files_query(spark):
    rows = duck().sql("SELECT doc_id, text FROM documents").fetchall()
    got = [tuple(r) for r in T.op11_token_files(spark, DATA).collect()]
    assert sorted(got) == sorted(filed(rows))


def test_dictionary_is_shared_and_helps(spark):
    folder = C.shared_dir(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    name = T.write_documents(docs, folder).first().file
    f = T.TokenFile(folder, name)
    import zstandard

    alone = sum(len(zstandard.ZstdCompressor(level=T.LEVEL).compress(ids.astype("<u2").tobytes())) for _, ids in f.all())
    assert f.at[-1] < alone


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*"aBIs'1 \n\t .,?İⅷßΣ́e漢<|>", "<|endoftext|>", "　"]), max_size=120).map("".join))
def test_stretches_encode_like_the_whole(text):
    encoder = T._encoder(T.vocabulary(), 2)
    texts = [text, None, text + "\x0b" + text]
    for _ in range(2):
        assert [x.tolist() for x in encoder(pa.array(["before", *texts])[1:])] == [[*library_ids(t or ""), 2] for t in texts]


def test_encoder_on_whole_texts_and_forgetting(monkeypatch):
    texts = [r[0] for r in duck().sql("SELECT text FROM documents").fetchall()]
    want = [[*library_ids(t or ""), 2] for t in texts]
    assert [x.tolist() for x in T.Encoder(T.vocabulary())(pa.array(texts))] == want
    monkeypatch.setattr(T, "REMEMBERED", 3)
    monkeypatch.setattr(T, "AT_ONCE", 5)
    encoder = T.Encoder(T.vocabulary())
    for k in range(0, 60, 3):
        assert [x.tolist() for x in encoder(pa.array(texts[k : k + 3], pa.string()))] == want[k : k + 3]
    for text in ("a b c", "İi İ. 'S It'S I'LL", "a " + "long" * 90, "ⅷ x², ª"):
        assert [x.tolist() for x in encoder(pa.array([text]))] == [[*library_ids(text), 2]]
    assert not any(len(w) > T.LONG for w in encoder.kept)


@functools.cache
def _library():
    return library()


def library_ids(text):
    return _library().encode(text, add_special_tokens=False).ids


# Conversations


def cheapest(kinds):
    @functools.cache
    def best(i, s, inserted):
        turn = 2 if s != 2 else 3
        out = [(0, "")] if i == len(kinds) and s in (0, 3) else []
        if inserted < 3:
            c, a = best(i, turn, inserted + 1)
            out.append((c + 5, "I" + a))
        if i < len(kinds):
            role, extra = kinds[i] & 3, 5 if kinds[i] & R.CUT_OFF else 0
            c, a = best(i + 1, s, 0)
            out.append((c + 2, "D" + a))
            if not kinds[i] & R.MUST_GO:
                if role and s in {1: (0,), 2: (0, 1, 3), 3: (2,)}[role]:
                    c, a = best(i + 1, role, 0)
                    out.append((c + extra, "K" + a))
                c, a = best(i + 1, turn, 0)
                out.append((c + extra + 1, "R" + a))
        return min(out, default=(10**9, ""))

    return best(0, 0, 0)


@pytest.mark.parametrize(("direct", "block"), [(512, 64), (0, 1), (0, 3), (2, 5)])
def test_layers_give_least_cost_and_audit(monkeypatch, direct, block):
    monkeypatch.setattr(R, "DIRECT", direct)
    monkeypatch.setattr(R, "BLOCK", block)
    R.least_edits.cache_clear()
    rng = random.Random(direct + block)
    for _ in range(600):
        kinds = bytes(rng.choice([0, 1, 2, 3, 2, 3, 2, 3, 4, 6, 7, 8, 10, 11]) for _ in range(rng.randint(0, 9)))
        assert R.least_edits(kinds) == cheapest(kinds), kinds
    R.least_edits.cache_clear()


def test_long_conversation_in_blocks(monkeypatch):
    rng = random.Random(5)
    kinds = bytes(rng.choice([0, 4, 10, 11, 2, 3]) if rng.random() < 0.25 else 2 + i % 2 for i in range(500))
    whole = R.least_edits(kinds)
    R.least_edits.cache_clear()
    monkeypatch.setattr(R, "DIRECT", 100)
    assert R.least_edits(kinds) == whole
    R.least_edits.cache_clear()


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 5, "assistant", "  "), (1, None, "user", "first?"),
    (2, 0, "assistant", "cut"), (2, 1, "", "no role."), (None, 3, None, None), (None, None, "user", "a."), (None, 4, "User", "b.\n"), (3, 0, "user", "x" * 4000 + "."), (3, 1, "assistant", "y" * 4000 + "!\t"),
]
ROWS = "conv_id long, turn long, role string, text string"


def repaired(rows):
    """conv_id -> row, by plain loops, from rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(({1: r[1], 2: r[2] if r[2] is not None else " ", 3: r[3] if r[3] is not None else " "} for r in rows if r[0] == conv and not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults, kinds = set(), [], []
        for r in turns:
            bare = r[3].strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (r[2], r[3]) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((r[2], r[3]))
            kinds.append({"s": 1, "u": 2, "a": 3}.get(r[2][:1], 0) + {"blank": 4, "duplicate": 4, "truncated": 8, "": 0}[faults[-1]])
        known = {r[1] for r in turns} - {None}
        cost, audit = cheapest(tuple(kinds))
        lines, i, state = [], 0, 0
        for e in audit:
            turn = 2 if state != 2 else 3
            if e == "K":
                state = kinds[i] & 3
                lines.append(turns[i][2] + ":" + turns[i][3])
            elif e in "RI":
                state = turn
                lines.append(("user:" if turn == 2 else "assistant:") + (turns[i][3] if e == "R" else ""))
            i += e != "I"
        pairs = zip(turns, turns[1:], strict=False)
        out[conv] = (conv, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, "\n".join(lines))
    return sorted(out.values(), key=str)


def test_repair_odd_rows(spark):
    rows = spark.createDataFrame(TURNS, ROWS)
    for name in ("kind", "gone_", "cost", "audit", "a.b"):
        rows = rows.withColumn(name, rows.conv_id)
    got = sorted((tuple(r) for r in R.repair(rows).collect()), key=str)
    assert got == repaired([(*r, False) for r in TURNS])
    assert R.repair(spark.createDataFrame([], ROWS)).count() == 0


def test_damage_and_repair(spark):
    table = duck().sql("SELECT * FROM conversations").fetchall() + [(77_777, t, "user", "Only row.") for t in range(60)] + [(None, None, "user", "Null."), (88_888, 11, None, None)]
    damaged = []
    for c, t, role, text in table:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        row = (c, t, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text, code == 0)
        damaged += [row] * (2 if code == 3 else 1)
    assert any(r[4] for r in damaged)
    got = sorted((tuple(r) for r in R.repair(R.damage(spark.createDataFrame(table, ROWS))).collect()), key=str)
    assert got == repaired(damaged)


def test_lost_conversation_is_returned(spark):
    lost = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = R.repair(R.damage(spark.createDataFrame([(*lost, "user", "Gone.")], ROWS))).collect()
    assert [tuple(r) for r in got] == [(lost[0], 0, 0, 0, 0, 0, 0, "", "")]


# Importance


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, most):
    w = WORD.findall((text or "").translate(H.LOWER))
    return w, [" ".join(w[j : j + k]) for k in range(1, most + 1) for j in range(len(w) - k + 1)]


@pytest.mark.parametrize("window", [3, 1 << 22])
def test_automaton_against_regex(monkeypatch, window):
    monkeypatch.setattr(I, "WINDOW", window)
    monkeypatch.setattr(I, "SIDE_BY_SIDE", 5)
    rng = random.Random(window)
    for _ in range(40):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("aB9 .é漢\n_") for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(rng.randint(0, 8))] + ["x" * 300 + " " + "é" * 100]
        column = pa.array(["before Q", *texts], pa.string())[1:]
        for most in (1, 2, 3):
            want = sorted((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for f in runs(t, most)[1])
            assert sorted((int(a), int(b)) for r, c, _ in I.feature_crcs(column, most) for a, b in zip(r, c, strict=True)) == want


def drawn(docs, target, most, buckets=10_000, percent=10, least=20):
    corpus, aim = np.zeros(buckets), np.zeros(buckets)
    found = [(i, *runs(t, most)) for i, t in docs]
    for _, _, fs in found:
        for f in fs:
            corpus[zlib.crc32(f.encode()) % buckets] += 1
    for t in target:
        for f in runs(t, most)[1]:
            aim[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (corpus.sum() + buckets) / ((corpus[b] + 1) * (aim.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, w, fs in found:
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))[: percent * sum(r[1] >= least for r in rows) // 100]
    left = list(enumerate(able, 1))
    out = []
    for r in rows:
        hit = next((x for x in left if x[1] == r), None)
        if hit:
            left.remove(hit)
        out.append((*r, hit and hit[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 2])
def test_resampling_odd_rows(spark, most):
    rng = random.Random(most)
    docs = ODD + [(k % 40 or None, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünï"]) for _ in range(rng.choice([19, 20, 25, 60])))) for k in range(90)] + [(50, "same words " * 15)] * 7
    target = ["alpha beta gamma", None, "", "alpha alpha"]
    got = I.resample(H.table(spark, docs, extra=True), spark.createDataFrame([(t,) for t in target], "text string"), percent=35, most=most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(docs, target, most, percent=35)


def test_resampling_empty_tables(spark):
    nothing = spark.createDataFrame([], "text string")
    assert I.resample(H.empty(spark), nothing).count() == 0
    assert [tuple(r)[1:4] for r in I.resample(H.table(spark, {1: None}), nothing).collect()] == [(0, 0, 0)]
