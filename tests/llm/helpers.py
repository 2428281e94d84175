"""Brute-force restatements on Python strings, and small document tables with every odd case."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def table(spark, texts, extra=False):
    """texts: id -> text, or a list of (id, text)."""
    pairs = list(texts.items()) if isinstance(texts, dict) else texts
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCS)
    if extra:
        for name in ("rank", "text_a", "row", "shingle", "lines", "kept_text", "at", "next", "label", "a.b"):
            df = df.withColumn(name, df.doc_id)
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def linked(sets):
    """Least id reachable of every id of {id: set}, by links of Jaccard >= 0.8."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
