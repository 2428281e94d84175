"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes are spread over [0, 2^62).
SPAN = 2**62


def spread(*cols: Column) -> Column:
    return F.xxhash64(F.lit(17), *cols).bitwiseAND(F.lit(SPAN - 1))


def sample_by_class(rows: DataFrame, per_class: int) -> tuple[DataFrame, dict]:
    """About per_class rows of each label (all, where there are fewer), chosen by the hash of doc_id, and the labels' counts.

    rows: doc_id, label. The counts have a row for each label; the sample is cut off at twice per_class a label, so it is
    bounded by its parameter whatever the table's size."""
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in counts.items():
        cut = SPAN if n <= per_class else int(SPAN * per_class / n)
        keep = keep | ((F.col("label") == label) & (spread(F.col("doc_id")) < F.lit(cut)))
    return rows.where(keep).limit(2 * per_class * max(1, len(counts))), counts


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label (0 or 1): one row a document; rows with a null in either go, and 1 wins where labels disagree."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def logistic(x, y, weight=None, ridge: float = 1e-3, steps: int = 50):
    """Coefficients (intercept last) of a logistic regression by Newton steps; x: rows by features."""
    import numpy as np

    x = np.column_stack([np.asarray(x, float), np.ones(len(y))])
    y = np.asarray(y, float)
    v = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (v * (y - p)) - ridge * b
        hess = (x * (v * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
