"""Bounded samples of labelled documents, and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, of: dict[int, int], modulus: int, held: int, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``of[label]`` labelled documents outside the held-out rows.

    Documents are taken in the order of the md5 of their id; longer texts than ``max_bytes`` are not sampled, so the
    sample is bounded by its parameters, one text of each id. The ids, as few as that, are broadcast; the corpus is scanned once.
    """
    usable = labels.where(f"doc_id IS NOT NULL AND `{label}` IS NOT NULL").where(remainder(modulus) != held)
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = None
    for value, n in of.items():
        some = usable.where(F.col("_label") == value).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(n)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    # An id may stand in any number of rows: the smallest of its texts is taken, in a grouped minimum.
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    rows = once.where("text IS NOT NULL").collect()
    return [(r["text"], r["_label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
