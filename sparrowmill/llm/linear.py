"""Sparse logistic regression by follow-the-regularised-leader, and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowmill.storage import written

#: At most so many labelled rows train a classifier; those with the smallest hash of doc_id.
MAX_TRAINING_ROWS = 8000
#: And at most so many bytes of their texts; rows beyond, in the order of that hash, are left out.
MAX_TRAINING_BYTES = 64 << 20


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def training_rows(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = MAX_TRAINING_ROWS, most_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """doc_id, label (0 or 1) and text of at most so many labelled documents and bytes of text; a stored table.

    allowed: a condition on labels' doc_id. Labels without doc_id or value are left
    out; of repeated labels the larger value holds, of rows that repeat a doc_id the
    text with the smallest hash. The sample's keys are bounded by most, hence
    broadcast; of its texts only the sizes come to the driver.
    """
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    stored = written(once, "training")
    sizes = stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    total, kept = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] <= most_bytes:  # one that doesn't fit is passed over
            total += r["n"]
            kept.append(r["doc_id"])
    return stored if len(kept) == len(sizes) else stored.where(F.col("doc_id").isin(kept))


class Ftrl:
    """Per-coordinate adaptive logistic regression with L1 and L2; weights of 2**bits hashed features and a bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = size

    def _weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, target: float, importance: float = 1.0) -> None:
        """One example; index has no repeats."""
        i, x = np.append(index, self.bias), np.append(value, 1.0)
        w = self._weights(i)
        g = importance * (sigmoid(float(w @ x)) - target) * x
        more = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(more) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] = more

    def weights(self) -> tuple[np.ndarray, float]:
        w = self._weights(np.arange(len(self.z)))
        return w[:-1].astype(np.float32), float(w[-1])
