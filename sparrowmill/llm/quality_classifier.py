"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Each text gives two streams of tokens: its words in lower case, and their forms
(upper-case, lower-case and digit runs, and punctuation as it stands). Single
tokens and pairs of neighbours of both streams are hashed to 2**BITS features;
a pair of equal words is one feature of its own. A feature's value is its count
divided by the number of words, so a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.linear import MAX_TRAINING_ROWS, Ftrl, remainder, sigmoid, training_rows
from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.llm.wordhash import LOWER, Words, mix, span_hashes, words_of
from sparrowmill.storage import table

BITS = 18
EPOCHS = 4
THRESHOLD = 0.3
HELD_OUT = (5, 0)

_FORM = np.arange(256, dtype=np.uint8)
_FORM[ord("a") : ord("z") + 1] = ord("a")
_FORM[128:] = ord("a")
_FORM[ord("A") : ord("Z") + 1] = ord("A")
_FORM[ord("0") : ord("9") + 1] = ord("0")
_SALTS = np.asarray([0x51ED2701, 0x51ED2702, 0x51ED2703, 0x51ED2704], np.uint64)


def _forms(words: Words) -> np.ndarray:
    """A hash of each word's form: runs of one class of letter count as one."""
    form = _FORM[words.data]
    inside = np.zeros(len(form), np.int32)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    keep = np.cumsum(inside) > 0
    new = np.ones(len(form), bool)
    new[1:] = form[1:] != form[:-1]
    new[words.starts] = True
    keep &= new
    place = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(form[keep], place[words.starts], place[words.ends])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, the text that each belongs to, and words per text."""
    words = words_of([(t or "").encode() for t in texts])
    n = np.diff(words.first)
    if not len(words.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    lower = span_hashes(LOWER[words.data], words.starts, words.ends)
    form, owner = _forms(words), words.owner()
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    both = [lower, form]
    for stream in (lower, form):
        p = mix(stream[pair] * np.uint64(3) + stream[pair + 1])
        both.append(p)
    both[2] = np.where(lower[pair] == lower[pair + 1], np.uint64(7), both[2])
    index = np.concatenate([mix(h ^ s) >> np.uint64(64 - BITS) for h, s in zip(both, _SALTS)]).astype(np.int64)
    return index, np.concatenate([owner, owner, owner[pair], owner[pair]]), n


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows outside the held-out part; without any, all zero."""
    modulus, held = HELD_OUT
    rows = training_rows(documents, labels, "quality", remainder(F.col("doc_id"), modulus) != held, most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            index, owner, n = features(batch.column("text").to_pylist())
            key, count = np.unique(owner << BITS | index, return_counts=True)
            cut = np.searchsorted(key >> BITS, np.arange(batch.num_rows + 1))
            parts = [(key[a:b] & (1 << BITS) - 1, count[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(n), pa.array([p[0].astype(np.int32).tobytes() for p in parts], pa.binary()), pa.array([p[1].astype(np.float32).tobytes() for p in parts], pa.binary())],
                ["doc_id", "label", "n", "index", "count"],
            )

    found = map_texts(rows, extract, "doc_id long, label int, n long, index binary, count binary").toPandas()
    found = found.assign(h=found["doc_id"].map(lambda d: d * 0x9E3779B97F4A7C15 & 0xFFFFFFFF)).sort_values(["h", "doc_id"])
    model = Ftrl(1 << BITS, alpha=2.0, beta=0.05, l1=0.02, l2=0.001)
    examples = [(np.frombuffer(r.index, np.int32), np.frombuffer(r.count, np.float32) / max(1, r.n), float(r.label)) for r in found.itertuples(index=False)] if len(found) else []
    for _ in range(EPOCHS):
        for index, value, label in examples:
            model.learn(index, value, label)
    return model.weights()


def scored(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each input row; a text without words gets the bias alone."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            index, owner, n = features(batch.column("text").to_pylist())
            total = np.bincount(owner, weights[index], minlength=batch.num_rows)
            p = sigmoid(bias + total / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    modulus, held = HELD_OUT
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long"), out.alias("held_out"), F.col("text").cast("string"))
    return map_texts(rows, score, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Train on at most so many labelled rows, score every row of documents.

    Null texts count as empty. A null doc_id is never held out and never trains;
    repeated rows are scored alike. Without labels every score is 0.5.
    """
    return scored(documents, *train(documents, labels, most))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
