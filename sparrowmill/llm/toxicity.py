"""Toxicity by weak supervision.

Voters are words of a fixed lexicon and patterns (whole words and word
beginnings of 4 to 6 bytes) that the labelled training rows suggest. A
generative label model then forgets those labels: a hidden class and, given it,
each voter's rate of firing are estimated by expectation-maximisation; voters
whose firing stays correlated given the class (a word and its own beginning)
share their evidence. The posteriors train a sparse linear classifier on all
hashed words and word beginnings, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.linear import MAX_TRAINING_ROWS, Ftrl, remainder, sigmoid, training_rows
from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.llm.wordhash import mix, span_hashes, words_of
from sparrowmill.storage import table

#: Words that are insults in themselves.
LEXICON = ("idiot", "moron", "scum", "clown", "loser", "trash", "stupid", "pathetic", "worthless", "disgusting", "imbecile", "garbage", "vermin", "filth", "dumb", "hate")
BITS = 20
PREFIXES = (4, 5, 6)
MAX_VOTERS = 256
MIN_FIRED = 5
MIN_PRECISION = 0.98
EM_ROUNDS = 40
EPOCHS = 8
THRESHOLD = 0.7
HELD_OUT = (3, 1)

#: Letters (all bytes from 128 on among them) stay, what stands between words becomes a space.
_LETTERS = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _LETTERS[_b] = _b


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word beginnings with the text that each belongs to, repeats included."""
    words = words_of([(t or "").lower().encode() for t in texts], _LETTERS)
    owner = words.owner()
    index, owners = [mix(words.hashes ^ np.uint64(0xA0)) >> np.uint64(64 - BITS)], [owner]
    size = words.ends - words.starts
    for k in PREFIXES:
        long = np.flatnonzero(size > k)
        h = span_hashes(words.data, words.starts[long], words.starts[long] + k)
        index.append(mix(h ^ np.uint64(0xB0 + k)) >> np.uint64(64 - BITS))
        owners.append(owner[long])
    return np.concatenate(index).astype(np.int64), np.concatenate(owners)


def _sample(documents: DataFrame, labels: DataFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and label of each labelled text; texts with equal features, copies above all, count once, with their mean label."""
    modulus, held = HELD_OUT
    rows = training_rows(documents, labels, "toxic", remainder(F.col("doc_id"), modulus) != held, most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            index, owner = features(batch.column("text").to_pylist())
            key = np.unique(owner << BITS | index)
            cut = np.searchsorted(key >> BITS, np.arange(batch.num_rows + 1))
            packed = [(key[a:b] & (1 << BITS) - 1).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "index"])

    found = map_texts(rows, extract, "doc_id long, label int, index binary").toPandas()
    if not len(found):
        return [], np.zeros(0)
    found = found.assign(h=found["doc_id"].map(lambda d: d * 0x9E3779B97F4A7C15 & 0xFFFFFFFF)).sort_values(["h", "doc_id"])
    found = found.groupby("index", sort=False)["label"].mean()
    return [np.frombuffer(x, np.int32) for x in found.index], found.to_numpy(float)


def choose_voters(examples: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Hashed features that vote "toxic" where they occur: the lexicon's, then those most often right in the training labels."""
    size = 1 << BITS
    fired, right = np.zeros(size), np.zeros(size)
    for index, y in zip(examples, target):
        fired[index] += 1
        right[index] += y
    good = np.flatnonzero((right >= MIN_FIRED) & (right >= MIN_PRECISION * fired))
    good = good[np.lexsort((good, -right[good]))][:MAX_VOTERS]
    fixed, owner = features(list(LEXICON))
    fixed = fixed[np.unique(owner, return_index=True)[1]]  # the words themselves come first
    fixed = fixed[fired[fixed] > 0]
    return np.unique(np.concatenate([fixed, good]))


def label_model(votes: np.ndarray, prior: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Posterior of the hidden class for each row of 0/1 votes (rows x voters), no labels used.

    A voter that fires adds its log ratio of rates, divided by the sum of its
    correlations, given the class, with all voters that fire with it, so that a group
    of like voters counts about once. One that doesn't adds the log ratio of not
    firing, divided by its correlations with all voters. The first guess is that a row
    in which any voter fires is toxic; voters that fire as often in either class
    lose their say from round to round.
    """
    n, _ = votes.shape
    posterior = np.where(votes.any(1), 0.9, 0.02)
    for _ in range(rounds):
        pos, neg = posterior.sum(), (1 - posterior).sum()
        hit = (posterior @ votes + 0.5) / (pos + 1)
        false = ((1 - posterior) @ votes + 0.05) / (neg + 1)
        centred = votes - np.outer(posterior, hit) - np.outer(1 - posterior, false)
        deviation = np.sqrt((centred**2).mean(0)) + 1e-9
        correlation = np.abs(centred.T @ centred / n) / np.outer(deviation, deviation)
        like = np.where(correlation > 0.3, np.minimum(correlation, 1), 0)
        np.fill_diagonal(like, 1)
        evidence = (votes * np.log(hit / false) / np.maximum(1, votes @ like)).sum(1)
        evidence += (1 - votes) @ (np.log((1 - hit) / (1 - false)) / like.sum(0))
        rate = np.clip(posterior.mean(), prior / 4, min(0.9, prior * 4))
        new = sigmoid(np.log(rate / (1 - rate)) + evidence)
        if np.abs(new - posterior).max() < 1e-4:
            return new
        posterior = new
    return posterior


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias; without labelled rows or any voter, no document is toxic."""
    examples, target = _sample(documents, labels, most)
    nothing = np.zeros(1 << BITS, np.float32), -4.0
    if not len(target):
        return nothing
    voters = choose_voters(examples, target)
    if not len(voters):
        return nothing
    votes = np.zeros((len(examples), len(voters)))
    for k, index in enumerate(examples):
        votes[k] = np.isin(voters, index)
    posterior = label_model(votes, float(np.clip(target.mean(), 0.005, 0.5)))
    seen = np.zeros(1 << BITS)
    for index in examples:
        seen[index] += 1
    model = Ftrl(1 << BITS, alpha=0.5, beta=1.0, l1=4.0, l2=0.1)
    usual = seen >= MIN_FIRED
    kept = [index[usual[index]] for index in examples]
    for _ in range(EPOCHS):
        for index, p in zip(kept, posterior):
            model.learn(index, np.ones(len(index)), p)
    return model.weights()


def _probabilities(texts: list[str | None], known: np.ndarray, used: np.ndarray, value: np.ndarray, bias: float) -> np.ndarray:
    """known: which features have a weight; used and value: their numbers, ascending, and weights."""
    index, owner = features(texts)
    hit = known[index]
    key = np.unique(owner[hit] << BITS | index[hit])
    w = value[np.searchsorted(used, key & (1 << BITS) - 1)] if len(used) else np.zeros(0)
    return sigmoid(bias + np.bincount(key >> BITS, w, minlength=len(texts)))


def scored(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each input row; a feature counts once however often it occurs."""
    used = np.flatnonzero(weights)
    value = weights[used]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[used] = True
        for batch in text_slices(batches):
            p = _probabilities(batch.column("text").to_pylist(), known, used, value, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    modulus, held = HELD_OUT
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long"), out.alias("held_out"), F.col("text").cast("string"))
    return map_texts(rows, score, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_scores(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Train on at most so many labelled rows, score every row of documents.

    Null texts count as empty and get the bias alone. A null doc_id is never held
    out and never trains; repeated rows are scored alike. Without labels nothing
    is predicted toxic. Other columns aren't read.
    """
    return scored(documents, *train(documents, labels, most))


def accepted(documents: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """documents less those predicted toxic, all columns as they are; null and empty texts stay."""
    weights, bias = train(documents, labels, most)
    used = np.flatnonzero(weights)
    value = weights[used]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[used] = True
        for batch in text_slices(batches):
            p = _probabilities(batch.column("text").to_pylist(), known, used, value, bias)
            yield batch.filter(pa.array(p < THRESHOLD))

    return map_texts(documents, keep, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
