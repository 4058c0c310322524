"""Benchmark decontamination by spaced seeds.

Words (runs of letters, marks and digits, lower-cased; in scripts without spaces
each letter) of benchmark items are hashed under fixed masks that ignore some
positions, so that words exchanged there do no harm. Documents' windows under the
same masks are joined with the items' seeds; each hit fixes an alignment of item
and document, which is verified word by word: some stretch must have MIN_WORDS
equal words (of items below 15 words, 80 percent of theirs) and no more than one
word in five exchanged. Of the stretches of one item in one document that overlap
there the one with the most equal words is reported.

Masks: every stretch of 12 words with two exchanged at any places has a window that
one of MASKS finds, every item of 5 to 11 words with as many exchanged as the rule
allows one that SHORT_MASKS find. Items of up to 4 words are found only where they
are the whole text.

The benchmark is sent to the executors as an index, in blocks of about BROADCAST_BYTES of
text. Each block meets all documents in one pass and goes before the next one is sent, so
memory is bounded at any size and the work is that of the blocks' sizes; items don't
depend on each other, so blocks don't show in the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.llm.wordhash import Words, mix, words_of
from sparrowmill.storage import drop_written, table, written

MASKS = ("11111", "1101011", "1110111", "11010101", "1011011", "110011001")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
LONG, SHORT = 12, 5
MIN_WORDS = 12
PENALTY = 4
BROADCAST_BYTES = 8 << 20
#: So many pairs of equal seeds of one text are formed at a time; where one seed alone has more, its alignments come from a convolution.
PAIRS, HEAVY = 1 << 22, 1 << 16
_HINT_BITS = 18
_LETTERS = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _LETTERS[_b] = _b
_ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_NAMES = ["doc_id", "item_id", "start_word", "n_words", "n_matched"]
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, n_matched long"


@lru_cache(maxsize=1)
def _word_pattern():
    import regex

    return regex.compile(rf"(?V1)[{_ALONE}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{_ALONE}]]+")


def _spaced(text: str | None) -> bytes:
    text = (text or "").lower()
    return (text if text.isascii() else " ".join(_word_pattern().findall(text))).encode()


def _words(texts: list[str | None]) -> Words:
    return words_of([_spaced(t) for t in texts], _LETTERS)


def _offsets(mask: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))


def _seed(hashes: np.ndarray, at: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    total = np.full(len(at), salt + 1, np.uint64)
    for o in offsets:
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[at + o]
    return mix(total)


def _seeds(words: Words, texts: np.ndarray, masks: tuple[str, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all windows of the texts marked, and the windows' first words."""
    owner, seeds, places = words.owner(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, mask in enumerate(masks):
        at = np.flatnonzero(words.room(len(mask)) & texts[owner])
        seeds.append(_seed(words.hashes, at, _offsets(mask), salt + k))
        places.append(at)
    return np.concatenate(seeds), np.concatenate(places)


def _whole(words: Words) -> np.ndarray:
    """One hash for each text of fewer than SHORT words, all of them in order; 0 for longer and empty ones."""
    n = np.diff(words.first)
    out = np.zeros(len(n), np.uint64)
    for size in range(1, SHORT):
        own = np.flatnonzero(n == size)
        out[own] = _seed(words.hashes, words.first[own], np.arange(size), 1000 + size)
    return out


_GROUPS = ((MASKS, 0), (SHORT_MASKS, 100))


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The different values of p - q: where the product of two 0/1 polynomials isn't zero, so that no pairs are formed."""
    low, high = int(p.min()), int(q.max())
    x, y = np.zeros(int(p.max()) - low + 1), np.zeros(high - int(q.min()) + 1)
    x[p - low], y[high - q] = 1, 1
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    product = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[:n]
    return np.flatnonzero(product > 0.5) + low - high


class SeedIndex:
    """Items' words and, sorted, the seeds of all their windows."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        words = _words([t for _, t in items])
        self.hashes, self.first, self.owner = words.hashes, words.first, words.owner()
        n = np.diff(words.first)
        self.least = np.minimum(MIN_WORDS, -(-4 * n // 5))
        self.groups = []
        for (masks, salt), own in zip(_GROUPS, (n >= LONG, (n >= SHORT) & (n < LONG))):
            seed, place = _seeds(words, own, masks, salt)
            order = np.lexsort((place, seed))
            hint = np.zeros(1 << _HINT_BITS, bool)
            hint[self.hashes[own[self.owner]] >> np.uint64(64 - _HINT_BITS)] = True
            self.groups.append((masks, salt, seed[order], place[order], hint))
        whole = _whole(words)
        order = np.argsort(whole, kind="stable")
        self.whole, self.whole_item = whole[order], order

    def _hits(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of equal seeds in documents and, for each, where they begin and end among the index's (as one array of places)."""
        for masks, salt, seeds, places, hint in self.groups:
            if not len(seeds):
                continue
            known = hint[words.hashes >> np.uint64(64 - _HINT_BITS)]
            for k, mask in enumerate(masks):
                offsets = _offsets(mask)
                if len(words.hashes) < len(mask):
                    continue
                may = known[: len(words.hashes) - len(mask) + 1].copy()
                for o in offsets[1:]:
                    may &= known[o : o + len(may)]
                at = np.flatnonzero(may)
                at = at[words.room(len(mask))[at]]
                seed = _seed(words.hashes, at, offsets, salt + k)
                lo, hi = np.searchsorted(seeds, seed, "left"), np.searchsorted(seeds, seed, "right")
                yield at[hi > lo], lo[hi > lo], hi[hi > lo], places

    def alignments(self, words: Words) -> np.ndarray:
        """Rows (text, item, shift): each item word w may stand at the document's word w + shift."""
        text_of, m, items = words.owner(), len(self.hashes), len(self.ids)
        width = len(words.hashes) + m + 1
        found = [np.zeros(0, np.int64)]

        def add(text: np.ndarray, item: np.ndarray, shift: np.ndarray) -> None:
            found.append(np.unique((text * items + item) * width + shift + m))

        for at, lo, hi, places in self._hits(words):
            if not len(at):
                continue
            _, group, size = np.unique(text_of[at] * (m * 16 + 1) + lo, return_inverse=True, return_counts=True)
            n = hi - lo
            heavy = size[group] * n > HEAVY
            for g in np.unique(group[heavy]):
                own = np.flatnonzero(group == g)
                q = places[lo[own[0]] : hi[own[0]]]
                for item in np.unique(self.owner[q]):
                    shift = _differences(at[own], q[self.owner[q] == item])
                    add(np.full(len(shift), text_of[at[own[0]]]), np.full(len(shift), item), shift)
            at, lo, n = at[~heavy], lo[~heavy], n[~heavy]
            total, begin = np.cumsum(n), 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
                k = n[begin:end]
                q = places[np.repeat(lo[begin:end], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                p = np.repeat(at[begin:end], k)
                add(text_of[p], self.owner[q], p - q)
                begin = end
        key = np.unique(np.concatenate(found))
        return np.stack([key // width // items, key // width % items, key % width - m], 1) if len(key) else np.zeros((0, 3), np.int64)

    def search(self, texts: list[str | None]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item_id, first word, words, equal words): the verified stretches, of those that overlap in the text the best."""
        words = _words(texts)
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, w, shift in self.alignments(words).tolist():
            lo, hi = max(self.first[w], words.first[t] - shift), min(self.first[w + 1], words.first[t + 1] - shift)
            same = self.hashes[lo:hi] == words.hashes[lo + shift : hi + shift]
            if np.count_nonzero(same) < self.least[w]:
                continue
            a, b = _stretch(same)
            n = int(same[a:b].sum())
            if n >= self.least[w]:
                best.setdefault((t, w), []).append((-n, int(lo + shift + a - words.first[t]), b - a))
        out = [(t, w, start, size, n) for (t, w), x in best.items() for start, size, n in _apart(x)]
        whole = _whole(words)
        for t in np.flatnonzero(whole):
            same = slice(*np.searchsorted(self.whole, [whole[t], whole[t] + np.uint64(1)]))
            size = int(words.first[t + 1] - words.first[t])
            out += [(int(t), int(w), 0, size, size) for w in self.whole_item[same]]
        return [(t, self.ids[w], *rest) for t, w, *rest in sorted(out)]


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (-equal words, start, size) the best and all that overlap none taken before, as (start, size, equal words)."""
    if len(found) == 1:
        return [(found[0][1], found[0][2], -found[0][0])]
    taken, out = np.zeros(max(s + n for _, s, n in found), bool), []
    for n, start, size in sorted(found):
        if not taken[start : start + size].any():
            taken[start : start + size] = True
            out.append((start, size, -n))
    return sorted(out)


def _stretch(same: np.ndarray) -> tuple[int, int]:
    """The stretch with the most equal words of those with no more than one word in PENALTY + 1 exchanged; it begins and ends with equal ones."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    equal = np.concatenate([[0], np.cumsum(same)])
    first = np.searchsorted(-np.minimum.accumulate(total), -total, "left")  # for each end the first begin with no greater total
    end = int((equal - equal[first]).argmax())
    inside = first[end] + np.flatnonzero(same[first[end] : end])
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


@lru_cache(maxsize=1)
def _index(block) -> SeedIndex:
    return SeedIndex(block.value)


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with a word, each once; others match nothing."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").rlike(r"[\p{L}\p{M}\p{N}]")).distinct()


def _blocks(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Items with the number of their block, and how many blocks there are."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // most))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def _sent(items: DataFrame, block: int):
    rows = items.where(F.col("block") == block)
    return items.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows.collect()])


def _table(names: list, hits: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*((names[t], *rest) for t, *rest in hits))) or [[]] * 5
    return [pa.array(c, pa.int64()) for c in cols]


def _found(rows: DataFrame, sent) -> DataFrame:
    """The overlaps of rows (doc_id, text) with the items of a block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent)
        for batch in text_slices(batches):
            hits = index.search(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(_table(batch.column("doc_id").to_pylist(), hits), _NAMES)

    return map_texts(rows, find, SCHEMA)


def _without(documents: DataFrame, sent) -> DataFrame:
    """documents less those that hold an item of a block."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(sent)
        for batch in text_slices(batches):
            holds = {t for t, *_ in index.search(batch.column("text").to_pylist())}
            yield batch.filter(pa.array([k not in holds for k in range(batch.num_rows)], pa.bool_()))

    return map_texts(documents, keep, documents.schema)


def contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_matched: the overlaps of each document with each item found in it.

    Documents without overlap give no row. Null and empty texts hold and match
    nothing; repeated documents give repeated rows; repeated items count once. Rows
    with a null doc_id are reported with a null, and so are items with a null
    item_id, each text of them as an item of its own. Other columns aren't read.
    """
    items, n = _blocks(_items(benchmark), broadcast_bytes)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if n == 1:
        return _found(rows, _sent(items, 0))
    items, out = written(items, "items"), None
    for block in range(n):
        sent = _sent(items, block)
        part = written(_found(rows, sent), "overlaps")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents less those that hold an item, all columns as they are; null and empty texts stay."""
    items, n = _blocks(_items(benchmark), broadcast_bytes)
    if n == 1:
        return _without(documents, _sent(items, 0))
    items, left = written(items, "items"), documents
    for block in range(n):
        sent, before = _sent(items, block), left
        left = written(_without(before, sent), "clean")
        sent.destroy()
        if block:
            drop_written(before)
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
