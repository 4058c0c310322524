"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both token lists of a text cover the same bytes (a space and the text). Their
cumulative ends are merged by two pointers: where both end, a group ends; every
stretch between neighbouring ends lies in one token of either side, which is a link.

Texts are first cut at single spaces between visible characters. Neither tokenizer
has a token over such a place, so both end there, and the pieces between are aligned
by themselves: each different piece of a batch once. Tokenizers for which that
doesn't hold get whole texts.

1. Each batch stores its documents with the pairs of token ids that they link, as
   places in the batch's list of different pairs, and once that list with counts.
2. The lists are summed to counts of pairs over the corpus, and joined with
   the greatest count of either side's id.
3. Each batch looks its list up in them, and the documents take their sums from it.
   A frequent pair thus is one row a batch, not one a document.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.storage import table, written

BATCH_CHARS = 4 << 20
_VISIBLE = r"[\w!-/:-@\[-`{-~]"
_CUT = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")
_WHOLE = re.compile(r"(?!)")
_ENDS_VISIBLE = re.compile(f"{_VISIBLE}(?:.*{_VISIBLE})?", re.DOTALL)
#: So many pieces are put together again for one call of a tokenizer.
TOGETHER = 256
_SPACE = "▁"
_STORED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, times array<int>, batch long, pairs array<long>, totals array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_a long, count_sum long, groups_sha256 string"


def _byte_level() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both tokenizers with the bytes of each id; cut tells where texts may be cut for both."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    cut: re.Pattern
    #: Each id of a before a comma, then before a bar, each of b before a comma, then before a semicolon.
    written: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for size, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")):
            for mark in marks:
                self.written += [f"{i}{mark}" for i in range(size)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of a and b of each text with a space before it, and whether both give its bytes back."""
        first = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        second = self.b.encode(texts, num_threads=1)
        said = [b" " + t.encode() for t in texts]
        right = [b"".join(map(self.a_bytes.__getitem__, x)) == w == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, w in zip(first, second, said)]
        return first, second, right


@functools.lru_cache(maxsize=2)
def tokenizers_at(path_a: str, path_b: str) -> Tokenizers:
    import json
    import os

    import sentencepiece

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = _byte_level()
    a_bytes = [b""] * a.get_vocab_size()
    for word, k in a.get_vocab().items():
        a_bytes[k] = bytes(letters[c] for c in word) if set(word) <= letters.keys() else word.encode()
    pieces = [b.id_to_piece(k) for k in range(len(b))]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
    before = json.loads(a.to_str())["pre_tokenizer"] or {}
    splits = before.get("type") == "ByteLevel" and before.get("use_regex") and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
    return Tokenizers(a, b, a_bytes, b_bytes, _CUT if splits else _WHOLE)


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising lists with the same last end: for each different end the token of a and of b that ends there or goes on, and whether both end.

    The two-pointer merge for whole arrays: the places of either list in the other are where the pointers stand.
    """
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return at_a, at_b, (ends_a[at_a] == ends) & (ends_b[at_b] == ends) if len(ends) else np.zeros(0, bool)


@dataclass
class Pieces:
    """Alignments of different pieces; links[first[k]:first[k + 1]] are those of piece k, as a's id * 2**32 + b's id."""

    right: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    links: np.ndarray
    first: np.ndarray


def _encoded(t: Tokenizers, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a and of b for all pieces, one after another in an order of their own, that order, and which pieces came right.

    Pieces with visible ends are put together by spaces, where both tokenizers part them again.
    """
    whole = t.cut is _WHOLE
    joined = [] if whole else [k for k, p in enumerate(pieces) if _ENDS_VISIBLE.fullmatch(p)]
    blocks = [joined[lo : lo + TOGETHER] for lo in range(0, len(joined), TOGETHER)]
    ids_a, ids_b, right = t.encode([" ".join(map(pieces.__getitem__, b)) for b in blocks])
    alone = sorted(set(range(len(pieces))) - {k for b, r in zip(blocks, right) if r for k in b})
    more_a, more_b, fine = t.encode([pieces[k] for k in alone])
    ids_a, ids_b = ([x for x, r in zip([*u, *v], [*right, *fine]) if r] for u, v in ((ids_a, more_a), (ids_b, more_b)))
    order = [k for b, r in zip(blocks, right) if r for k in b] + [k for k, r in zip(alone, fine) if r]
    came_right = np.zeros(len(pieces), bool)
    came_right[order] = True
    flat = lambda x: np.fromiter((i for one in x for i in one), np.int64, sum(map(len, x)))
    return flat(ids_a), flat(ids_b), np.array(order, np.int64), came_right


def align(t: Tokenizers, pieces: list[str]) -> Pieces:
    """Aligned pieces, each with a space before it; right: both sides' bytes are the piece's (others have nothing)."""
    all_a, all_b, order, right = _encoded(t, pieces)
    size = len(order)
    ends = np.cumsum(np.fromiter((len(pieces[k].encode()) + 1 for k in order.tolist()), np.int64, size))
    width_a, width_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (t.a_bytes, t.b_bytes))
    ends_a, ends_b = np.cumsum(width_a[all_a]), np.cumsum(width_b[all_b])
    at_a, at_b, both = merge_ends(ends_a, ends_b)
    owner = np.searchsorted(ends, ends_a[at_a] if len(at_a) else ends_a)
    last = np.flatnonzero(both)  # the last stretch of each group
    upto_a, upto_b = (np.concatenate([[0], x[last] + 1]) for x in (at_a, at_b))
    # Ids as they are written: group by group, a's before b's.
    code_a, code_b = all_a.copy(), all_b + 2 * len(width_a)
    code_a[upto_a[1:] - 1] += len(width_a)
    code_b[upto_b[1:] - 1] += len(width_b)
    code = np.zeros(len(all_a) + len(all_b), np.int64)
    code[np.arange(len(all_a)) + np.repeat(upto_b[:-1], np.diff(upto_a))] = code_a
    code[np.arange(len(all_b)) + np.repeat(upto_a[1:], np.diff(upto_b))] = code_b
    words = list(map(t.written.__getitem__, code.tolist()))
    n_a, n_b = np.diff(np.searchsorted(ends_a, ends, "right"), prepend=0), np.diff(np.searchsorted(ends_b, ends, "right"), prepend=0)
    upto = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    texts = ["".join(words[lo:hi]) for lo, hi in zip(upto, upto[1:])]
    # Back to the pieces' own order; those that didn't come right have nothing.
    back = np.argsort(order, kind="stable")
    n_links = np.bincount(owner, minlength=size)
    began = np.cumsum(n_links) - n_links
    spread = lambda x: np.bincount(order, weights=x, minlength=len(pieces)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(spread(n_links))])
    place = np.repeat(began[back], n_links[back]) + np.arange(n_links.sum()) - np.repeat(np.cumsum(n_links[back]) - n_links[back], n_links[back])
    groups = [""] * len(pieces)
    for k, text in zip(order.tolist(), texts):
        groups[k] = text
    return Pieces(right, spread(n_a), spread(n_b), spread(np.bincount(owner[last], minlength=size)), groups, ((all_a[at_a] << 32) | all_b[at_b])[place], first)


def _spread(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places first[k]:first[k + 1] for each k of which, one after another."""
    sizes = first[which + 1] - first[which]
    return np.arange(sizes.sum()) + np.repeat(first[which] - np.cumsum(sizes) + sizes, sizes)


def _sums(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sums of values[upto[k]:upto[k + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[upto[1:]] - total[upto[:-1]]


def _batch(t: Tokenizers, batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    index: dict[str, int] = {}
    own: list[list[int]] = []
    for text in batch.column("text").to_pylist():
        own.append([index.setdefault(p, len(index)) for p in t.cut.split(text)] if text else [])
    pieces = align(t, list(index))
    right = pieces.right.tolist()
    own = [o if all(map(right.__getitem__, o)) else [] for o in own]
    upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])
    flat = np.array([k for o in own for k in o], np.int64)
    # Different pieces of a document with their number, then their links.
    size = max(len(index), 1)
    key, times = np.unique(np.repeat(np.arange(len(own)), np.diff(upto)) * size + flat, return_counts=True)
    pairs, places = np.unique(pieces.links, return_inverse=True)
    n_links = np.diff(pieces.first)
    links = places[_spread(pieces.first, key % size)]
    documents, weight = np.repeat(key // size, n_links[key % size]), np.repeat(times, n_links[key % size])
    both, inverse = np.unique(documents * max(len(pairs), 1) + links, return_inverse=True)
    weight = np.bincount(inverse, weights=weight, minlength=len(both)).astype(np.int64)
    links = both % max(len(pairs), 1)
    totals = np.bincount(links, weights=weight, minlength=len(pairs)).astype(np.int64)
    offsets = np.searchsorted(both // max(len(pairs), 1), np.arange(len(own) + 1))
    sha = [hashlib.sha256("".join(map(pieces.groups.__getitem__, o))[:-1].encode()).hexdigest() if o else "" for o in own]
    used = np.flatnonzero(totals)  # pieces of documents without tokens may have pairs too
    renumber = np.cumsum(totals > 0) - 1
    once = [len(used)] + [0] * (len(own) - 1)
    carried = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(once)]), pa.int32()), pa.array(x, pa.int64()))
    listed = lambda x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32()))
    columns = [
        batch.column("doc_id"), *(pa.array(_sums(x[flat], upto)) for x in (pieces.n_a, pieces.n_b, pieces.n_groups, n_links)), pa.array(sha), listed(renumber[links]), listed(weight),
        pa.array(np.full(len(own), number, np.int64)), carried(pairs[used]), carried(totals[used]),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STORED.split(", ")])


def _looked_up(documents: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a batch with sums over their links; found: the batch's pairs with their counts."""
    place = found.column("place").to_numpy()
    size = len(place)
    count, best_a, best_b = (np.zeros(size, np.int64) for _ in range(3))
    for out, name in ((count, "count"), (best_a, "best_a"), (best_b, "best_b")):
        out[place] = found.column(name).to_numpy()
    links, times = (documents.column(c).combine_chunks() for c in ("links", "times"))
    upto = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
    links, times = (x.flatten().to_numpy().astype(np.int64) for x in (links, times))
    sums = {"n_best": times * best_b[links], "n_best_a": times * best_a[links], "count_sum": times * count[links]}
    held = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | {c: pa.array(_sums(x, upto)) for c, x in sums.items()}
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.table([held[c] for c in names], names)


def aligned(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its links, and each batch's different pairs on the batch's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, task = tokenizers_at(path_a, path_b), TaskContext.get().partitionId()
        for number, batch in enumerate(text_slices(batches, chars=BATCH_CHARS)):
            yield _batch(t, batch, (task << 32) | number)

    return map_texts(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _STORED)


def pair_counts(stored: DataFrame) -> DataFrame:
    """pair (a's id * 2**32 + b's id), count, best_a, best_b (1 if no pair with the same id of that side is more frequent)."""
    lists = stored.where("size(pairs) > 0").select(F.explode(F.arrays_zip("pairs", "totals")).alias("x"))
    counts = written(lists.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("count")), "pair_counts")
    sides = {"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))}
    out = counts.select("*", *[s.alias(f"id_{k}") for k, s in sides.items()])
    for k in sides:
        most = out.groupBy(f"id_{k}").agg(F.max("count").alias(f"most_{k}"))
        out = out.join(most, f"id_{k}")
    return out.select("pair", "count", *[(F.col("count") == F.col(f"most_{k}")).cast("int").alias(f"best_{k}") for k in sides])


def align_tokenizers(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links that are the most frequent of their B id), n_best_a (of their A id), count_sum, groups_sha256.

    path_a: a byte-level vocabulary of the tokenizers library, path_b: a model of
    sentencepiece that puts a space before texts; both on every executor. Null and
    empty texts, and those whose tokens don't give their bytes back, have zeros and
    an empty groups_sha256. Repeated rows and null ids stay, one result each, and
    count each time; other columns aren't read; an empty table gives no row.
    """
    stored = written(aligned(documents, path_a, path_b), "aligned")
    counts = written(pair_counts(stored), "pairs")
    lists = stored.where("size(pairs) > 0").select(F.col("batch").alias("of_batch"), F.posexplode("pairs").alias("place", "pair"))
    found = lists.join(counts, "pair").select("of_batch", "place", "count", "best_a", "best_b")
    rows = stored.drop("pairs", "totals")
    return rows.groupBy("batch").cogroup(found.groupBy("of_batch")).applyInArrow(_looked_up, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
