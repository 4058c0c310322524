"""Substring dedup: factors that occurred earlier in the corpus are cut from documents.

Each document is parsed, as in relative Lempel-Ziv coding, into factors copied from
the text before it (smaller doc_id, or earlier in the document) and literals. The
reference is the whole corpus, indexed by anchors: of the fifteen 6-word grams in a
window of 20 words the one with the least hash, so equal windows have equal anchors
wherever they are. The index is dealt out by anchor; a look-up in it asks every
reference block at once, instead of one block after another. Neighbouring windows
with one anchor are a cell, about seven windows.

1. Anchors that occur once drop out (a count with map-side sums).
2. Of the other cells, all but the first of equal ones are copies: each is given the
   place of the first one in the reference.
3. Where an anchor has different cells, which is at factor boundaries, the first
   ones are checked window by window: a window's first place is kept, later ones
   are copies of it.
4. Each document is parsed greedily: copies whose places go on in step extend each
   other to matches as long as they go, at each word the match that reaches
   furthest becomes the next factor, and the parse goes on at its end. What no match
   of 20 words or more covers is literal. Factors are cut.

A match ends where the reference's own text turns out to be a copy of something
earlier, as places are always first ones; the next factor then starts there.

Every hash that decides is compared together with its anchor, 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.llm.wordhash import Words, _power, mix, windows, words_of
from sparrowmill.storage import drop_written, table, written

WIDTH = 20
GRAM = 6
NULL_ID = (1 << 63) - 1


def _span_sums(h: np.ndarray) -> np.ndarray:
    up, _ = _power(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return sums


def _span_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of the words a to b - 1, with a number of its own mixed in."""
    _, down = _power(len(sums))
    return mix((sums[b] - sums[a]) * down[a] ^ mix(salt.astype(np.uint64) + np.uint64(1)))


def _leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of g[i:i + width], the first of equals; the last width - 1 are unused."""
    value, place, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        have += step
    return place


def cells(words: Words) -> tuple[np.ndarray, ...]:
    """anchor, cell, text, start (word of the text) and windows of each cell, for all texts of 20 words or more."""
    starts = np.flatnonzero(words.room(WIDTH))
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    g = windows(words.hashes, GRAM)
    anchor = _leftmost_least(g, WIDTH - GRAM + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    a, at = starts[first], anchor[first]
    cell = _span_hash(_span_sums(words.hashes), a, a + count - 1 + WIDTH, (at - a) << 8 | count)
    text = np.searchsorted(words.first, a, "right") - 1
    return g[at], cell, text, a - words.first[text], count


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, doc (the same, nulls as the largest long), mark (32 bits of the text's hash) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return documents.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark"), text.alias("text"))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        anchor = cells(words_of([t.encode() for t in batch.column("text").to_pylist()]))[0]
        yield pa.RecordBatch.from_arrays([_signed(anchor)], ["anchor"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place: the cell's first word, its windows less one in 4 bits, and the text's mark."""
    for batch in text_slices(batches):
        anchor, cell, text, start, count = cells(words_of([t.encode() for t in batch.column("text").to_pylist()]))
        doc, mark = batch.column("doc").to_numpy()[text], batch.column("mark").to_numpy()[text]
        place = start << 36 | (count - 1) << 32 | mark
        yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(cell), pa.array(doc), pa.array(place)], ["anchor", "cell", "doc", "place"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted cells: anchor, the window's hash, doc, start and mark."""
    for batch in text_slices(batches):
        words = words_of([t.encode() for t in batch.column("text").to_pylist()])
        wanted = batch.column("wanted")
        each = wanted.value_lengths().to_numpy()
        anchor = wanted.flatten().field("anchor").to_numpy()
        place = wanted.flatten().field("place").to_numpy()
        text = np.repeat(np.arange(batch.num_rows), each)
        count = (place >> 32 & 15) + 1
        which = np.repeat(np.arange(len(place)), count)
        start = (place >> 36)[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a = start + words.first[text[which]]
        h = _span_hash(_span_sums(words.hashes), a, a + WIDTH, np.zeros(len(a)))
        cols = [pa.array(anchor[which]), _signed(h), pa.array(batch.column("doc").to_numpy()[text[which]]), pa.array(start), pa.array(batch.column("mark").to_numpy()[text[which]])]
        yield pa.RecordBatch.from_arrays(cols, ["anchor", "window", "doc", "start", "mark"])


def parse(start: np.ndarray, count: np.ndarray, from_doc: np.ndarray, from_start: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The greedy factors (start, words, document and word they are copied from) of a text, from copies (of count windows each)."""
    order = np.lexsort((from_start, from_doc, start))
    start, count, from_doc, from_start = (x[order] for x in (start, count, from_doc, from_start))
    goes_on = (start[1:] <= start[:-1] + count[:-1]) & (from_doc[1:] == from_doc[:-1]) & (from_start[1:] - start[1:] == from_start[:-1] - start[:-1])
    first = np.flatnonzero(np.append(True, ~goes_on))
    end = np.maximum.reduceat(start + count - 1 + WIDTH, first)
    out, at, k = [], 0, 0
    begin, reach, doc, shift = start[first].tolist(), end.tolist(), from_doc[first].tolist(), (from_start - start)[first].tolist()
    while k < len(begin):
        best, at = k, max(at, begin[k])
        while k < len(begin) and begin[k] <= at:  # of the matches that cover this word the one that reaches furthest
            best = k if reach[k] > reach[best] else best
            k += 1
        if reach[best] > at:
            out.append((at, reach[best] - at, doc[best], at + shift[best]))
            at = reach[best]
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "n_words", "from_doc", "from_start")]))
    for batch in text_slices(batches):
        n_words, kept, spans = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs")):
            words, factors = text.encode().split(), []
            if runs.is_valid and len(runs.values):
                factors = parse(*(runs.values.field(c).to_numpy() for c in ("start", "count", "from_doc", "from_start")))
            at, left = 0, []
            for start, n, *_ in factors:
                left += words[at:start]
                at = start + n
            n_words.append(len(words))
            kept.append(hashlib.sha256(b" ".join(left + words[at:] if factors else words)).hexdigest())
            spans.append([{"start": s, "n_words": n, "from_doc": None if d == NULL_ID else d, "from_start": p} for s, n, d, p in factors])
        removed = [sum(f["n_words"] for f in s) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"],
        )


def copies(documents: DataFrame) -> DataFrame:
    """doc, mark and copies: windows (count, from the word start on) that occurred earlier, and where they first did. A stored table."""
    texts, made = _keyed(documents), []

    def stored(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    repeated = map_texts(texts.select("text"), _anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    repeated = stored(repeated, "repeated")  # stored tables, as a join can split a hot anchor only if no aggregate stands on its side
    found = map_texts(texts.select("doc", "mark", "text"), _places, "anchor long, cell long, doc long, place long").join(repeated, "anchor", "left_semi")
    found = stored(found, "cells")
    firsts = stored(found.groupBy("anchor", "cell").agg(F.min(F.struct("doc", "place")).alias("first")), "firsts")
    again = found.join(firsts, ["anchor", "cell"])
    word, first_word = F.shiftright("place", 36), F.shiftright("first.place", 36)
    later = (F.col("doc") > F.col("first.doc")) | (word > first_word)
    mark = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark")
    count = (F.shiftright("place", 32).bitwiseAND(F.lit(15)) + 1).alias("count")
    copied = again.where(later).select("doc", mark, word.alias("start"), count, F.col("first.doc").alias("from_doc"), first_word.alias("from_start"))
    differ = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    differ = stored(differ, "differ")
    wanted = again.where(~later).join(differ, "anchor", "left_semi")
    wanted = wanted.groupBy("doc", mark).agg(F.collect_set(F.struct("anchor", "place")).alias("wanted"))  # a set: equal rows need what one of them needs
    checked = texts.select("doc", "mark", "text").join(wanted, ["doc", "mark"]).mapInArrow(_windows, "anchor long, window long, doc long, start long, mark long")
    checked = stored(checked, "windows")
    least = checked.groupBy("anchor", "window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    least = stored(least, "least")
    ends = checked.join(least, ["anchor", "window"]).where((F.col("doc") > F.col("first.doc")) | (F.col("start") > F.col("first.start")))
    both = copied.unionByName(ends.select("doc", "mark", "start", F.lit(1).cast("long").alias("count"), F.col("first.doc").alias("from_doc"), F.col("first.start").alias("from_start")))
    out = written(both.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "count", "from_doc", "from_start")).alias("copies")), "copies")
    for t in made:
        drop_written(t)
    return out


def substring_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and factors, which are cut: first word, length, and the document and word copied from.

    Words are runs of bytes other than ASCII white space; null texts have none.
    Windows are judged on the input. A window is cut if it also starts in a smaller
    doc_id or earlier in the same one; null ids come last, as one with the largest
    long. Rows that share a doc_id keep windows that start at the same word in both.
    Texts of fewer than 20 words lose nothing. Other columns aren't read.
    """
    texts = _keyed(documents).join(copies(documents), ["doc", "mark"], "left").select("doc_id", "text", F.col("copies").alias("runs"))
    return map_texts(texts, _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start: long, n_words: long, from_doc: long, from_start: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("factors")


#: The same result by the definition alone: every window of every text, first one stays.
ORACLE = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) as i from d where len(w) >= {WIDTH})),
again as (select doc_id, i from win qualify row_number() over (partition by t order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + {WIDTH})) as p from again),
each_word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from each_word anti join gone using (doc_id, p) group by doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id) left join n using (doc_id)
"""
