"""Quality rules: counts within a document, and how often its lines occur across documents.

A line is hashed after lower-casing and closing up white space. For each host
(the column source) the distinct documents that hold a line are counted. Lines
found in more than max_documents of a host are removed, and a document of
whose words less than min_left_percent stay is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.llm.wordhash import mix, windows, words_of
from sparrowmill.storage import drop_written, table, written

MAX_DOCUMENTS = 50
MIN_LEFT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WHITE = " \t\n\x0b\x0c\r"


def _repeat_words(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words, and words inside windows that occur twice or more in that text."""
    words = words_of(encoded)
    n, owner = len(words.hashes), words.owner()
    begin = np.flatnonzero(words.room(WINDOW))
    h = windows(words.hashes, WINDOW)[begin] ^ mix(owner[begin].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, begin[twice], 1)
    np.add.at(turn, begin[twice] + WINDOW, -1)
    covered = np.cumsum(turn[:-1]) > 0
    size = len(encoded)
    return np.diff(words.first), np.bincount(owner[covered], minlength=size)


def _lines(text: str) -> tuple[int, list[int], list[int]]:
    """Lines with a word that equal an earlier line; hashes of the different normalised lines and the words under each."""
    import xxhash

    seen, repeats, weight = set(), 0, {}
    for line in text.split("\n"):
        words = line.lower().encode().split()
        if not words:
            continue
        repeats += line in seen
        seen.add(line)
        h = xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
        weight[h] = weight.get(h, 0) + len(words)
    return repeats, list(weight), list(weight.values())


def text_measures(documents: DataFrame) -> DataFrame:
    """doc_id, host, text_key, the five counts, and lines: array of (line, words), for each input row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
        for batch in text_slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            encoded = [t.encode() for t in texts]
            n_words, n_repeat = _repeat_words(encoded)
            found = [_lines(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("host"),
                    pa.array([xxhash.xxh3_128_digest(x) for x in encoded], pa.binary()),
                    pa.array(n_words),
                    pa.array([len(t) - sum(map(t.count, _WHITE)) for t in texts], pa.int64()),
                    pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array(n_repeat),
                    pa.array([[{"line": a, "words": b} for a, b in zip(x[1], x[2])] for x in found], kind),
                ],
                ["doc_id", "host", "text_key", *COUNTS, "lines"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("text").cast("string"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return map_texts(rows, measure, f"doc_id long, host string, text_key binary, {counts}, lines array<struct<line long, words long>>")


def quality_rules(documents: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, one row for each input row; also words_removed.

    Null texts count as empty and fail (no 20 words); a null source is the host "".
    Repeated rows (equal doc_id and text) get the same verdict each and count as one
    document; null ids count as one id. Other columns aren't read; an empty table gives no rows.
    """
    measured = written(text_measures(documents), "measures")
    lines = measured.select("host", "text_key", F.explode("lines").alias("x")).groupBy("host", "text_key", F.col("x.line").alias("line")).agg(F.min("x.words").alias("words"))
    lines = written(lines, "lines")
    documents_of = measured.select("host", "text_key", "doc_id").distinct().groupBy("host", "text_key").agg(F.count(F.lit(1)).alias("documents"))
    documents_of = written(documents_of, "documents_of")
    held = lines.join(documents_of, ["host", "text_key"]).groupBy("host", "line").agg(F.sum("documents").alias("n"))
    common = held.where(F.col("n") > max_documents).select("host", "line")
    common = written(common, "common")  # stored, as a join can split a hot line or text only if no aggregate stands on its side
    gone = written(lines.join(common, ["host", "line"]).groupBy("host", "text_key").agg(F.sum("words").alias("words_removed")), "gone")
    drop_written(lines)
    drop_written(common)
    drop_written(documents_of)
    judged = measured.drop("lines").join(gone, ["host", "text_key"], "left")
    removed = F.coalesce("words_removed", F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left_enough = 100 * (F.col("n_words") - removed) >= min_left_percent * F.col("n_words")
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & left_enough).alias("kept"), removed.alias("words_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: max_documents and min_left_percent as above; lines by their normalised text.
ORACLE = f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select doc_id, host, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from d),
base as (select doc_id, host, text, words, len(words)::bigint as n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols from w),
lines as (select doc_id, host, text, i, line, array_to_string(list_filter(regexp_split_to_array(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' ') as norm
  from (select doc_id, host, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d)),
worded as (select *, len(string_split(norm, ' '))::bigint as words from lines where norm <> ''),
dups as (select doc_id, count(*) - count(distinct line) as n_dup_lines from worded group by doc_id),
common as (select host, norm from worded group by host, norm having count(distinct (doc_id, text)) > {MAX_DOCUMENTS}),
gone as (select doc_id, sum(words)::bigint as words_removed from worded join common using (host, norm) group by doc_id),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as t from (select doc_id, words, unnest(range(1, n_words - 6)) as i from base where n_words >= 8)),
rep as (select doc_id, t from win group by doc_id, t having count(*) > 1),
cov as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select win.doc_id, unnest(range(win.i, win.i + 8)) as p from win join rep using (doc_id, t)) group by doc_id),
f as (select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(words_removed, 0)::bigint as words_removed
  from base left join dups using (doc_id) left join cov using (doc_id) left join gone using (doc_id)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * (n_words - words_removed) >= {MIN_LEFT_PERCENT} * n_words as kept, words_removed from j
"""
