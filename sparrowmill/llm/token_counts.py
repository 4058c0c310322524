"""Token counts by a finite-state tokenizer (see bpe_fst)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparrowmill.storage import table

LIMIT = 2048
BATCH_CHARS = 2 << 20
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each has about so many bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        lo = total = 0
        for hi, n in enumerate(sizes):
            if total and total + n > chars:
                yield batch.slice(lo, hi - lo)
                lo, total = hi, 0
            total += n
        if lo < len(sizes):
            yield batch.slice(lo)


def map_texts(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """rows.mapInArrow with batches of BATCH_ROWS rows in this session, unless it has a number of its own.

    Texts make rows large: the usual 10000 of them in one batch cost each task
    tens of megabytes on either side of the pipe to Python.
    """
    spark = rows.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return rows.mapInArrow(function, schema)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a byte-pair vocabulary file of the tokenizers library, on every executor.
    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids
    stay as they are, one result each; other columns aren't read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparrowmill.llm.bpe_fst import transducer

        fst = transducer(path)
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            n_tokens = fst.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_texts(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
