"""A training corpus in five stages, from documents to packed sequences.

STAGES names them in order. Each takes (spark, docs, sf_dir) and returns a
DataFrame; the columns of documents come out of all but the last, whatever other
columns docs has. Each stage's result is written and read again as the next one's
docs, so a lost executor never costs more than the stage at work. Empty tables
pass through every stage.

1. toxicity: documents that the classifier rejects go.
2. near_dedup: of each group of linked fingerprints the smallest doc_id stays.
   Rows without doc_id form groups by fingerprint as others do, but one of them
   stays only where its whole group has no doc_id. Of rows that repeat a doc_id
   one stays.
3. decontamination: documents that hold a benchmark item go.
4. secret_scan: reported spans become [SECRET], and n_chars follows the text.
5. packing: the pieces of all documents with their place in a sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparrowmill.llm import decontamination, packing, secrets, simhash, toxicity
from sparrowmill.storage import table, written

TOKENIZER = "word_bpe_49k.json"


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among docs, predicts as toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxic_documents_out),
    ("near_dedup", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("secret_scan", secrets_out),
    ("packing", packed),
]

#: Training and packing have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
