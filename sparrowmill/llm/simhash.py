"""SimHash near-duplicates found by multi-index hashing.

Fingerprints are first made distinct, so copies cost nothing afterwards. Two
fingerprints that differ in at most 3 bits differ in at most 1 bit of their upper
or of their lower 32 bits. Each fingerprint is entered in one table per half
under that half, and looks up the half's whole Hamming ball of radius 1 (33
values) there; the hits are verified on all 64 bits. Where the halves differ, only
the side whose bit is 0 probes; fingerprints with equal halves find each other from
both sides.

Links become components by rounds of contraction (see components), so long chains
take few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.components import components
from sparrowmill.llm.token_counts import map_texts, text_slices
from sparrowmill.storage import table, written

WIDTH = 3
SEED = 42
MAX_BITS = 3
HALF = 0xFFFFFFFF
NULL_ID = (1 << 63) - 1


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits: bit i is set if it is set in over half of the shingles' XXH64; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), (ends[width - 1 :] - 1).tolist())), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = WIDTH, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, the long columns keep and fp (the fingerprint's bits as a signed long) of each row; null text: no words."""
    keep = list(keep)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.fromiter((fingerprint(t, width) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *keep]), pa.array(fps.view(np.int64))], ["doc_id", *keep, "fp"])

    rows = documents.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string"))
    return map_texts(rows, sign, "doc_id long, " + "".join(f"{c} long, " for c in keep) + "fp long")



def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: distinct fingerprints that differ in 1 to max_bits (at most 3) bits.

    prints: a column fp of distinct longs. A half that differs in one bit is looked
    up from the side where that bit is 0 only, so the ball costs half the probes.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with balls of radius 1 find up to 3 differing bits")
    halves = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("half")), F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit(HALF)).alias("half")))).alias("h"))
    halves = halves.select("fp", (F.col("h.half") * 2 + F.col("h.part")).alias("key"))
    masks = F.array(*[F.lit(2 << k).cast("long") for k in range(32)])
    ball = F.concat(F.array("key"), F.transform(F.filter(masks, lambda m: F.col("key").bitwiseAND(m) == 0), lambda m: F.col("key").bitwiseOR(m)))
    probes = halves.select(F.col("fp").alias("a"), F.explode(ball).alias("key"))
    met = probes.join(halves.select(F.col("fp").alias("b"), "key"), "key")
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def groups(signed: DataFrame) -> DataFrame:
    """fp, root (the smallest linked fingerprint) and component_id (the smallest doc_id) for each fingerprint of signed (doc_id, fp)."""
    prints = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = components(links(prints.select("fp")))
    rooted = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # stored, so that a giant component's rows can be split
    return rooted.join(least, "root").select("fp", "root", "component_id")


def simhash_groups(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row for each input row.

    Null and empty texts have no words and the fingerprint zero, which links like
    any other. Rows without doc_id get a component but name none; where a whole
    component has no doc_id its component_id is null. Extra columns aren't read.
    """
    signed = written(fingerprints(documents, width), "fingerprints")
    joined = signed.join(groups(signed), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents with one row of each group: one with the group's smallest doc_id (null ids come last).

    Of different texts that share that doc_id the one with the smaller hash stays,
    of rows with equal doc_id and text the one whose columns have the smallest hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("hash")]
    columns = [F.col(f"`{c}`") for c in documents.columns]
    boxed = documents.select(*key, F.xxhash64(*columns).alias("of_row"), F.struct(*columns).alias("row"))
    signed = written(fingerprints(documents.select(*key, "text"), width, ["hash"]), "fingerprints")
    stays = signed.join(groups(signed), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("key")).select("key.*")
    once = boxed.groupBy("doc_id", "hash").agg(F.min_by("row", "of_row").alias("row"))
    kept = once.join(stays, ["doc_id", "hash"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
