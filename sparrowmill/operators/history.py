"""The history of hashes against which batches of new rows are checked for duplicates.

The store is a table of versions dealt into buckets by the hash's first digits. Each
bucket has a Bloom filter, which grows with it. A batch's different hashes ask the filters
of their buckets first; only those that may be known are looked up in the buckets, and
only buckets that hold such hashes are opened. New hashes are appended to their buckets and
entered in the filters, so a batch costs what it touches, not what was seen before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.storage import drop_written, written
from sparrowmill.versioned import VersionedTable

#: Bits for each hash and how many of them are set: about one new hash in 120 is taken for known.
BITS, PROBES = 10, 7


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """PROBES bits of a filter of size bits (a power of two) for each pair of hashes."""
    a, b = hashes[:, 0], hashes[:, 1] | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(size - 1)


class Bloom:
    """A filter as bytes; sized for capacity hashes and made anew, twice as large, by its owner when it holds more."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def sized(cls, capacity: int) -> Bloom:
        return cls(np.zeros((1 << max(10, (capacity * BITS - 1).bit_length())) // 8, np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        at = _places(hashes, len(self.bits) * 8).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, len(self.bits) * 8)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _pairs(rows: pa.Table) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in ("h0", "h1")], 1).view(np.uint64)


class HashHistory:
    """Two tables of versions below path: hashes and filters.

    digits: so many hex digits of a hash name its bucket, always the same for one path. A bucket's
    filter is handled in one task: at ten billion hashes three digits make filters of 4 MB.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 1):
        self.spark, self.digits = spark, digits
        self.hashes = VersionedTable(spark, f"{path}/hashes", "bucket")
        self.filters = VersionedTable(spark, f"{path}/filters", "bucket")

    def _bucket(self) -> Column:
        return F.substring("hash", 1, self.digits)

    def _filters(self) -> DataFrame:
        """The newest filters. Where a writer stored filters and then failed they know too much, which costs a look-up but no right answer."""
        now = self.filters.snapshot()
        return self.filters.read(now) if now.version else self.spark.createDataFrame([], "bucket string, n long, bits binary")

    def known(self, fresh: DataFrame) -> DataFrame:
        """Those hashes of fresh (different ones) that the history holds."""
        now = self.hashes.snapshot()
        if not now.version:
            return fresh.select("hash").limit(0)
        asked = fresh.select("hash", self._bucket().alias("bucket"), F.xxhash64("hash").alias("h0"), F.xxhash64("hash", F.lit(1)).alias("h1"))

        def probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
            if not rows.num_rows or not filters.num_rows:
                return rows.slice(0, 0).select(["hash", "bucket"])
            bits = np.frombuffer(filters.column("bits")[0].as_py(), np.uint8)
            return rows.filter(pa.array(Bloom(bits).may_hold(_pairs(rows)))).select(["hash", "bucket"])

        stored = self._filters().select(F.col("bucket").alias("of"), "bits")
        likely = written(asked.groupBy("bucket").cogroup(stored.groupBy("of")).applyInArrow(probe, "hash string, bucket string"), "likely")
        touched = [r[0] for r in likely.select("bucket").distinct().collect()]  # at most 16 ** digits
        return likely.select("hash").join(self.hashes.read(now, touched).select("hash"), "hash", "left_semi")

    def flag(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """rows (with hash) and is_duplicate: known before, or seen earlier in the batch in the order given. Null hashes are no duplicates."""
        known = written(self.known(rows.select("hash").where("hash is not null").distinct()), "known").withColumn("_known", F.lit(True))
        first = Window.partitionBy("hash").orderBy(*order)
        late = F.when(F.col("hash").isNotNull(), F.row_number().over(first) > 1).otherwise(False)
        return rows.join(known, "hash", "left").withColumn("is_duplicate", F.col("_known").isNotNull() | late).drop("_known").select(*rows.columns, "is_duplicate")

    def add(self, rows: DataFrame) -> int:
        """Enter the hashes of rows (those known already too); returns the version. Filters are stored first, so that hashes never lack theirs."""
        base = self.hashes.snapshot()
        fresh = rows.select("hash").where("hash is not null").distinct()
        new = written(fresh.join(self.known(fresh).withColumnRenamed("hash", "_old"), F.col("hash") == F.col("_old"), "left_anti").withColumn("bucket", self._bucket()), "new_hashes")
        marks = new.select("bucket", F.xxhash64("hash").alias("h0"), F.xxhash64("hash", F.lit(1)).alias("h1"), F.lit(False).alias("old"))
        newest, stored = self.filters.snapshot(), self._filters()
        held = {r["bucket"]: r["n"] for r in stored.select("bucket", "n").collect()}  # at most 16 ** digits
        grown = {r["bucket"]: held.get(r["bucket"], 0) + r["count"] for r in marks.groupBy("bucket").count().collect()}
        full = [b for b in grown if b in held and Bloom.sized(grown[b]).bits.size > Bloom.sized(held[b]).bits.size]
        if full and base.version:  # outgrown filters are made anew from their bucket
            again = self.hashes.read(base, full).select("bucket", F.xxhash64("hash").alias("h0"), F.xxhash64("hash", F.lit(1)).alias("h1"), F.lit(True).alias("old"))
            marks = marks.unionByName(again)

        def enter(key: tuple, rows_: pa.Table, filters: pa.Table) -> pa.Table:
            name, n = key[0].as_py(), int((~rows_.column("old").to_numpy(zero_copy_only=False)).sum())
            total = n + (filters.column("n")[0].as_py() if filters.num_rows else 0)
            if filters.num_rows and name not in full:
                bloom = Bloom(np.frombuffer(filters.column("bits")[0].as_py(), np.uint8).copy())
            else:
                bloom = Bloom.sized(total)
            if rows_.num_rows:
                bloom.add(_pairs(rows_))
            return pa.table({"bucket": [name], "n": pa.array([total], pa.int64()), "bits": pa.array([bloom.bits.tobytes()], pa.binary())})

        touched = stored.join(marks.select("bucket").distinct(), "bucket", "left_semi").select(F.col("bucket").alias("of"), "n", "bits")
        made = marks.groupBy("bucket").cogroup(touched.groupBy("of")).applyInArrow(enter, "bucket string, n long, bits binary")
        self.filters.replace(made, newest)
        done = self.hashes.append(new, base)
        drop_written(new)
        return done.version
