"""Tables of versions: a commit is a manifest that is written last, under a number that only one writer gets.

A version maps each part (a value of the part column, such as a quarter or a bucket of
hashes) to the folders that hold its rows. New data goes to new folders; a manifest
then names them together with the untouched folders of the version before. Readers
follow the newest manifest, so they see a version whole or not at all, and a reader of a
part opens only its folders. A writer that dies half-way leaves folders that no manifest names.
Two writers that start from one version want the same number: the second one's manifest
finds it taken, its data is deleted and it gets a Conflict.

Manifests are moved into place by Hadoop's rename that doesn't overwrite, which HDFS and
like stores carry out at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PART = "_part"


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


@dataclass(frozen=True)
class Snapshot:
    """version 0 is the table before its first commit; parts: folders of each part, below the table's; notes: small facts of the writer."""

    version: int
    parts: dict[str, list[str]] = field(default_factory=dict)
    schema: str | None = None
    notes: dict[str, object] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, part: str):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    # -- the file system ---------------------------------------------------------

    def _place(self, below: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")

    def _fs(self):
        place = self._place("manifests")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        fs, place = self._fs(), self._place(below)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def _delete(self, below: str) -> None:
        self._fs().delete(self._place(below), True)

    # -- reading -------------------------------------------------------------------

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one asked for."""
        if version is None:
            version = max((int(n[1:-5]) for n in self._names("manifests") if n.endswith(".json")), default=0)
        if version == 0:
            return Snapshot(0)
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/manifests/v{version:010d}.json").first()[0]
        return Snapshot(**json.loads(text))

    def read(self, snapshot: Snapshot | None = None, parts: Iterable[object] | None = None) -> DataFrame:
        """The rows of a version (else the newest), of some parts only where they are given; a version without rows needs a commit before for its columns."""
        snapshot = snapshot or self.snapshot()
        if snapshot.schema is None:
            raise ValueError(f"{self.path} has no version yet")
        wanted = snapshot.parts if parts is None else {str(p) for p in parts} & snapshot.parts.keys()
        folders = sorted(f"{self.path}/{f}" for p in wanted for f in snapshot.parts[p])
        schema = StructType.fromJson(json.loads(snapshot.schema))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # -- writing -------------------------------------------------------------------

    def _stored(self, rows: DataFrame) -> dict[str, list[str]]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_PART, F.col(self.part).cast("string")).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        prefix = f"{_PART}="
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n[len(prefix) :]): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith(prefix)}

    def _committed(self, base: Snapshot, rows: DataFrame, parts: dict[str, list[str]], new: dict[str, list[str]], notes: dict[str, object]) -> Snapshot:
        done = Snapshot(base.version + 1, parts, rows.schema.json(), {**base.notes, **notes})
        jvm = self.spark.sparkContext._jvm
        draft, final = self._place(f"manifests/.draft-{uuid.uuid4().hex}"), self._place(f"manifests/v{done.version:010d}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(done.__dict__).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs().delete(draft, False)
            for folder in {f.rpartition("/")[0] for folders in new.values() for f in folders}:
                self._delete(folder)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path}: version {done.version} is there already") from None
            raise
        return done

    def replace(self, rows: DataFrame, base: Snapshot, notes: dict[str, object] | None = None) -> Snapshot:
        """A version in which the parts that rows have hold rows alone, and all other parts what they held. Parts can't be null."""
        new = self._stored(rows)
        return self._committed(base, rows, {**base.parts, **new}, new, notes or {})

    def append(self, rows: DataFrame, base: Snapshot, notes: dict[str, object] | None = None) -> Snapshot:
        """A version with rows besides all others."""
        new = self._stored(rows)
        return self._committed(base, rows, {**base.parts, **{p: base.parts.get(p, []) + f for p, f in new.items()}}, new, notes or {})

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but for the newest keep and every folder that none of those names; returns how many folders went. No writer may be at work."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        held = {f for n in names[-keep:] for folders in self.snapshot(int(n[1:-5])).parts.values() for f in folders}
        for n in names[:-keep]:
            self._delete(f"manifests/{n}")
        gone = 0
        for run in self._names("data"):
            for part in self._names(f"data/{run}"):
                if part.startswith(f"{_PART}=") and f"data/{run}/{part}" not in held:
                    self._delete(f"data/{run}/{part}")
                    gone += 1
        return gone
