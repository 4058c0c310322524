"""Centroid clustering in exact integers, with Hamerly's bounds.

Each vector keeps, in a table written a round, its centroid, an upper bound of the distance
to it and a lower bound of the distance to the second nearest one. When centroids
move, the upper bound grows by its centroid's drift and the lower one shrinks by
the greatest drift of the others. Where the upper bound stays below the lower one,
or below half the way to the nearest other centroid, the assignment can't have
changed. Otherwise the upper bound is made exact, and if that doesn't decide,
the vector is compared with all centroids in exact integers.

A batch's first row carries the batch's sums, so a round reads the vectors once and
the new centroids come from a column that is null but for one row a batch. Only
sums of k centroids come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.token_counts import map_texts
from sparrowmill.storage import drop_written, table, written

SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Components beyond this have squared distances that may not fit a long.
MOST = 1 << 27
#: Below this all sums of products are exact as doubles.
_EXACT = 1 << 20
_SLACK = 1e-9
_STATE = "vec_id long, x binary, cluster int, upper double, lower double, sums array<long>"


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x from each centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        xf, cf = x.astype(np.float64), centroids.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def own_squares(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), upper and lower bound, by looking at all."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    d = squares(x, centroids)
    cluster = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), cluster])
    if len(centroids) == 1:
        return cluster, upper, np.full(len(x), np.inf)
    return cluster, upper, np.sqrt(np.partition(d, 1, axis=1)[:, 1])


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.sqrt(((before - after) ** 2).sum(1)) * (1 + _SLACK)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds once centroids have moved from before to after, and how many vectors were scanned against all."""
    moved = drifts(before, after)
    k = len(after)
    others = np.array([max((moved[j] for j in range(k) if j != c), default=0.0) for c in range(k)])
    gaps = np.sqrt(squares(after, after).astype(np.float64)) + np.diag(np.full(k, np.inf))
    half = gaps.min(1) / 2
    cluster, upper, lower = cluster.copy(), upper + moved[cluster], lower - others[cluster]
    sure = lambda u, rows: u * (1 + _SLACK) + _SLACK < np.maximum(lower[rows], half[cluster[rows]]) * (1 - _SLACK)
    unsure = np.flatnonzero(~sure(upper, slice(None)))
    upper[unsure] = np.sqrt(own_squares(x[unsure], after, cluster[unsure]))
    unsure = unsure[~sure(upper[unsure], unsure)]
    cluster[unsure], upper[unsure], lower[unsure] = scan(x[unsure], after)
    return cluster, upper, lower, len(unsure)


def _sums(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, n_scanned: int) -> list[int]:
    """Per cluster its count, the sum of distances in two parts (so that it fits) and of components; then the number of scans."""
    out: list[int] = []
    distance = own_squares(x, centroids, cluster)
    for c in range(len(centroids)):
        rows = cluster == c
        d = distance[rows]
        out += [int(rows.sum()), int((d >> 31).sum()), int((d & 0x7FFFFFFF).sum()), *x[rows].sum(0).tolist()]
    return [*out, n_scanned]


def _state(vec_id: pa.Array, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, sums: list[int]) -> pa.RecordBatch:
    data = np.ascontiguousarray(x, np.int32)
    offsets = pa.array(np.arange(len(x) + 1) * (4 * x.shape[1]), pa.int32())
    packed = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(data.tobytes())])
    carried = pa.array([sums] + [None] * (len(x) - 1), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([vec_id, packed, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), carried], [c.split()[0] for c in _STATE.split(", ")])


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, size).astype(np.int64)


def kept_vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding of the vectors with size components, none null, non-finite or too large for exact distances."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST / scale))
    return embeddings.select(F.col("vec_id").cast("long"), e.alias("embedding")).where((F.size("embedding") == size) & finite)


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id, in that order (no id: last; equal ids: by components)."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(rank.asc_nulls_last(), "embedding").limit(k).collect()
    return np.floor(np.array([r["embedding"] for r in rows], np.float64) * scale).astype(np.int64)


def clusters(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and n_scanned (full scans of that round's vectors, in all rounds).

    embedding: arrays of numbers. Kept are those with exactly size components, none null or
    non-finite; a component beyond 2**27 / scale (131072), whose squared distances
    wouldn't fit a long, counts as such. Repeated rows and null ids stay, one
    result each; vectors without id are first centroids only if too few have one.
    With fewer than k vectors there are as many clusters; an empty table gives no
    row. Sums of distances that don't fit a long are null. Other columns aren't read.
    """
    spark, kept = embeddings.sparkSession, kept_vectors(embeddings, size, scale)
    centroids = first_centroids(kept, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_scanned long")

    def begin(batches: Iterator[pa.RecordBatch], after: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.floor(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * scale).astype(np.int64)
                cluster, upper, lower = scan(x, after)
                yield _state(b.column("vec_id"), x, cluster, upper, lower, _sums(x, cluster, after, len(x)))

    state, scanned = written(map_texts(kept, begin, _STATE), "vectors"), 0
    for done in range(rounds + 1):
        sums = {r["at"]: r["total"] for r in state.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("total")).collect()}
        width = 3 + size
        scanned += sums.get(len(centroids) * width, 0)
        counts = [sums[c * width] for c in range(len(centroids))]
        inertia = [(sums[c * width + 1] << 31) + sums[c * width + 2] for c in range(len(centroids))]
        after = np.array([[sums[c * width + 3 + i] // counts[c] for i in range(size)] if counts[c] else centroids[c].tolist() for c in range(len(centroids))], np.int64)
        if done == rounds or (after == centroids).all():
            break

        def again(batches: Iterator[pa.RecordBatch], before: np.ndarray = centroids, after: np.ndarray = after) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _vectors(b.column("x"), size)
                    cluster, upper, lower, n = reassign(x, *(b.column(c).to_numpy() for c in ("cluster", "upper", "lower")), before, after)
                    yield _state(b.column("vec_id"), x, cluster, upper, lower, _sums(x, cluster, after, n))

        following = written(map_texts(state.drop("sums"), again, _STATE), "vectors")
        drop_written(state)
        state, centroids = following, after

    def measure(batches: Iterator[pa.RecordBatch], at: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster = b.column("cluster")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), cluster, pa.array(own_squares(_vectors(b.column("x"), size), at, cluster.to_numpy()))], ["vec_id", "cluster", "distance"])

    long = lambda v: F.lit(v if v < 1 << 63 else None).cast("long")
    per_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = map_texts(state.select("vec_id", "x", "cluster"), measure, "vec_id long, cluster int, distance long")
    return rows.select(
        "*", per_cluster([long(v) for v in inertia]).alias("cluster_inertia"), long(sum(inertia)).alias("inertia"), per_cluster([F.lit(h) for h in sha]).alias("centroid_sha256"),
        F.lit(scanned).cast("long").alias("n_scanned"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings")).drop("n_scanned")


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> str:
    """The rounds one after another, each a table of assignments and one of centroids."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        f" WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) LIMIT {k})",
    ]
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT vec_id, first(v.x) AS x, arg_min(c.c, ({square}, c.c)) AS c, CAST(min({square}) AS BIGINT) AS d FROM v, c{t} AS c GROUP BY vec_id)")
        if t < rounds:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts = f"SELECT c, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range(1, {size + 1})) AS i FROM a{t}) GROUP BY c, i"
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{t} AS o LEFT JOIN (SELECT c, list({floor} ORDER BY i) AS x FROM ({parts}) GROUP BY c) AS n USING (c))")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c ON a.c = c.c"
    )


ORACLE = _oracle()
