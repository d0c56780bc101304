"""Operator 11: centroid clustering by delta Lloyd on whole numbers.

A kept vector has exactly ``DIM`` components, none null or non-finite; each
component x becomes the integer floor(``SCALE`` * x).  Centroids start as the
vectors with the smallest SHA-256 of ``2:<vec_id>``.  A round assigns every
vector to its nearest centroid (ties: the smaller number) and replaces each
non-empty centroid by the floor of its vectors' mean; after the last round the
vectors are assigned once more.

Delta rounds.  Vectors are written once, bucketed by row; the assignment (row,
cluster, distance) of each round is a narrow table bucketed alike, so the two
meet without a shuffle and only the narrow one is written again.  A vector whose
centroid didn't move, or moved no farther from it, is compared with the changed
centroids alone: no unchanged one can have become nearer.  Only vectors whose
centroid moved away meet all of them.  Cluster sums and counts persist; a task
adds up, for each cluster, the vectors that came minus those that left, and a
round sums these signed rows.  The driver holds sums and centroids, ``k`` times
``DIM`` numbers whatever the input.

All arithmetic is exact: products in floating point only where every partial sum
stays below 2^53, whole numbers else, and sums of unbounded size on the driver.

Defined cases: vectors of another length, null ones, and ones with null, NaN or
infinite components give no row; components beyond 2^27 in size count as 2^27, so
that distances stay within 64 bits; a null id is carried along and comes last
among the starts; equal ids are told apart by their components where both could
start; repeated vectors are rows of their own, also among the starts, where the
later one stays empty and where it is; with fewer vectors than ``k`` each starts
a centroid; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, delete, materialise, scoped, scratch

DIM, SCALE, K, ROUNDS = 64, 256, 40, 5
#: Largest size of a component: 64 squares of twice this stay within 63 bits.
MOST = 1 << 27
#: Components below this size have exact products in floating point.
EXACT = 1 << 22


def whole(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """The integers of a vector, null if it isn't kept."""
    fine = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return F.when(fine, scaled)


def nearest(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and number of the nearest of the centroids that ``numbers`` names in ascending order, the first on ties."""
    picked = centroids[numbers]
    if max(np.abs(x).max(initial=0), np.abs(picked).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), picked.astype(np.float64)
        d = ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in picked], axis=1)
    at = d.argmin(axis=1)
    return d[np.arange(len(x)), at], numbers[at]


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and number of each vector's nearest centroid, from its last ones (owner -1: none) and the centroids that changed since."""
    moved = np.zeros(len(centroids) + 1, bool)
    moved[changed] = moved[-1] = True  # the last place stands for owner -1
    now = distance.copy()
    mine = moved[owner] & (owner >= 0)
    now[mine] = ((x[mine] - centroids[owner[mine]]) ** 2).sum(axis=1)
    all_ = (owner < 0) | (now > distance)
    best = owner.copy()
    some = ~all_
    if some.any() and len(changed):
        d, c = nearest(x[some], centroids, changed)
        closer = (d < now[some]) | ((d == now[some]) & (c < best[some]))
        now[some], best[some] = np.where(closer, d, now[some]), np.where(closer, c, best[some])
    if all_.any():
        now[all_], best[all_] = nearest(x[all_], centroids, np.arange(len(centroids)))
    return now, best


def _assign(rows: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """Rows (row, cluster, distance, delta) from rows (row, q, cluster, distance); at its end a task adds a row for each cluster that gained or lost vectors, with ``delta``: sums by component and the count, signed."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros((k, dim + 1), np.int64), 0
        names = ["row", "cluster", "distance", "delta"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            owner = batch.column(2).to_numpy().astype(np.int64)
            now, best = reassigned(x, owner, batch.column(3).to_numpy().copy(), centroids, changed)
            gone = np.flatnonzero(best != owner)
            one = np.concatenate([x[gone], np.ones((len(gone), 1), np.int64)], axis=1)
            np.add.at(total, best[gone], one)
            left = owner[gone] >= 0
            np.subtract.at(total, owner[gone][left], one[left])
            last = batch.column(0)[batch.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(now), pa.nulls(batch.num_rows, pa.list_(pa.int64()))], names)
        some = np.flatnonzero(total.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names)

    return rows.select("row", "q", "cluster", "distance").mapInArrow(run, "row long, cluster int, distance long, delta array<long>")


class _Bucketed:
    """Tables in the shared folder, bucketed by row and dropped at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, name: str) -> str:
        table = f"glyphmill_{name}_{uuid.uuid4().hex}"
        self.paths[table] = scratch(self.spark, name)
        df.write.bucketBy(self.buckets, "row").option("path", self.paths[table]).option("compression", "zstd").format("parquet").saveAsTable(table)
        return table

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(self.spark, self.paths.pop(table))

    def __enter__(self) -> _Bucketed:
        return self

    def __exit__(self, *_: object) -> None:
        for table in list(self.paths):
            self.drop(table)


def starts(vectors: DataFrame, k: int = K) -> list[list[int]]:
    """The first centroids, from rows (vec_id, q): at most ``k`` rows, picked by the tasks first."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return [list(r.q) for r in vectors.select("q", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size)."""
    spark = df.sparkSession
    bounded_batches(spark)
    result = scratch(spark, "clusters")
    with scoped(spark), _Bucketed(spark) as tables:
        picked = df.select(F.col(f"`{id_col}`").alias("vec_id"), whole(F.col(f"`{vector_col}`"), dim, scale).alias("q")).where(F.col("q").isNotNull())
        # a row's number is stored with it before rows are dealt to buckets
        picked = materialise(picked.withColumn("row", F.monotonically_increasing_id()), "vectors")
        centroids = np.array(starts(picked, k), np.int64).reshape(-1, dim)
        vectors = tables.write(picked.repartition("row"), "vectors")
        sums = [[0] * (dim + 1) for _ in range(len(centroids))]
        changed, held = np.arange(len(centroids)), None
        for step in range(rounds + 1):
            rows = spark.table(vectors)
            if held is None:
                rows = rows.withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("long")})
            else:
                rows = rows.join(spark.table(held).where(F.col("delta").isNull()).drop("delta").hint("shuffle_hash"), "row")
            last, held = held, tables.write(_assign(rows, centroids, changed), f"assigned{step}")
            if last:
                tables.drop(last)
            if step == rounds or not len(centroids):
                break
            moves = spark.table(held).where(F.col("delta").isNotNull()).select("cluster", F.posexplode("delta").alias("i", "d"))
            for r in moves.groupBy("cluster", "i").agg(F.sum(F.col("d").cast("decimal(20,0)")).alias("d")).collect():
                sums[r.cluster][r.i] += int(r.d)
            fresh = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums, centroids.tolist())], np.int64).reshape(-1, dim)
            changed = np.flatnonzero((fresh != centroids).any(axis=1))
            centroids = fresh
        assigned = spark.table(held).where(F.col("delta").isNull()).select("row", "cluster", "distance")
        by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"), F.count(F.lit(1)).alias("n")).collect()
        digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        facts = [(r.cluster, int(r.d), int(sum(x.d for x in by)), digest[r.cluster], r.n) for r in by]
        # a row for each centroid
        facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
        whole_ = spark.table(vectors).select("row", "vec_id").join(assigned.hint("shuffle_hash"), "row").join(F.broadcast(facts), "cluster")
        whole_.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size").write.parquet(result)
    return spark.read.parquet(result)


def _sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    """The rounds one after the other, each with all distances."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {scale}) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INTEGER) AS cluster, q FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT vec_id, v.q, cluster, list_sum(list_transform(list_zip(v.q, c{r}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{r})")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, arg_min({{'c': cluster, 'd': distance}}, (distance, cluster)) AS own FROM d{r} GROUP BY vec_id, q)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT own.c AS cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY cluster, i)")
            parts.append(f"m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} ON c{r}.cluster = m{r}.cluster)")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, own.c AS cluster, own.d AS distance, (sum(own.d) OVER (PARTITION BY own.c))::BIGINT AS cluster_inertia, (sum(own.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY own.c) AS cluster_size
        FROM a{rounds} JOIN c{rounds} ON a{rounds}.own.c = c{rounds}.cluster"""


SQL = _sql()
