"""Vector similarity: of pairs as Catalyst expressions, of queries against all rows as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block, which is broadcast to the rows; rows that meet a block at once.
BROADCAST_QUERIES, ROWS = 4_000, 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _units(lists: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of length 1."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _best(query: np.ndarray, ids: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Places of the k most similar entries of each query, of equal ones those of the least ids."""
    order = np.lexsort((ids, -similarity, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[nth < k]


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k most similar rows to each query: (query_id, id, rank, similarity); null and zero vectors are similar to nothing.

    Every query meets every row, in blocks of at most about ``BROADCAST_QUERIES``
    queries, one matrix product for each Arrow batch.  Each task keeps its own
    k best of each query, so that is all that is shuffled.
    """
    known = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(norm(F.col(vec_col)) > 0)
    side, base = known(queries), known(rows)
    spark, blocks = rows.sparkSession, -(-side.count() // BROADCAST_QUERIES) or 1
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    out = None
    for b in range(blocks):
        block = side.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # a block at a time is at the driver
        sent = spark.sparkContext.broadcast((block["id"].to_numpy(), _units(block["v"].combine_chunks()) if block.num_rows else None))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, vectors = sent.value
            held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for at in range(0, len(ids) if vectors is not None else 0, ROWS):
                    part = ids[at : at + ROWS]
                    likeness = np.round(vectors @ _units(batch.column(1).slice(at, ROWS)).T, 6)
                    likeness[names[:, None] == part[None, :]] = -2  # a query isn't its own neighbour
                    bar = np.maximum(np.partition(likeness, -k, axis=1)[:, [-k]] if len(part) > k else likeness.min(axis=1, keepdims=True), -1)
                    q, r = np.nonzero(likeness >= bar)
                    found = [np.concatenate(x) for x in zip(held, (q, part[r], likeness[q, r]))]
                    keep = _best(*found, k)
                    held = [x[keep] for x in found]
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(names[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "id", "similarity"])

        best = base.mapInArrow(run, "query_id long, id long, similarity double").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")
        out = best if out is None else out.unionByName(best)
    return out
