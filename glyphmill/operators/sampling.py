"""Sampling and splits that rerun alike.

``exact`` forms replay a seeded shuffle of the sorted ids on the driver, for
sets of ids that fit there; the hash forms give each id its place by a hash of
the id and the seed, and scale.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids up to which a shuffle may be replayed on the driver.
EXACT_IDS = 1_000_000


def _order(spark, ids: list, key: str, kind: str) -> DataFrame:
    return spark.createDataFrame(list(zip(ids, range(len(ids)))), f"{key} {kind}, place int")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, place) of a seeded shuffle of the sorted distinct ids; raises beyond ``EXACT_IDS`` ids."""
    ids = [r[0] for r in df.select(key).distinct().orderBy(key).limit(EXACT_IDS + 1).collect()]
    if len(ids) > EXACT_IDS:
        raise ValueError("too many ids for a shuffle on the driver; use the hash form")
    random.Random(seed).shuffle(ids)
    return _order(df.sparkSession, ids, key, dict(df.dtypes)[key])


def with_images(samples: DataFrame) -> DataFrame:
    """Samples that have an image."""
    return samples.where(F.col("image_path").isNotNull())


def select_samples(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """A seeded choice of ``limit`` rows if that is fewer than there are, else all in order (0: all)."""
    if not limit or limit >= df.count():
        return df.orderBy(key)
    chosen = shuffled(df, key, seed).where(F.col("place") < limit)
    return df.join(chosen, key).orderBy("place").drop("place")


def hash_place(key: Column, seed: int) -> Column:
    """A place in [0, 2^28) for an id, from a digest that other engines have too."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256), 1, 7), 16, 10).cast("long")


def split_groups(df: DataFrame, group: Column, seed: int, val_share: float) -> DataFrame:
    """Rows with split train or val; all rows of a group fall on the same side."""
    return df.withColumn("split", F.when(hash_place(group, seed) < int(val_share * (1 << 28)), "val").otherwise("train"))


def split_exact(df: DataFrame, group: str, seed: int, n_val: int) -> DataFrame:
    """(group, split): the first ``n_val`` groups of a seeded shuffle are val."""
    return shuffled(df, group, seed).select(group, F.when(F.col("place") < n_val, "val").otherwise("train").alias("split"))


def load_or_make_split(spark, path: str, make) -> DataFrame:
    """The split written at ``path``, made and written first if it isn't there; changed arguments don't change it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.parquet(path)
    return spark.read.parquet(path)


def sample_k(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, the least by a hash; each task keeps k."""
    return df.orderBy(hash_place(F.col(key), seed), key).limit(k)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in order, all for 0."""
    return df.orderBy(key).limit(n) if n else df.orderBy(key)
