"""Tables made on the way, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications whose session names none.
_ROOTS: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, in the one that ``spark.checkpoint.dir`` names; on a local master without it, in a local one."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _ROOTS.get(app)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    return f"{root.rstrip('/')}/glyphmill/{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage is cut, and lost executors cost nothing of it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
