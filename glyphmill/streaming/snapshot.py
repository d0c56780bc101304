"""A table of the last write of each key, kept up to date by batches of writes.

Keys are dealt to buckets by a hash.  A batch is folded by key first; then only the
buckets that it touches are read, merged and written, under a new name each, and
the batch's commit names all buckets of the table.  A commit is a file that is
created once: its number is taken by whoever creates it, so of two writers the
second one starts again from the first one's commit.  A reader opens the last
commit and the buckets that it names, which nobody changes.  So the cost of a batch
follows from the buckets that it touches, and not from the log of all writes.

A batch that comes again, as after a restart of a stream, is known by its name and
changes nothing.  Old buckets are kept until ``sweep``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.numbers import create_once
from glyphmill.sources.numbers import file_system as _fs

#: Buckets of a new table.
BUCKETS = 64
COMMITS, DATA = "_commits", "data"


class Snapshot:
    """The table below ``path``: the last write of each key, as ``ordered.upsert`` gives it.

    Rows are (key, *order, text, user, status, n_writes, and the places in the
    order of the last text and the last status).
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], text: str, user: str, status: str, default: str = "pending"):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.text, self.user, self.status, self.default = text, user, status, default

    def _head(self) -> tuple[int, dict]:
        """The last commit: its number, and {buckets, files, batches}."""
        fs, path_of = _fs(self.spark, self.path)
        folder = path_of(f"{self.path}/{COMMITS}")
        fs.mkdirs(folder)
        taken = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())
        if not taken:
            return -1, {"buckets": BUCKETS, "files": {}, "batches": []}
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/{COMMITS}/{taken[-1]}").first()[0]
        return int(taken[-1]), json.loads(text)

    def _folded(self, writes: DataFrame) -> DataFrame:
        """One row a key, from writes or from folded rows."""
        at = F.struct(*self.order)
        if "n_writes" not in writes.columns:
            has = lambda c: F.when(F.col(c).isNotNull(), at)
            writes = writes.withColumns({"text_at": has(self.text), "status_at": has(self.status), "n_writes": F.lit(1).cast("long")})
        last = F.max(at)
        out = writes.groupBy(self.key).agg(last.alias("at"), F.max_by(self.text, "text_at").alias(self.text), F.max_by(self.user, at).alias(self.user), F.max_by(self.status, "status_at").alias(self.status), F.max("text_at").alias("text_at"), F.max("status_at").alias("status_at"), F.sum("n_writes").alias("n_writes"))
        return out.select(self.key, *[F.col(f"at.{c}").alias(c) for c in self.order], self.text, self.user, self.status, "n_writes", "text_at", "status_at")

    def merge(self, writes: DataFrame, batch: str) -> int:
        """Take in a batch of writes (key, *order, text, user, status); returns the number of the commit that holds it."""
        fresh_path = f"{self.path}/{DATA}/batch-{uuid.uuid4().hex}"
        self._folded(writes.select(self.key, *self.order, self.text, self.user, self.status)).write.parquet(fresh_path)
        folded = self.spark.read.parquet(fresh_path)
        while True:
            number, head = self._head()
            if batch in head["batches"]:
                break
            bucket = F.pmod(F.xxhash64(self.key), F.lit(head["buckets"])).cast("int")
            touched = [r[0] for r in folded.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
            held = [head["files"][str(b)] for b in touched if str(b) in head["files"]]
            rows = folded
            if held:
                rows = folded.unionByName(self.spark.read.schema(folded.schema).parquet(*held))
            made = f"{self.path}/{DATA}/{uuid.uuid4().hex}"
            self._folded(rows).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(made)
            files = head["files"] | {str(b): f"{made}/bucket={b}" for b in touched}
            number += 1
            # names of batches that a stream may send again: the last ones
            commit = {"buckets": head["buckets"], "files": files, "batches": [*head["batches"], batch][-1000:]}
            if create_once(self.spark, f"{self.path}/{COMMITS}/{number:012d}", json.dumps(commit)):
                break
            self._delete(made)  # another writer was first: start again from its commit
        self._delete(fresh_path)
        return number

    def current(self) -> DataFrame:
        """(key, text, user, status, n_writes) as of the last commit."""
        _, head = self._head()
        if not head["files"]:
            raise FileNotFoundError(f"no commit at {self.path}")
        rows = self.spark.read.parquet(*head["files"].values())
        return rows.select(self.key, self.text, self.user, F.coalesce(self.status, F.lit(self.default)).alias(self.status), "n_writes")

    def stream(self, writes: DataFrame, checkpoint: str):
        """Take in a stream of writes, batch by batch."""
        name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

        def land(batch: DataFrame, number: int) -> None:
            self.merge(batch, f"{name}-{number}")

        return writes.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def sweep(self) -> int:
        """Delete what the last commit doesn't name; for times when nobody reads an older one. Returns how many folders went."""
        fs, path_of = _fs(self.spark, self.path)
        _, head = self._head()
        live = {f.rsplit("/", 2)[-2] for f in head["files"].values()}
        kept = {f.removeprefix(f"{self.path}/") for f in head["files"].values()}
        gone = 0
        for folder in fs.listStatus(path_of(f"{self.path}/{DATA}")):
            name = folder.getPath().getName()
            if name not in live:
                gone += fs.delete(folder.getPath(), True)
                continue
            for part in fs.listStatus(folder.getPath()):
                if part.isDirectory() and f"{DATA}/{name}/{part.getPath().getName()}" not in kept:
                    gone += fs.delete(part.getPath(), True)
        return gone

    def _delete(self, path: str) -> None:
        fs, path_of = _fs(self.spark, path)
        fs.delete(path_of(path), True)
