"""The snapshot of last writes: equal to folding the whole log, by batches in any order, with two writers and repeats."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import ordered
from glyphmill.sources import files, numbers
from glyphmill.streaming import snapshot

SCHEMA = "id long, at long, tie long, text string, user string, status string"


def _writes(rng, n, keys, start=0):
    return [(rng.randrange(keys), rng.randrange(50), start + i, rng.choice([None, f"t{i}"]), rng.choice(["u", "v"]), rng.choice([None, None, "done", "pending"])) for i in range(n)]


def _want(spark, rows):
    whole = ordered.upsert(spark.createDataFrame(rows, SCHEMA), "id", ["at", "tie"], "text", "user", "status")
    return sorted((r.id, str(r.text), r.user, r.status, r.n_writes) for r in whole.collect())


def _got(table):
    return sorted((r.id, str(r.text), r.user, r.status, r.n_writes) for r in table.current().collect())


@pytest.fixture
def table(spark, tmp_path):
    return snapshot.Snapshot(spark, f"file://{tmp_path}/t", "id", ["at", "tie"], "text", "user", "status")


def test_batches_equal_the_log(spark, table):
    rng = random.Random(2)
    batches = [_writes(rng, 60, 200, 1000 * k) for k in range(5)]
    rng.shuffle(batches)
    for k, rows in enumerate(batches):
        assert table.merge(spark.createDataFrame(rows, SCHEMA), f"b{k}") == k
    everything = [r for b in batches for r in b]
    assert _got(table) == _want(spark, everything)
    table.merge(spark.createDataFrame(batches[0], SCHEMA), "b0")  # comes again
    assert _got(table) == _want(spark, everything)
    assert table.sweep() > 0 and _got(table) == _want(spark, everything)


def test_a_batch_rewrites_only_what_it_touches(spark, table):
    rng = random.Random(3)
    table.merge(spark.createDataFrame(_writes(rng, 3000, 1000), SCHEMA), "all")
    before = table._head()[1]["files"]
    table.merge(spark.createDataFrame([(7, 99, 1, "new", "u", None), (7, 98, 2, "older", "v", "done")], SCHEMA), "one")
    after = table._head()[1]["files"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(after) == snapshot.BUCKETS and len(changed) == 1
    row = table.current().where("id = 7").first()
    assert (row.text, row.user, row.status) == ("new", "u", "done")


def test_two_writers(spark, table):
    """Both start from the same commit; the second one to finish starts again, and nothing is lost."""
    rng = random.Random(4)
    parts = [_writes(rng, 40, 30, 1000 * k) for k in range(4)]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in parts]
    taken = []
    threads = [threading.Thread(target=lambda k=k: taken.append(table.merge(frames[k], f"w{k}"))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken) == [0, 1, 2, 3] and _got(table) == _want(spark, [r for p in parts for r in p])


def test_stream_and_restart(spark, table, tmp_path):
    rng = random.Random(5)
    source = str(tmp_path / "in")
    everything = []
    for k in range(3):
        rows = _writes(rng, 50, 40, 1000 * k)
        everything += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        writes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        table.stream(writes, str(tmp_path / "ck")).awaitTermination()
        assert _got(table) == _want(spark, everything)


def test_numbers_are_taken_once(spark, tmp_path):
    folder = f"file://{tmp_path}/n"
    got = []
    threads = [threading.Thread(target=lambda: got.append(numbers.take_number(spark, folder))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(6)) and sorted(os.listdir(tmp_path / "n")) == [f"{k:012d}" for k in range(6)]


def test_runs_of_two_writers_are_told_apart(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = lambda v: spark.createDataFrame([("a", v), ("b", v)], "k string, v int")
    threads = [threading.Thread(target=files.append_run, args=(rows(v), path, "k")) for v in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = files.append_run(rows(9), path, "k")
    assert {r.k: r.v for r in last.collect()} == {"a": 9, "b": 9}
    runs = spark.read.json(path).groupBy("run").agg(F.countDistinct("v").alias("n")).collect()
    assert len(runs) == 4 and all(r.n == 1 for r in runs)


def test_a_swap_that_was_broken_off(spark, tmp_path):
    """Whatever the moment at which a driver is lost, a table is there: the old one or the new one, and the next swap works."""
    import shutil

    def value(path):
        return spark.read.parquet(files.table_at(spark, path)).first().v

    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    for moment in ("before", "between", "after"):
        path = str(tmp_path / moment)
        files.replace_table(frame(1), path)
        frame(2).write.parquet(f"{path}.new")
        if moment != "before":
            os.rename(path, f"{path}.old")
        if moment == "after":
            os.rename(f"{path}.new", path)
        assert value(path) == (1 if moment == "before" else 2)
        files.replace_table(frame(3), path)
        assert value(path) == 3 and not os.path.exists(f"{path}.old")
    shutil.move(str(tmp_path / "after"), str(tmp_path / "after.old"))
    assert value(str(tmp_path / "after")) == 3
