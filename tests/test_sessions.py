"""Streaming edit sessions: the batch form's results, from batches in any order, and from stored records after a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import ordered, review
from glyphmill.streaming import sessions

ACTIONS = ["activate", "add_positive", "add_positive", "add_negative", "move", "delete_positive", "confirm_points", "accept", "reopen", "manual_box", "reject", "open_mask", "merge"]
SCHEMA = "id long, ts timestamp, event_id long, action string"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
END = (10**9, START + datetime.timedelta(days=30), 10**9, "activate")


def _events(rng, n, first=0, minutes=30):
    return [(rng.randrange(6), START + datetime.timedelta(seconds=rng.randrange(minutes * 60), milliseconds=rng.randrange(3)), first + i, rng.choice(ACTIONS)) for i in range(n)]


def _run(spark, tmp_path, batches, stored=None):
    """All batches in turn, then an event long after them; the last row of each key."""
    source, out = str(tmp_path / f"in{random.random()}"), []
    for rows in [*batches, [END], [(END[0], END[1] + datetime.timedelta(hours=1), END[2] + 1, "move")]]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    found = sessions.edit_sessions(stream, "id", stored=stored)

    def land(batch, number):
        out.extend((number, *r) for r in batch.collect())

    found.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", str(tmp_path / f"ck{random.random()}")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in sorted(out, key=lambda r: (r[0], r[-1])):
        last[r[1]] = r[2:]
    last.pop(END[0], None)
    return last


def test_steps_equal_the_batch_form(spark):
    rng = random.Random(7)
    rows = _events(rng, 800)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.id: (r.state, r.n_positive, r.mask_source) for r in review.edit_session(df, "id", ["ts", "event_id"]).collect()}
    got = {}
    for i, _, _, action in sorted(rows, key=lambda r: (r[1], r[2])):
        got[i] = sessions.step(*got.get(i, ("proposed", 0, None)), action)
    assert got == want


def test_shuffled_batches_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows = _events(rng, 150)
    rng.shuffle(rows)  # every event may come in any of the batches, within the hour that is allowed
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.id: (r.state, r.n_positive, r.has_mask, r.mask_source) for r in review.edit_session(df, "id", ["ts", "event_id"]).collect()}
    active = {r.id: r.active_seconds for r in ordered.active_time(df, "id", "ts", "event_id").collect()}
    got = _run(spark, tmp_path, [rows[:50], rows[50:100], rows[100:]])
    assert {k: v[:4] for k, v in got.items()} == want
    assert {k: v[4] for k, v in got.items()} == pytest.approx(active) and {k: v[5] for k, v in got.items()} == {k: sum(r[0] == k for r in rows) for k in want}


def test_sessions_start_from_records(spark, tmp_path):
    rng = random.Random(5)
    first, second = _events(rng, 80), [(i, ts + datetime.timedelta(hours=3), e, a) for i, ts, e, a in _events(rng, 80, 1000)]
    stored = review.edit_session(spark.createDataFrame(first, SCHEMA), "id", ["ts", "event_id"]).select("id", "state", "n_positive", "mask_source")
    got = _run(spark, tmp_path, [second[:40], second[40:]], stored)
    whole = review.edit_session(spark.createDataFrame(first + second, SCHEMA), "id", ["ts", "event_id"])
    assert {k: v[:2] for k, v in got.items()} == {r.id: (r.state, r.n_positive) for r in whole.collect() if r.id in {e[0] for e in second}}
