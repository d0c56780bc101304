"""Records as a data source: reads by id, commits of all or none, guarded versions."""

import json
import os

import pytest

from glyphmill.sources import store


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.createDataFrame([(f"im{i}", None, json.dumps({"n": i, "t": "é"})) for i in range(25)], "id string, version string, json string").repartition(4)
    store.save(rows, str(tmp_path))
    return str(tmp_path)


def _left(folder):
    return sorted(n for n in os.listdir(folder) if n.startswith("_") and n != store.STAGED) + sorted(os.listdir(f"{folder}/{store.STAGED}"))


def test_round_trip_and_layout(spark, folder):
    got = {r.id: (r.version, json.loads(r.json)) for r in store.load(spark, f"file://{folder}").collect()}
    assert len(got) == 25 and got["im7"] == (store.digest(open(f"{folder}/im7.json", "rb").read()), {"n": 7, "t": "é"}) and _left(folder) == []


def test_partitions_hold_ranges_of_ids(folder, monkeypatch):
    monkeypatch.setattr(store, "IDS", 10)
    assert [len(p.ids) for p in store.Reader(folder).partitions()] == [10, 10, 5]


def test_one_id_opens_one_file(spark, folder):
    """A pushed filter reaches the files: a broken record isn't read when another one is asked for."""
    with open(f"{folder}/broken.json", "wb") as f:
        f.write(b"\xff\xfe")
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        assert [r.id for r in store.load(spark, folder).where("id = 'im3'").collect()] == ["im3"]
        assert {r.id for r in store.load(spark, folder).where("id IN ('im3', 'im4', 'none')").collect()} == {"im3", "im4"}
        assert store.load(spark, folder).where("id = 'im3' AND id = 'im4'").count() == 0
        reader = store.Pushed(folder)
        assert list(reader.pushFilters([store.EqualTo(("id",), "im3"), store.EqualTo(("version",), "x")])) == [store.EqualTo(("version",), "x")]
        assert [p.ids for p in reader.partitions()] == [["im3"]]
        with pytest.raises(Exception):
            store.load(spark, folder).collect()
    finally:
        spark.conf.unset(key)


def test_the_second_of_two_writers_is_refused(spark, folder):
    seen = store.load(spark, folder).where("id IN ('im1', 'im2', 'im3')").collect()
    by = {r.id: r.version for r in seen}
    frame = lambda rows: spark.createDataFrame(rows, "id string, version string, json string").repartition(3)
    store.save(frame([("im2", by["im2"], '{"n": "first"}')]), folder)
    before = {n: open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.endswith(".json")}
    with pytest.raises(Exception, match="changed since they were read: im2"):
        store.save(frame([(i, by[i], '{"n": "second"}') for i in ("im1", "im2", "im3")] + [("new", None, "{}")]), folder)
    with pytest.raises(Exception, match="changed since they were read: im4"):
        store.save(frame([("im4", None, "{}")]), folder)  # it is there already
    with pytest.raises(Exception, match="changed since they were read: gone"):
        store.save(frame([("gone", "0" * 64, "{}")]), folder)
    with pytest.raises(Exception, match="twice"):
        store.save(frame([("x", None, "{}"), ("x", None, "[]")]), folder)
    assert before == {n: open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.endswith(".json")} and _left(folder) == []
    store.save(frame([(i, by[i], '{"n": "third"}') for i in ("im1", "im3")]), folder)
    assert open(f"{folder}/im3.json").read() == '{"n": "third"}'


def test_a_failing_task_leaves_nothing(spark, folder):
    rows = spark.createDataFrame([("ok", None, "{}"), ("_bad", None, "{}")], "id string, version string, json string").repartition(1)
    with pytest.raises(Exception, match="can't name a record"):
        store.save(rows, folder)
    assert not os.path.exists(f"{folder}/ok.json")
    with pytest.raises(Exception, match="mounted folder"):
        store.save(rows, "s3a://bucket/x")
    with pytest.raises(Exception, match="one by one"):
        rows.write.format(store.NAME).mode("overwrite").save(folder)


def _entries(folder, ids, stale=()):
    out = []
    for i in ids:
        staged = f"{folder}/{store.STAGED}/s-{i}"
        with open(staged, "w") as f:
            f.write(f'"{i} moved"')
        out.append({"id": i, "started_from": "0" * 64 if i in stale else store._version(f"{folder}/{i}.json"), "becomes": store.digest(f'"{i} moved"'.encode()), "staged": staged})
    return out


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_a_commit_that_was_broken_off_is_finished(spark, folder, moved):
    entries = _entries(folder, ["im1", "im2"])
    with open(f"{folder}/{store.JOURNAL}", "w") as f:
        json.dump(entries, f)
    for e in entries[:moved]:
        os.replace(e["staged"], f"{folder}/{e['id']}.json")
    got = {r.id: r.json for r in store.load(spark, folder).collect()}
    assert (got["im1"], got["im2"]) == ('"im1 moved"', '"im2 moved"') and _left(folder) == []


def test_a_conflicting_journal_moves_nothing(spark, folder):
    with open(f"{folder}/{store.JOURNAL}", "w") as f:
        json.dump(_entries(folder, ["im1", "im2"], stale=["im2"]), f)
    store.commit(folder, _entries(folder, ["im5"]))
    assert [store._version(f"{folder}/{i}.json") == store.digest(f'"{i} moved"'.encode()) for i in ("im1", "im2", "im5")] == [False, False, True] and _left(folder) == []
