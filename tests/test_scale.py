"""Operators that split what one key or image holds: the same results as plain loops, however they are cut."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import aggregates, grid, joins, ordered, review

ACTIONS = [*review.MOVES, "point_add", "mask_reject_manual_box", "nonsense", None]


def _log(rng, n, key, start=0):
    # times repeat, so that ties go by the second column
    return [(key, start + i // 3, i, rng.choice(ACTIONS), f"t{rng.randrange(9)}" if rng.random() < 0.8 else None) for i in range(n)]


def _walk(rows):
    """Final row and audit of one key's log."""
    state, legal, illegal, reopened, into, out = "proposed", 0, 0, 0, None, []
    for _, at, i, action, target in sorted(rows, key=lambda r: (r[1], r[2])):
        to = review.TRANSITIONS.get((state, action))
        if action in review.LOGGED:
            out.append((at, i, 0, action, None, None))
        if to is None:
            illegal += 1
            continue
        legal += 1
        reopened += action == "reopen"
        if action == "accept":
            out.append((at, i, 0, "mask_accept", None, None))
        out.append((at, i, int(action == "accept"), "state_change", state, to))
        into = target if to == "merged" else None
        state = to
    return (state, legal, illegal, reopened, into), sorted(out)


@pytest.mark.parametrize("block_rows", [None, 400, 25])
def test_composed_maps_equal_the_walk(spark, block_rows):
    rng = random.Random(11)
    data = _log(rng, 6000, 0) + [r for k in range(1, 40) for r in _log(rng, rng.randrange(1, 60), k, rng.randrange(1500))] + _log(rng, 30, None, 100)
    df = spark.createDataFrame(data, "k long, at long, i long, action string, target string").repartition(5)
    by = defaultdict(list)
    for r in data:
        by[r[0]].append(r)
    got = {r.k: (r.state, r.n_legal, r.n_illegal, r.n_reopened, r.merged_into_id) for r in review.replay(df, "k", ["at", "i"], into="target", block_rows=block_rows).collect()}
    assert got == {k: _walk(rows)[0] for k, rows in by.items()}
    audit = defaultdict(list)
    for r in review.audit(df, "k", ["at", "i"], block_rows=block_rows, full=True).collect():
        audit[r.k].append((r.at, r.i, r.seq, r.event, r["from"], r.to))
    assert {k: sorted(v, key=lambda r: r[:3]) for k, v in audit.items()} == {k: _walk(rows)[1] for k, rows in by.items() if _walk(rows)[1]}
    plain = review.audit(df, "k", ["at", "i"], block_rows=block_rows)
    assert plain.columns == ["k", "at", "i", "from", "to", "action"] and plain.count() == sum(e[3] == "state_change" for rows in by.values() for e in _walk(rows)[1])


def test_a_hot_log_is_cut(spark):
    rng = random.Random(1)
    df = spark.createDataFrame(_log(rng, 20_000, 7), "k long, at long, i long, action string, target string")
    logs = review._logs(df, "k", ["at", "i"], "action", ordered.cuts_of(df, "at", 1000), F.lit(None).cast("string").alias("__into"))
    sizes = [r.n for r in logs.select(F.size("__log").alias("n")).collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000 and sum(sizes) == 20_000


def _boxes(rng, n, image, spread, size):
    out = []
    for i in range(n):
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        w, h = (rng.choice([rng.uniform(0, size), size * 8 if rng.random() < 0.02 else 0.0]) for _ in range(2))
        if rng.random() < 0.2 and out:
            b = rng.choice(out)[2]  # inside another, or nearly the same
            d = rng.choice([0.0, 0.5, 1.0])
            x, y, w, h = b[0] + d, b[1] + d, max(0.0, b[2] - b[0] - d), max(0.0, b[3] - b[1] - d)
        out.append((image, i, (x, y, x + w, y + h)))
    return out


ITEM = "image_id long, ord int, box struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.fixture(scope="module")
def dense_items():
    rng = random.Random(21)
    return _boxes(rng, 900, 1, 300, 12) + _boxes(rng, 40, 2, 30, 20) + _boxes(rng, 3, 3, 5, 5) + [(4, i, (5.0, 5.0, 5.0, 5.0)) for i in range(60)] + _boxes(rng, 300, 5, 0.001, 400)


def _area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def _iou(p, q):
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    s = max(w, 0.0) * max(h, 0.0)
    u = _area(p) + _area(q) - s
    return s / u if s > 0 and u > 0 else 0.0


@pytest.mark.parametrize("dense", [None, 50])
def test_joins_through_cells_equal_all_pairs(spark, dense_items, monkeypatch, dense):
    if dense:
        monkeypatch.setattr(grid, "DENSE", dense)
    df = spark.createDataFrame(dense_items, ITEM).repartition(4)
    by = defaultdict(list)
    for image, i, b in dense_items:
        by[image].append((i, b))
    hold = lambda o, b, t=1.0: o[0] - t <= b[0] and o[1] - t <= b[1] and o[2] + t >= b[2] and o[3] + t >= b[3]
    claim = {}
    for image, boxes in by.items():
        ranked = sorted(boxes, key=lambda x: (-_area(x[1]), x[0]))
        for i, b in boxes:
            owner = next((j for j, o in ranked if j != i and hold(o, b)), None)
            if owner is not None:
                claim[image, i] = owner
    assert {(r.image_id, r.ord): r.owner for r in joins.claims(df).collect()} == claim
    owners = {(im, o) for (im, _), o in claim.items()}
    role = {}
    for image, i, _ in dense_items:
        o = claim.get((image, i))
        role[image, i] = (o, ("block" if (image, i) in owners else "node") if o is None else "dropped" if (image, o) in claim else "child")
    assert {(r.image_id, r.ord): (r.owner, r.role) for r in joins.classify(df).collect()} == role
    pairs = {(im, i, j): _iou(p, q) for im, boxes in by.items() for i, p in boxes for j, q in boxes if i < j and _iou(p, q) > 0.1}
    got = [((r.image_id, r.a, r.b), r.iou) for r in joins.iou_pairs(df, 0.1).collect()]
    assert len(got) == len(pairs) and {k: pytest.approx(v) for k, v in got} == pairs
    rng = random.Random(2)
    points = [(im, k, *(rng.choice([(b[0], b[1]), (b[2], b[3]), (rng.uniform(-300, 300), rng.uniform(-300, 300))]))) for im, boxes in by.items() for k, (_, b) in enumerate(boxes)]
    pts = spark.createDataFrame(points, "image_id long, point_ord int, x double, y double")
    inside = {}
    for im, k, x, y in points:
        around = [(_area(b), j) for j, b in by[im] if b[0] <= x < b[2] and b[1] <= y < b[3]]
        if around:
            inside[im, k] = min(around)[1]
    assert {(r.image_id, r.point_ord): r.box_ord for r in joins.smallest_container(pts, df).collect()} == inside
    clicks = spark.createDataFrame([(im, k, x + 3.0, y - 2.0) for im, k, x, y in points], "image_id long, click_ord int, x double, y double")
    marks = pts.select("image_id", "point_ord", F.col("x").alias("px"), F.col("y").alias("py"))
    near = {}
    for im, k, x, y in points:
        d = [(float(np.hypot(x + 3.0 - a, y - 2.0 - b)), j) for i, j, a, b in points if i == im]
        if min(d)[0] <= 10:
            near[im, k] = min(d)[1]
    assert {(r.image_id, r.click_ord): r.point_ord for r in joins.nearest_point(clicks, marks).collect()} == near
    few, others = (df.where(f"ord % 3 {c} 0") for c in ("=", "<>"))
    first = {(im, i): min((j for j, o in by[im] if j % 3 and hold(o, b)), default=None) for im, i, b in dense_items if i % 3 == 0}
    assert {(r.image_id, r.ord): r.block_ord for r in joins.raster_owners(few, others).collect()} == first


def test_cells_are_few_and_joined_by_cell(spark, dense_items, monkeypatch):
    monkeypatch.setattr(grid, "DENSE", 50)
    df = spark.createDataFrame(dense_items, ITEM)
    g = grid.grid(joins._sides(df))
    assert joins._spread(g, df).count() <= 4 * len(dense_items) + len(dense_items)
    plan = joins.iou_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" in plan and "cell_y" in plan and "Join Inner, ((image_id" not in plan.replace("((((image_id", "")
    one = spark.range(3000).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("ord"), F.struct(*[((F.col("id") * 7 % 3000) + d).cast("double").alias(n) for n, d in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))]).alias("box"))
    cells = joins._spread(grid.grid(joins._sides(one)), one).groupBy(*grid.CELL).count()
    assert cells.count() > 50 and cells.agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("at_once", [1_000_000, 40, 0])
@pytest.mark.parametrize("limit", [0.3, 0.0])
def test_suppression_in_rounds_equals_the_loop(spark, dense_items, at_once, limit):
    items = dense_items if limit else dense_items[900:] + dense_items[:200]
    kept = set()
    for image in {i for i, _, _ in items}:
        held = []
        for i, b in sorted(((i, b) for im, i, b in items if im == image), key=lambda x: (-_area(x[1]), x[0])):
            if all(_iou(b, h) <= limit for h in held):
                held.append(b)
                kept.add((image, i))
    df = spark.createDataFrame(items, ITEM).repartition(4)
    assert {(r.image_id, r.ord) for r in joins.suppress(df, limit, at_once).collect()} == kept


@pytest.mark.parametrize("bounds", [4, 1000])
def test_exact_quantiles(spark, bounds, monkeypatch):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0, 1, 5000), "b": np.repeat([1.0, 2.0, 5.0], [700, 1, 300]), "c": np.array([3.5]), None: rng.integers(0, 7, 200).astype(float), "e": np.arange(1001) ** 3.0}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None)], "g string, v double").repartition(6)
    shares = [0.0, 0.1, 0.5, 0.905, 1.0]
    got = {r.g: r for r in aggregates.quantiles(df, "v", shares, ["g"], bounds).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g].n == len(v) and [got[g][f"q{k}"] for k in range(5)] == pytest.approx([np.quantile(v, s) for s in shares], rel=1e-12)
    whole = aggregates.quantiles(df, "v", [0.5], bounds=bounds).first()
    assert whole.q0 == pytest.approx(np.median(np.concatenate(list(groups.values()))), rel=1e-12)
    at_once = [sorted(map(str, aggregates.validation(df, "v", by=by).collect())) for by in (["g"], [])]
    monkeypatch.setattr(aggregates, "AT_ONCE", 0)
    checked = aggregates.validation(df, "v", by=["g"])
    assert checked.where("g = 'none'").first().median is None and checked.where("g IS NULL").first().n == 200
    assert at_once == [sorted(map(str, aggregates.validation(df, "v", by=by).collect())) for by in (["g"], [])]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("how", ["least", "greatest", "sum", "last"])
def test_scan_in_ranges_equals_the_window(spark, how, by):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(300), i, rng.choice([None, rng.randrange(1000)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, at int, i int, v long").repartition(4)
    whole, cut = (ordered.scan(df, ["at", "i"], "v", how, "run", by, n) for n in (10_000, 90))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    window = [d for d in cut._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in d and "range of run" in d]
    assert window or by == []


def test_running_best_in_ranges(spark):
    rng = random.Random(6)
    losses = [rng.choice([None, rng.randrange(500)]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(losses)), "at int, loss int").repartition(3)
    best, want = None, {}
    for i, x in enumerate(losses):
        want[i] = x is not None and (best is None or x < best)
        best = x if want[i] else best
    for n in (10_000, 100):
        assert {r["at"]: r.is_best for r in ordered.running_best(df, "at", "loss", range_rows=n).collect()} == want
