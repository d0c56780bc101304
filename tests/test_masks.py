"""Masks as expressions over runs, against decoded pixels and strings of the format written by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import masks
from glyphmill.operators import drawing

# strings of the compressed form, worked out by hand from its rules, and the runs they stand for
KNOWN = [
    ('{"size": [9, 10], "counts": "61X13mN000`0"}', (9, 10, [6, 1, 40, 4, 5, 4, 5, 4, 21])),
    ('{"size": [2, 2], "counts": "4"}', (2, 2, [4])),
    ('{"size": [2, 2], "counts": "04"}', (2, 2, [0, 4])),
    ('{"size": [4, 4], "counts": "`0"}', (4, 4, [16])),
    ('{"size": [4, 4], "counts": "0`0"}', (4, 4, [0, 16])),
    ('{"size": [100, 10], "counts": "XO"}', None),  # a negative run
    ('{"size": [31, 33], "counts": "oo0"}', (31, 33, [1023])),
    ('{"size": [32, 32], "counts": "PP1"}', (32, 32, [1024])),
    ('{"size": [1, 12], "counts": "1234K"}', None),  # runs that don't fill the size
    ('{"counts": "4", "score": 1.5, "size": [2, 2]}', (2, 2, [4])),
    ('{"size": [0, 0], "counts": "0"}', (0, 0, [0])),
    ("not json", None),
    ('{"size": [2], "counts": "4"}', None),
    ('{"size": [2, 2], "counts": "P"}', None),
    ('{"size": [2, 2], "counts": "4~"}', None),
    ('{"size": [2, 2], "counts": "PPPPPPPPP0"}', None),
    ('{"size": [2, 2]}', None),
    ("", None),
    (None, None),
]
MASK = "struct<h:int,w:int,counts:array<int>>"


def _random(rng, n, h, w):
    out = []
    for k in range(n):
        m = np.zeros((h, w), bool)
        for _ in range(rng.integers(0, 4)):
            y, x = rng.integers(0, h), rng.integers(0, w)
            m[y : y + rng.integers(1, h + 1), x : x + rng.integers(1, w + 1)] ^= True
        out.append(rng.random((h, w)) < 0.5 if k % 5 == 0 else ~m if k % 7 == 0 else m)
    return out


def test_strings_of_the_format(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KNOWN)], "i int, t string")
    got = {r.i: None if r.m is None else (r.m.h, r.m.w, list(r.m.counts)) for r in df.select("i", masks.of_text("t").alias("m")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(KNOWN)}
    good = [(i, t) for i, (t, want) in enumerate(KNOWN) if want and "score" not in t]
    back = spark.createDataFrame(good, "i int, t string").select("t", masks.text_of(masks.of_text("t")).alias("b")).collect()
    assert all(r.t == r.b for r in back)


def test_text_of_all_kinds_of_runs(spark):
    rng = np.random.default_rng(3)
    made = [masks.encode(m) for m in _random(rng, 30, 13, 17)] + [{"h": 1 << 15, "w": 1 << 15, "counts": [0, 1, 1 << 29, 5, (1 << 29) - 6]}, masks.encode(np.tile([[True], [False]], (400, 3)))]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], f"i int, m {MASK}")
    got = df.select("i", masks.text_of("m").alias("t"), masks.of_text(masks.text_of("m")).alias("b"), "m").collect()
    assert all(r.t == masks.to_text(made[r.i]) and json.loads(r.t)["size"] == [r.m.h, r.m.w] and r.b == r.m for r in got)


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (1, 40), (23, 3)])
def test_set_operations_on_runs(spark, shape):
    rng = np.random.default_rng(sum(shape))
    a, b = _random(rng, 40, *shape), _random(rng, 40, *shape)
    df = spark.createDataFrame([(i, masks.encode(p), masks.encode(q)) for i, (p, q) in enumerate(zip(a, b))] + [(99, masks.encode(a[0]), masks.encode(np.ones((2, 2), bool)))], f"i int, p {MASK}, q {MASK}")
    made = df.select("i", masks.union("p", "q").alias("o"), masks.intersection("p", "q").alias("n"), masks.difference("p", "q").alias("d"), masks.iou("p", "q").alias("iou"), masks.resized("p", F.lit(6), F.lit(9)).alias("r"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in made.collect():
        if r.i == 99:
            assert shape == (2, 2) or (r.o, r.iou) == (None, None)
            continue
        p, q = a[r.i], b[r.i]
        for got, want in ((r.o, p | q), (r.n, p & q), (r.d, p & ~q)):
            assert got.asDict() == masks.encode(want)
        assert r.iou == pytest.approx((p & q).sum() / (p | q).sum() if (p | q).any() else 1.0)
        h, w = p.shape
        want = p[(np.arange(6) * h // 6)[:, None], (np.arange(9) * w // 9)[None, :]]
        assert r.r.asDict() == masks.encode(want)


def test_many_runs(spark):
    """Masks of 100,000 runs take seconds, not the square of their runs."""
    a = np.zeros((400, 500), bool)
    a[::2] = True
    df = spark.createDataFrame([(masks.encode(a), masks.encode(~a))], f"p {MASK}, q {MASK}")
    r = df.select(masks.iou("p", "q").alias("i"), masks.area(masks.union("p", "q")).alias("u"), (masks.of_text(masks.text_of("p")) == F.col("p")).alias("same")).first()
    assert (r.i, r.u, r.same) == (0.0, 200_000, True)


def test_label_raster(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for image in range(6):
        held = _random(rng, 5, 8, 9)
        raster = np.zeros((8, 9), int)
        for k, m in enumerate(held):
            raster[m] = k + 1
        rows += [(image, k, masks.encode(m)) for k, m in enumerate(held)] + [(image, 7, masks.encode(np.ones((3, 3), bool)))]
        want |= {(image, k): masks.encode(raster == k + 1) for k in range(5)}
    df = spark.createDataFrame(rows, f"image_id int, ord int, mask {MASK}").repartition(3)
    got = {(r.image_id, r.ord): (r["rank"], r.seen.asDict()) for r in drawing.label_raster(df).collect()}
    assert got == {k: (k[1] + 1, m) for k, m in want.items()}
