"""Typed predictors: columns by kind, failures of a batch, models held by process, scores from vectors."""

import os

import pytest
from pyspark.sql import functions as F

from glyphmill.adapters import typed


class Points:
    def __init__(self, log=None):
        if log:
            with open(log, "a") as f:
                f.write(f"{os.getpid()}\n")

    def predict(self, prompts, images):
        if any(p == "bad" for p in prompts):
            raise ValueError("no answer")
        return [[(k, float(len(p)), float(k)) for k in range(len(p) % 3)] for p in prompts]


class Vectors:
    def predict(self, prompts, images):
        return [[([float(len(i)), 1.0, float("made" in i)],)] for i in images]


class Odd:
    def predict(self, prompts, images):
        return [[(1,)]] * len(prompts)


@pytest.fixture(autouse=True)
def registered(tmp_path):
    kept = dict(typed.REGISTRY)
    log = str(tmp_path / "loads")
    typed.register("points", "points", Points)
    typed.register("logged", "points", lambda: Points(log))
    typed.register("vectors", "vector", Vectors)
    typed.register("odd", "masks", Odd)
    yield log
    typed.REGISTRY.clear()
    typed.REGISTRY.update(kept)


def test_columns_follow_from_the_predictor(spark):
    rows = spark.createDataFrame([(1, "a", "abcd", None), (2, "b", "abc", "x.png")], "id long, tag string, prompt string, image string")
    got = typed.predict(rows, "points")
    assert got.columns == ["id", "tag", "ok", "error", "object_id", "x", "y"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", True, None, 0, 4.0, 0.0), (2, "b", True, None, None, None, None)]
    assert dict(typed.predict(rows, "vectors").dtypes)["vector"] == "array<double>" and dict(typed.predict(rows, "odd").dtypes)["mask_rle"] == "string"
    with pytest.raises(Exception, match="no predictor"):
        typed.predict(rows, "none").collect()
    with pytest.raises(KeyError, match="no kind"):
        typed.register("x", "films", Points)


def test_a_failing_batch_marks_its_own_rows(spark):
    rows = spark.createDataFrame([(i, "bad" if i == 3 else "x" * (i + 5)) for i in range(6)], "id long, prompt string").coalesce(1)
    got = {r.id: (r.ok, r.error) for r in typed.predict(rows, "points", batch=1).collect()}
    assert got[3] == (False, "ValueError: no answer") and all(ok for i, (ok, _) in got.items() if i != 3)
    assert {r.error for r in typed.predict(rows, "odd").collect()} == {"ValueError: the answers don't have the form of their kind"}


def test_batches_are_of_like_length():
    rows = [("x" * n, None) for n in (9, 1, 8, 2, 7)] + [(None, "i")]
    assert typed.batches(rows, 2) == [[5, 1], [3, 4], [2, 0]]


def test_models_are_made_once_in_a_process(spark, registered):
    rows = spark.range(400).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("prompt")).repartition(16)
    assert typed.predict(rows, "logged").select("id").distinct().count() == 400
    assert typed.predict(rows, "logged").select("id").distinct().count() == 400
    loads = open(registered).read().split()
    assert 1 <= len(loads) == len(set(loads)) <= 8


def test_the_last_images_stay_decoded():
    typed._DECODED.clear()
    seen = []
    for path in "abcdaeb":
        typed.decoded(path, lambda p: seen.append(p) or p.upper())
    assert seen == list("abcdeb") and list(typed._DECODED) == ["d", "a", "e", "b"]


def test_similarities(spark):
    pairs = spark.createDataFrame([("s", "gt.png", "made.png"), ("t", "gt.png", "gt.png"), ("u", "gt.png", None)], "id string, one string, other string")
    got = {r.id: r.similarity for r in typed.similarities(pairs, "vectors", "id", "one", "other").collect()}
    assert got["t"] == pytest.approx(1.0) and got["s"] == pytest.approx((6 * 8 + 1) / ((6 * 6 + 1) ** 0.5 * (8 * 8 + 1 + 1) ** 0.5)) and got["u"] is None


def test_score_fills_dino_scores(spark, tmp_path):
    from glyphmill import __main__ as cli
    from glyphmill.sources import files, records

    rows = [("a", "gt.png", "made.png", True, None), ("b", "gt.png", "gt.png", True, None), ("c", "gt.png", None, False, "x")]
    made = spark.createDataFrame(rows, "sample_id string, image_path string, rendered_png_path string, compiled_ok boolean, error string")
    none = {c: F.lit(None).cast("string") for c in ("gt_tex_path", "raw_output", "generated_tex", "compile_log")} | {"latency_s": F.lit(0.5)}
    files.append_lines(records.results(made.withColumns(none)), str(tmp_path / "results"))
    summary = cli.score(spark, cli.parser().parse_args(["score", str(tmp_path), "--embed", "vectors"])).first()
    got = {r.sample_id: r.dino_score for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    assert got["b"] == pytest.approx(1.0) and 0 < got["a"] < 1 and got["c"] is None and summary.n_dino_score == 2
