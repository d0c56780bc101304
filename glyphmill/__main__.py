"""Command line.

``python -m glyphmill list`` names all queries, ``run QUERY SF_DIR`` runs one.
``STAGE DATA_ROOT OUT`` runs one stage of the data engine over a folder of
images, ``benchmark DATA_ROOT OUT`` asks a model for code and renders it, and
``score OUT`` scores what a benchmark wrote.  ``ingest``, ``export``,
``prepare``, ``qa`` and ``validate`` work on annotation records.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.adapters import predictors, typed
from glyphmill.functions import images, masks, png
from glyphmill.functions import text as T
from glyphmill.operators import aggregates, joins, sampling
from glyphmill.plans import catalogue, stages
from glyphmill.session import session
from glyphmill.sources import files, records


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="glyphmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("--master")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(catalogue.QUERIES), metavar="QUERY")
    run.add_argument("sf_dir")
    run.add_argument("--out", help="folder to write Parquet to; without it rows are shown")
    run.add_argument("--limit", type=int, default=20, help="rows to show (0: all)")

    def dataset(p: argparse.ArgumentParser) -> None:
        p.add_argument("data_root")
        p.add_argument("out")
        p.add_argument("--images", default="images", help="folder of images below the data root")
        p.add_argument("--dataset", help="name of the dataset below OUT; else the last part of the data root")
        p.add_argument("--limit", type=int, default=8, help="samples, in order (0: all)")

    for name in stages.Engine.NAMES:
        p = commands.add_parser(name, help=f"stage {name} of the data engine")
        dataset(p)
        for part in ("pointing", "boxing", "segmentation", "edging", "coding", "judging"):
            p.add_argument(f"--{part}", default="stub", help="name of the predictor")
        p.add_argument("--backend", choices=sorted(stages.CODE_QUERY), default="tikz")
        p.add_argument("--keep", type=int, default=stages.KEEP, help="least score that is kept")
    bench = commands.add_parser("benchmark", help="code of a model for a dataset, rendered, as result records")
    dataset(bench)
    bench.add_argument("--model", default="stub")
    bench.add_argument("--seed", type=int, default=0)
    score = commands.add_parser("score", help="scores and a summary of result records, which are replaced")
    score.add_argument("out")
    score.add_argument("--embed", help="name of the predictor of vectors by which images are compared; without it dino_score is null")
    score.add_argument("--judge", help="name of the predictor that judges; without it the judge is skipped")
    ingest = commands.add_parser("ingest", help="a record with proposed instances for each image that has points and none yet")
    ingest.add_argument("points", help="folder of the points, by model")
    ingest.add_argument("records")
    ingest.add_argument("--images", help="folder of the images, whose paths and sizes the records get")
    ingest.add_argument("--model", default="stub")
    ingest.add_argument("--force", action="store_true", help="also where a record is there already")
    for name, text in (("export", "counts of states by image, and totals"), ("prepare", "filled masks of accepted instances, and their manifest"), ("validate", "overlap of filled and accepted masks")):
        p = commands.add_parser(name, help=text)
        p.add_argument("records")
        p.add_argument("out")
    qa = commands.add_parser("qa", help="a sample of prepared masks with the masks they were made from")
    qa.add_argument("records")
    qa.add_argument("manifest")
    qa.add_argument("--rows", type=int, default=20)
    qa.add_argument("--seed", type=int, default=0)
    return out


def _samples(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    found = sampling.with_images(files.discover_images(spark, given.data_root, given.images))
    return sampling.first_n(found, "id", given.limit)


def benchmark(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Result records, appended; each task owns its file."""
    found = sampling.with_images(files.discover_samples(spark, given.data_root))
    chosen = sampling.select_samples(found.select("id", "image_path", "tex_path"), "id", given.limit, given.seed)
    asked = chosen.withColumns({"prompt": F.lit(stages.CODE_QUERY["tikz"]), "image": F.col("image_path")})
    tried = predictors.predict(asked, given.model).withColumn("generated_tex", T.extract_code(F.col("answer"), "tikz"))
    path = f"{given.out.rstrip('/')}/answers"
    tried.write.mode("overwrite").parquet(path)
    answers = spark.read.parquet(path)
    drawn = stages.render(spark, answers.select("id", F.col("generated_tex").alias("code")), "tikz", f"{given.out.rstrip('/')}/renders")
    whole = chosen.join(answers, "id").join(drawn, "id", "left")
    compiled = F.coalesce("render_ok", F.lit(False))
    rows = records.results(
        whole.select(
            F.col("id").alias("sample_id"), "image_path", F.col("tex_path").alias("gt_tex_path"), F.col("answer").alias("raw_output"), "generated_tex", compiled.alias("compiled_ok"),
            F.when(compiled, F.concat(F.col("digest"), F.lit(".png"))).alias("rendered_png_path"), F.coalesce("log", T.failure_reason(F.col("answer"))).alias("compile_log"), F.col("seconds").alias("latency_s"), "error",
        )
    )
    files.append_lines(rows, f"{given.out.rstrip('/')}/results")
    return files.read_lines(spark, f"{given.out.rstrip('/')}/results", records.RESULT)


def score(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """The summary; records get their scores in place."""
    path = f"{given.out.rstrip('/')}/results"
    rows = files.read_lines(spark, path, records.RESULT)
    judged = None
    if given.judge:
        asked = rows.where("compiled_ok AND rendered_png_path IS NOT NULL").select("sample_id", F.col("image_path").alias("image"), F.replace(F.lit(stages.JUDGE_QUERY), F.lit("{png}"), F.col("rendered_png_path")).alias("prompt"))
        rows = rows.join(predictors.predict(asked, given.judge, key="sample_id").select("sample_id", T.judge(F.col("answer")).alias("j")), "sample_id", "left")
        judged = F.col("j")
    dino = None
    if given.embed:
        shown = rows.where("compiled_ok AND rendered_png_path IS NOT NULL")
        rows = rows.join(typed.similarities(shown, given.embed, "sample_id", "image_path", "rendered_png_path"), "sample_id", "left")
        dino = F.col("similarity")
    files.replace_table(records.scored(rows, dino, judged).drop("j", "similarity"), f"{given.out.rstrip('/')}/scored")
    summary = aggregates.evaluation(spark.read.parquet(f"{given.out.rstrip('/')}/scored"), F.col("compiled_ok"), ["dino_score", "judge_score"])
    files.write_single_json(summary, f"{given.out.rstrip('/')}/summary")
    return summary


def ingest(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    points = records.load_points(spark, given.points, given.model).where(F.col("kind") == "node").withColumnRenamed("id", "image_id")
    if not given.force:
        points = joins.skip_existing(points, records.annotated_ids(spark, given.records).withColumnRenamed("id", "image_id"), "image_id")
    in_order = F.array_sort(F.collect_list(F.struct("object_id", "instance")), lambda a, b: F.signum(a["object_id"] - b["object_id"]).cast("int"))
    made = records.proposed(points).groupBy(F.col("image_id").cast("string").alias("id")).agg(F.transform(in_order, lambda x: x["instance"]).alias("all"))
    none = spark.createDataFrame([], "id string, image_path string, width int, height int")
    shown = stages.sized(spark, files.listing(spark, given.images, "*.{png,jpg,jpeg}").select("id", F.col("path").alias("image_path"))).select("id", "image_path", "width", "height") if given.images else none
    stats = F.struct(*[F.lit(0).alias(c) for c in ("points_added", "points_moved", "points_deleted", "masks_manually_fixed")], F.lit(0.0).alias("time_seconds"))
    image = F.struct("id", F.coalesce("image_path", F.lit("")).alias("file_path"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")], F.transform("all", lambda i: i["id"]).alias("instances"), stats.alias("session_stats"))
    texts = made.join(shown, "id", "left").select("id", records.to_json(image, F.col("all")).alias("json"))
    # a write starts from what is there now, so that a person's work in between isn't lost
    now = records.versions(spark, given.records) if given.force and files.exists(spark, given.records) else spark.createDataFrame([], "id string, version string")
    records.write_record(texts.join(now, "id", "left"), given.records)
    return records.annotated_ids(spark, given.records)


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return records.read_records(spark, folder).select("record.*")


def export(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    from glyphmill.operators import review

    shown = _read(spark, given.records).select(F.col("image.id").alias("image_id"), F.explode("instances").alias("i")).select("image_id", F.col("i.state").alias("state"))
    counts = aggregates.state_counts(shown, "image_id", list(review.STATES))
    counts.write.mode("overwrite").json(f"{given.out.rstrip('/')}/by_image")
    totals = aggregates.review_totals(counts, list(review.TERMINAL))
    files.write_single_json(totals, f"{given.out.rstrip('/')}/totals")
    return totals


def filled(accepted: DataFrame) -> DataFrame:
    """Accepted instances with the filled mask, as run lengths and a PNG, and whether opening was kept."""

    def run(parts):
        for part in parts:
            done = [images.fill(masks.decode(masks.from_text(t))) for t in part["rle"]]
            yield part.assign(filled=[masks.to_text(masks.encode(m)) for m, _ in done], png=[png.encode(m) for m, _ in done], opening_applied=[o for _, o in done])

    rows = accepted.select("image_id", "file_path", "width", "height", F.col("instance.id").alias("instance_id"), F.col("instance.mask_source").alias("mask_source"), F.to_json("instance.points").alias("points"), F.col("instance.mask_rle").alias("rle"))
    return rows.mapInPandas(run, "image_id string, file_path string, width int, height int, instance_id string, mask_source string, points string, rle string, filled string, png binary, opening_applied boolean")


def prepare(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    out = given.out.rstrip("/")
    filled(records.accepted(_read(spark, given.records))).write.mode("overwrite").parquet(f"{out}/masks.parquet")
    made = spark.read.parquet(f"{out}/masks.parquet")
    path = F.concat("image_id", F.lit("/"), "instance_id", F.lit(".png"))
    files.write_each(made.select(path.alias("path"), F.col("png").alias("content")), out)
    points = F.from_json("points", "array<struct<x:double,y:double,label:int>>").alias("points")
    made.select("instance_id", "image_id", "file_path", path.alias("mask_path"), "width", "height", points, "mask_source", "opening_applied").write.mode("overwrite").json(f"{out}/manifest")
    return aggregates.counters(made, {"n_opened": F.col("opening_applied")})


def validate(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    made = filled(records.accepted(_read(spark, given.records))).select("image_id", "instance_id", masks.iou(masks.of_text("rle"), masks.of_text("filled")).alias("iou"))
    summary = aggregates.validation(made, "iou")
    records.write_validation(summary, made, given.out)
    return summary


def qa(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    manifest = spark.read.json(f"{given.manifest.rstrip('/')}/manifest")
    chosen = sampling.sample_k(manifest, "instance_id", given.rows, given.seed)
    return joins.with_instances(chosen, _read(spark, given.records))


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = session(master=given.master)
    if given.command == "run":
        df = catalogue.QUERIES[given.query](spark, given.sf_dir)
        if given.out:
            df.write.mode("overwrite").parquet(given.out)
        else:
            df.show(given.limit or df.count(), truncate=False)
        return 0
    if given.command in stages.Engine.NAMES:
        name = given.dataset or given.data_root.rstrip("/").rsplit("/", 1)[-1]
        models = {k: getattr(given, k) for k in ("pointing", "boxing", "segmentation", "edging", "coding", "judging")}
        out = stages.Engine(spark, given.out, name, _samples(spark, given), backend=given.backend, keep=given.keep, **models).run(given.command)
    else:
        out = {"benchmark": benchmark, "score": score, "ingest": ingest, "export": export, "prepare": prepare, "validate": validate, "qa": qa}[given.command](spark, given)
    print(f"{given.command}: {out.count()} rows")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
