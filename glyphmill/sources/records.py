"""Annotation records and result rows: schemas, JSON, new instances, domain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import review
from glyphmill.sources import files, store

# The form of a record, and the domains of its fields.
SCHEMA_VERSION = 1
POINT = "struct<id:string,x:double,y:double,label:int,source:string,original_xy:array<double>>"
EVENT = "struct<timestamp:string,actor:string,action:string,detail:variant>"
INSTANCE = f"struct<id:string,image_id:string,points:array<{POINT}>,mask_rle:string,mask_source:string,state:string,merged_into_id:string,created_at:string,updated_at:string,edit_log:array<{EVENT}>>"
STATS = "struct<points_added:int,points_moved:int,points_deleted:int,masks_manually_fixed:int,time_seconds:double>"
IMAGE = f"struct<id:string,file_path:string,width:int,height:int,instances:array<string>,session_stats:{STATS}>"
RECORD = f"struct<schema_version:int,image:{IMAGE},instances:array<{INSTANCE}>>"
STATUSES = ("done", "pending")
PROPOSED = "molmo"


def ordered_instances(order: Column, instances: Column) -> Column:
    """Instances in the order of the image's list; ids without an instance are skipped, as are instances that the list doesn't name.

    Work grows with the sorting of both lists; only where instances share an id, or lack one, is each looked up in the list.
    """

    def looked_up(order: Column, given: Column) -> Column:
        placed = F.filter(F.transform(given, lambda x: F.struct(F.array_position(order, x["id"]).alias("place"), x.alias("x"))), lambda p: p["place"] > 0)
        return F.transform(F.array_sort(placed, lambda a, b: (a["place"] - b["place"]).cast("int")), lambda p: p["x"])

    def sorted_(named: Column, ids: Column, given: Column) -> Column:
        # both hold the same ids once, so by id they stand side by side: a place in the order beside a place among the instances
        places = F.sort_array(F.transform(F.concat(named, F.array_except(ids, named)), lambda id_, i: F.struct(id_.alias("id"), i.alias("i"))))
        held = F.sort_array(F.transform(ids, lambda id_, j: F.struct(id_.alias("id"), j.alias("j"))))
        beside = F.zip_with(places, held, lambda p, h: F.struct(p["i"].alias("i"), h["j"].alias("j")))
        return F.transform(F.slice(F.sort_array(beside), F.lit(1), F.size(named)), lambda p: F.get(given, p["j"]))

    def read(both: Column) -> Column:
        ids = lambda body: T.let(F.transform(both["given"], lambda x: x["id"]), body)
        once = lambda i: (F.size(F.array_distinct(i)) == F.size(i)) & ~F.exists(i, lambda x: x.isNull())
        by_id = lambda i: T.let(F.array_intersect(both["order"], i), lambda named: sorted_(named, i, both["given"]))
        return ids(lambda i: F.when(once(i), by_id(i)).otherwise(looked_up(both["order"], both["given"])))

    return T.let(F.struct(F.coalesce(order, F.array().cast("array<string>")).alias("order"), instances.alias("given")), read)


def to_json(image: Column, instances: Column) -> Column:
    """A record as JSON."""
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), image.alias("image"), ordered_instances(image["instances"], instances).alias("instances")), {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    return F.from_json(text, RECORD)


def proposed(points: DataFrame, image: str = "image_id") -> DataFrame:
    """One proposed instance for each detected point (image, object_id, x, y): (image, object_id, instance)."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    key = F.substring(F.sha2(F.concat_ws("|", F.col(image).cast("string"), F.col("object_id").cast("string")), 256), 1, 10)
    none = F.lit(None)
    point = F.struct(key.alias("id"), "x", "y", F.lit(1).alias("label"), F.lit(PROPOSED).alias("source"), none.alias("original_xy")).cast(POINT)
    made = F.struct(key.alias("id"), F.col(image).cast("string").alias("image_id"), F.array(point).alias("points"), none.alias("mask_rle"), none.alias("mask_source"), F.lit(review.STATES[0]).alias("state"), none.alias("merged_into_id"), now.alias("created_at"), now.alias("updated_at"), F.array().cast(f"array<{EVENT}>").alias("edit_log"))
    return points.select(image, "object_id", made.cast(INSTANCE).alias("instance"))


def human_touched(instance: Column) -> Column:
    """Whether a person worked on an instance's points, by its log."""
    return review.human_touched(instance["edit_log"], lambda detail: F.try_variant_get(detail, "$.action", "string"))


def accepted(records: DataFrame) -> DataFrame:
    """Accepted instances with a mask, in display order: (image_id, file_path, width, height, place, instance)."""
    shown = records.select(F.col("image.id").alias("image_id"), *[F.col(f"image.{c}").alias(c) for c in ("file_path", "width", "height")], F.posexplode(ordered_instances(F.col("image.instances"), F.col("instances"))).alias("place", "instance"))
    return shown.where((F.col("instance.state") == "accepted") & F.col("instance.mask_rle").isNotNull())


#: The columns of a benchmark record.
RESULT = "sample_id string, image_path string, gt_tex_path string, raw_output string, generated_tex string, compiled_ok boolean, rendered_png_path string, compile_log string, latency_s double, error string"


def results(rows: DataFrame) -> DataFrame:
    """Good and failed rows under one schema, from (sample_id, image_path, gt_tex_path, raw_output, generated_tex, compiled_ok, rendered_png_path, compile_log, latency_s, error).

    A row with an error has no output and no log; a log is kept only of what didn't compile.
    """
    failed = F.col("error").isNotNull()
    ok = ~failed & F.coalesce("compiled_ok", F.lit(False))
    kept = lambda c: F.when(~failed, F.col(c))
    log = F.when(failed | ok, F.lit("")).otherwise(F.col("compile_log"))
    made = {"raw_output": kept("raw_output"), "generated_tex": kept("generated_tex"), "compiled_ok": ok, "rendered_png_path": kept("rendered_png_path"), "compile_log": log}
    return rows.withColumns(made).select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in RESULT.split(", ")])


def scored(records: DataFrame, dino: Column | None = None, judged: Column | None = None) -> DataFrame:
    """Records with dino_score, judge_score and judge_rationale; ``judged`` is a struct (score, reason), None skips the judge."""
    ok = F.col("compiled_ok") & (F.coalesce("rendered_png_path", F.lit("")) != "")
    score = judged["score"] if judged is not None else F.lit(None).cast("int")
    reason = judged["reason"] if judged is not None else F.lit("skipped: --skip-judge")
    return records.withColumns({"dino_score": F.when(ok, dino) if dino is not None else F.lit(None).cast("double"), "judge_score": F.when(ok, score), "judge_rationale": F.when(ok, reason).otherwise(F.lit("skipped: compile failed"))})


def write_record(records: DataFrame, folder: str) -> None:
    """The record of each image (id, json, and the ``version`` it started from; without that column all are new) as ``<id>.json`` below a shared folder: all of them, or none where one has changed since."""
    store.save(records if "version" in records.columns else records.withColumn("version", F.lit(None).cast("string")), folder)


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(id, version) of all records, as writes start from them."""
    return store.load(spark, folder).select("id", "version")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records (id, record) of all files below a folder; a record of another schema version is an error."""
    text = spark.read.option("wholetext", "true").text(f"{folder}/*.json").select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "").alias("id"), F.from_json("value", RECORD).alias("record"))
    version = F.col("record.schema_version")
    return text.withColumn("record", F.when(version == SCHEMA_VERSION, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("schema version of "), "id", F.lit(" is "), F.coalesce(version.cast("string"), F.lit("none")))).cast(RECORD)))


def annotated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all records, in order."""
    return files.listing(spark, folder, "*.json").select("id").orderBy("id")


def write_points(points: DataFrame, path: str) -> None:
    """Points (id, model, kind, object_id, x, y) in a folder for each model."""
    points.write.mode("overwrite").partitionBy("model").parquet(path)


def load_points(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The points of a model; an error names the stage to run first where there are none."""
    if not files.exists(spark, f"{path}/model={model}"):
        raise FileNotFoundError(f"no points of {model} at {path}: run `point` first")
    return spark.read.parquet(path).where(F.col("model") == model).drop("model")


def points_json(points: DataFrame) -> DataFrame:
    """(id, points): the JSON document {nodes, rasters} of each sample."""
    one = F.struct("object_id", "x", "y")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, one)))
    return points.groupBy("id").agg(F.to_json(F.struct(of("node").alias("nodes"), of("raster").alias("rasters"))).alias("points"))


def of_points_json(texts: DataFrame) -> DataFrame:
    """Rows (id, kind, object_id, x, y) of JSON documents (id, points)."""
    kind = "array<struct<object_id:long,x:double,y:double>>"
    read = texts.select("id", F.from_json("points", f"nodes {kind}, rasters {kind}").alias("p"))
    part = lambda name, column: F.transform(f"p.{column}", lambda x: F.struct(F.lit(name).alias("kind"), x["object_id"].alias("object_id"), x["x"].alias("x"), x["y"].alias("y")))
    return read.select("id", F.inline(F.concat(part("node", "nodes"), part("raster", "rasters"))))


def boxes_json(boxes: DataFrame) -> DataFrame:
    """(id, boxes): the JSON document {rasters: [{object_id, box}]} of each sample."""
    one = F.struct("object_id", F.array("x0", "y0", "x1", "y1").alias("box"))
    return boxes.groupBy("id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("rasters"))).alias("boxes"))


def of_boxes_json(texts: DataFrame) -> DataFrame:
    """Rows (id, object_id, x0, y0, x1, y1) of JSON documents (id, boxes)."""
    read = texts.select("id", F.inline(F.from_json("boxes", "rasters array<struct<object_id:long,box:array<double>>>")["rasters"]))
    return read.select("id", "object_id", *[F.col("box")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def manifest_json(items: DataFrame) -> DataFrame:
    """(image_id, items): the JSON list of each image's masks, in order."""
    b = F.col("box")
    one = F.struct("ord", F.struct("id", "text", F.array(b["x0"], b["y0"], b["x1"], b["y1"]).alias("bbox"), F.col("conf").alias("score"), F.col("mask").alias("mask_path"), "is_raster").alias("i"))
    return items.groupBy("image_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["i"])).alias("items"))


def of_manifest_json(texts: DataFrame) -> DataFrame:
    """Items (image_id, ord, id, text, box, mask, conf, is_raster) of JSON lists (image_id, items)."""
    kind = "array<struct<id:string,text:string,bbox:array<double>,score:double,mask_path:string,is_raster:boolean>>"
    read = texts.select("image_id", F.posexplode(F.from_json("items", kind)).alias("ord", "i"))
    box = F.struct(*[F.col("i.bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    return read.select("image_id", "ord", "i.id", "i.text", box.alias("box"), F.col("i.mask_path").alias("mask"), F.col("i.score").alias("conf"), "i.is_raster")


#: The columns of a training log.
LOG = "epoch long, train_loss double, val_loss double, seconds double"


def write_training_log(epochs: DataFrame, path: str) -> None:
    """A row for each epoch as CSV with a header."""
    epochs.select(*[c.split(" ")[0] for c in LOG.split(", ")]).orderBy("epoch").write.mode("overwrite").option("header", "true").csv(path)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).option("header", "true").csv(path)


def write_validation(summary: DataFrame, per_instance: DataFrame, path: str) -> None:
    """The summary row and the rows of all instances, side by side."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_instance.write.mode("overwrite").json(f"{path}/per_instance")


def read_validation(spark: SparkSession, path: str, summary: str, per_instance: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(summary).json(f"{path}/summary"), spark.read.schema(per_instance).json(f"{path}/per_instance")


def checked(writes: DataFrame, users: list[str], samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Writes with a problem column: unknown user, status or sample; null where there is none."""
    known = samples.select(key).distinct().withColumn("__known", F.lit(True))
    problem = F.when(~F.coalesce(F.col("user").isin(*users), F.lit(False)), "unknown user").when(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "unknown status").when(F.col("__known").isNull(), "unknown sample")
    return writes.join(known, key, "left").withColumn("problem", problem).drop("__known")
