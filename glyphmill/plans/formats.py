"""Queries over formats, stores, sinks and stages, with the SQL that checks them; importing this registers them in the catalogue.

Inputs are written in the formats that samples, models and people leave behind,
from columns of the test tables, and what is read back is compared with SQL on
those columns.  Stores are folders of their own for each call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.adapters import predictors
from glyphmill.functions import geometry as G
from glyphmill.functions import losses, masks
from glyphmill.functions import text as T
from glyphmill.operators import aggregates, joins, layout, review, sampling, segmentation
from glyphmill.plans import stages
from glyphmill.plans.catalogue import _BITS, _FSM, ACTIONS, _masks, looked_up, query, r6, table
from glyphmill.sources import files, records
from glyphmill.sources.scratch import folder, stored


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# Layout documents -----------------------------------------------------------


@query("""
    SELECT event_id, 'b' || event_id AS block_id, event_type AS block_text, -(user_id % 50)::DOUBLE AS x0, (event_id % 90) + 0.25::DOUBLE AS y1, 'manual' AS block_src,
           'n1' AS child_id, CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'pointing' END AS raster_src, 'a<b> & "c"' AS node_text, 0.0::DOUBLE AS node_x1,
           CASE WHEN event_id % 3 = 0 THEN 0.1235::DOUBLE END AS conf, user_id::VARCHAR AS src_id, '' AS dst_id, 'som' AS arrow_src, 1 AS n_blocks, 1 AS n_nodes FROM events""")
def xml_parse(spark, sf_dir):
    # a block in a block, an unknown tag, missing attributes, negative and long numbers
    xml = F.concat(
        F.format_string('<diagram>\n  <block i="b%d" t="%s" b="-%d 0 10 %s"><node i="n1" t="" b="1 2 3 4"/><raster i="r" b="1.005 2 3 4"', F.col("event_id"), F.col("event_type"), F.col("user_id") % 50, (F.col("event_id") % 90 + 0.25).cast("string")),
        F.when(F.col("event_id") % 2 == 0, ' src="manual"').otherwise(""),
        F.lit('/><block i="inner" b="0 0 1 1"/></block><odd/><node i="n2" t="a&lt;b&gt; &amp; &quot;c&quot;"'),
        F.when(F.col("event_id") % 3 == 0, ' conf="0.1235"').otherwise(""),
        F.format_string('/><arrow s="%d" src="som"/></diagram>', F.col("user_id")),
    )
    d = files.parse_xml(events(spark, sf_dir).select("event_id", xml.alias("xml")), key="event_id")
    b, n, a = F.col("blocks")[0], F.col("nodes")[0], F.col("arrows")[0]
    return d.select(
        "event_id", b["id"].alias("block_id"), b["text"].alias("block_text"), b["bbox"]["x0"].alias("x0"), b["bbox"]["y1"].alias("y1"), b["src"].alias("block_src"), b["nodes"][0]["id"].alias("child_id"),
        b["rasters"][0]["src"].alias("raster_src"), n["text"].alias("node_text"), n["bbox"]["x1"].alias("node_x1"), n["conf"].alias("conf"), a["src_id"].alias("src_id"), a["dst_id"].alias("dst_id"), a["src"].alias("arrow_src"),
        F.size("blocks").alias("n_blocks"), F.size("nodes").alias("n_nodes"),
    )


@query("""
    SELECT l_orderkey AS image_id, '<diagram>' || chr(10) || string_agg('  <node i="n' || ord || '" t="' || l_returnflag || '&amp;&quot;" b="' || printf('%.2f', l_quantity) || ' 0.00 -1.50 ' || printf('%.2f', l_partkey::DOUBLE) || '"'
             || CASE WHEN ord % 2 = 0 THEN ' conf="0.5000"' ELSE '' END || ' src="sam"/>' || chr(10), '' ORDER BY ord) || '  <arrow s="n1" d="n2" src="som"/>' || chr(10) || '</diagram>' || chr(10) AS xml
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM lineitem) GROUP BY 1""")
def xml_write(spark, sf_dir):
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_quantity", "l_partkey", "l_returnflag", ord_.alias("ord"))
    box = F.struct(F.col("l_quantity").alias("x0"), F.lit(0.0).alias("y0"), F.lit(-1.5).alias("x1"), F.col("l_partkey").cast("double").alias("y1"))
    item = F.struct(F.concat(F.lit("n"), "ord").alias("id"), F.concat("l_returnflag", F.lit('&"')).alias("text"), box.alias("bbox"), F.lit(None).cast("string").alias("mask"), F.when(F.col("ord") % 2 == 0, 0.5).alias("conf"), F.lit(layout.DETECTED).alias("src")).cast(layout.ITEM)
    arrow = F.struct(F.lit("n1").alias("src_id"), F.lit("n2").alias("dst_id"), F.lit(None).cast("double").alias("conf"), F.lit(layout.DISCOVERED).alias("src")).cast(layout.ARROW)
    nodes = F.sort_array(F.collect_list(F.struct("ord", item.alias("i"))))["i"]
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return files.write_xml(lines.groupBy("image_id").agg(nodes.alias("nodes")).select("image_id", none(layout.BLOCK).alias("blocks"), "nodes", none(layout.ITEM).alias("rasters"), F.array(arrow).alias("arrows")))


@query("""SELECT event_id, -(user_id::DOUBLE) AS x0, value AS y0, 3.0::DOUBLE AS x1, 4.5::DOUBLE AS y1, '-' || user_id || '.00 1.00 3.00 4.50' AS rendered FROM events""")
def box_text(spark, sf_dir):
    text = F.concat(F.lit(" -"), F.col("user_id").cast("string"), F.lit("\t"), F.col("value").cast("string"), F.lit("  3 4.50 "))
    back = F.struct((-F.col("user_id").cast("double")).alias("x0"), F.lit(1.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(4.5).alias("y1"))
    return events(spark, sf_dir).select("event_id", T.parse_box(text).alias("b"), T.box_text(back).alias("rendered")).select("event_id", "b.*", "rendered")


@query("""
    SELECT user_id, string_agg(CASE WHEN event_type = 'view' THEN 'b' ELSE 'n' END || event_id, ' ' ORDER BY CASE event_type WHEN 'view' THEN 0 ELSE 1 END, event_id) AS marks FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def mark_ids(spark, sf_dir):
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    part = lambda kind, letter: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("event_id")))), lambda i: F.struct(F.concat(F.lit(letter), i.cast("string")).alias("id")))
    grouped = e.groupBy("user_id").agg(part("view", "b").alias("b"), part("click", "n").alias("nodes"))
    blocks = F.transform("b", lambda x: F.struct(x["id"].alias("id"), F.array().cast("array<struct<id:string>>").alias("nodes")))
    return grouped.select("user_id", F.array_join(layout.markable(blocks, F.col("nodes")), " ").alias("marks"))


@query("""SELECT event_id, 'n' || (user_id % 5) AS src_id, 'n' || (event_id % 4) AS dst_id, 'som' AS src FROM events WHERE user_id % 5 < 4 AND user_id % 5 <> event_id % 4""")
def mark_edges(spark, sf_dir):
    # marks 0 to 3 are known; a loop or another mark gives no arrow
    marks = F.array(*[F.lit(f"n{k}") for k in range(4)])
    answer = F.format_string('[{"from": %d, "to": %d}, {"from": -1, "to": 0}]', F.col("user_id") % 5, F.col("event_id") % 4)
    return events(spark, sf_dir).select("event_id", F.explode(layout.mark_edges(marks, T.edges(answer))).alias("a")).select("event_id", "a.src_id", "a.dst_id", "a.src")


# Samples --------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of code and image files that fall into folders in all the ways that matter: (path, name, id)."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    home = F.concat(F.lit("/data/s"), n)
    code = F.concat(home, F.lit("/fig.tex"))
    own = F.array(F.concat(home, F.lit("/fig.jpg")), F.concat(home, F.lit("/fig.png")), F.concat(home, F.lit("/input.png")))
    named = F.array(F.concat(home, F.lit("/image.png")), F.concat(home, F.lit("/input.jpeg")), F.concat(home, F.lit("/a.png")))
    first = F.array(F.concat(home, F.lit("/b.png")), F.concat(home, F.lit("/a.PNG")), F.concat(home, F.lit("/A.Png")), F.concat(home, F.lit("/crops/0.png")))
    crops = F.array(F.concat(home, F.lit("/crops/z.png")), F.concat(home, F.lit("/crops/deep/er/1.jpg")), F.concat(home, F.lit("/other/0.png")))
    images = F.when(k == 0, own).when(k == 1, named).when(k == 2, first).when(k == 3, crops).when(k == 4, F.array(F.concat(home, F.lit("/notes.txt")))).otherwise(F.array().cast("array<string>"))
    path = events(spark, sf_dir).select(F.explode(F.concat(F.array(code), images)).alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    return path.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("id"))


@query("""
    SELECT 's' || event_id || '/fig' AS id, '/data/s' || event_id || CASE event_id % 6 WHEN 0 THEN '/fig.png' WHEN 1 THEN '/input.jpeg' WHEN 2 THEN '/a.PNG' ELSE '/crops/deep/er/1.jpg' END AS image_path FROM events WHERE event_id % 6 < 4""")
def best_image(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    samples = paths.where(F.col("name").endswith(".tex")).select(F.regexp_replace(F.regexp_replace("path", "^/data/", ""), r"\.tex$", "").alias("id"), F.col("path").alias("tex_path"))
    return files.best_images(paths, samples).select("id", "image_path")


@query("""SELECT 'i' || user_id AS id, CASE WHEN bool_or(event_id % 3 = 0) THEN '/d/i' || user_id || '.png' WHEN bool_or(event_id % 3 = 1) THEN '/d/i' || user_id || '.jpg' ELSE '/d/i' || user_id || '.jpeg' END AS path FROM events GROUP BY user_id""")
def image_of_id(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".png"), F.lit(".jpg"), F.lit(".jpeg")), (F.col("event_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("i"), F.col("user_id").cast("string"), ending)
    rows = events(spark, sf_dir).select(F.concat(F.lit("/d/"), name).alias("path"), name.alias("name"), F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("id"))
    return files.image_of_id(rows.distinct())


@query("""SELECT doc_id AS id, lang, 'docs/' || doc_id || '.png' AS image_path FROM documents WHERE lang IS NOT NULL AND doc_id % 3 <> 0 ORDER BY doc_id""")
def samples_with_images(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("image_path"))
    return sampling.select_samples(sampling.with_images(docs).where(F.col("lang").isNotNull()), "id", 0, 0)


# Stores and sinks -----------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "raster").otherwise("node")
    model = F.when(F.col("user_id") % 2 == 0, "m0").otherwise("m1")
    return events(spark, sf_dir).select(F.col("user_id").alias("id"), model.alias("model"), kind.alias("kind"), F.col("event_id").alias("object_id"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"))


@query("""SELECT user_id AS id, CASE WHEN event_id % 3 = 0 THEN 'raster' ELSE 'node' END AS kind, event_id AS object_id, value AS x, value / 2 AS y FROM events WHERE user_id % 2 = 1""")
def points_store(spark, sf_dir):
    path = folder(spark, "points")
    records.write_points(_points(spark, sf_dir), path)
    return records.load_points(spark, path, "m1").select("id", "kind", "object_id", "x", "y")


@query("""SELECT user_id AS id, count(*) FILTER (event_id % 3 <> 0) AS n_nodes, count(*) FILTER (event_id % 3 = 0) AS n_rasters, sum(event_id) FILTER (event_id % 3 = 0) AS raster_ids FROM events GROUP BY 1""")
def points_json(spark, sf_dir):
    read = records.of_points_json(records.points_json(_points(spark, sf_dir)))
    return read.groupBy("id").agg(F.count_if(F.col("kind") == "node").alias("n_nodes"), F.count_if(F.col("kind") == "raster").alias("n_rasters"), F.sum(F.when(F.col("kind") == "raster", F.col("object_id"))).alias("raster_ids"))


@query("""SELECT user_id AS id, event_id AS object_id, value AS x0, 1.0::DOUBLE AS y0, value + 2 AS x1, 3.5::DOUBLE AS y1 FROM events WHERE event_id % 5 = 0""")
def boxes_json(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("event_id") % 5 == 0).select(F.col("user_id").alias("id"), F.col("event_id").alias("object_id"), F.col("value").alias("x0"), F.lit(1.0).alias("y0"), (F.col("value") + 2).alias("x1"), F.lit(3.5).alias("y1"))
    path = folder(spark, "boxes")
    records.boxes_json(rows).write.json(path)
    return records.of_boxes_json(spark.read.schema("id long, boxes string").json(path))


@query("""SELECT user_id AS image_id, CASE WHEN event_id % 3 = 0 THEN 'raster_' ELSE 'node_' END || event_id AS id, value AS x0, value + 9 AS x1, 0.5::DOUBLE AS conf, event_id % 3 = 0 AS is_raster,
       user_id || '/' || CASE WHEN event_id % 3 = 0 THEN 'raster_' ELSE 'node_' END || event_id || '_' || left(sha256(CASE WHEN event_id % 3 = 0 THEN 'raster_' ELSE 'node_' END || event_id), 8) || '.png' AS mask FROM events""")
def mask_manifest(spark, sf_dir):
    name = F.concat(F.when(F.col("event_id") % 3 == 0, "raster_").otherwise("node_"), F.col("event_id").cast("string"))
    box = F.struct(F.col("value").alias("x0"), F.lit(0.0).alias("y0"), (F.col("value") + 9).alias("x1"), F.lit(4.0).alias("y1"))
    rows = events(spark, sf_dir).select(F.col("user_id").alias("image_id"), F.col("event_id").alias("ord"), name.alias("id"), name.alias("text"), box.alias("box"), stages.mask_file(F.col("user_id").cast("string"), name).alias("mask"), F.lit(0.5).alias("conf"), (F.col("event_id") % 3 == 0).alias("is_raster"))
    back = records.of_manifest_json(records.manifest_json(rows))
    return back.select("image_id", "id", "box.x0", "box.x1", "conf", "is_raster", "mask")


@query("""SELECT event_id AS id, event_type || value AS raw, CASE WHEN event_id % 2 = 0 THEN '<svg>' || event_id || '</svg>' END AS code FROM events""")
def code_sink(spark, sf_dir):
    raw = F.concat("event_type", F.col("value").cast("string"))
    path = folder(spark, "code")
    events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("svg").alias("backend"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<svg>"), F.col("event_id").cast("string"), F.lit("</svg>"))).alias("code"), raw.alias("raw")).write.partitionBy("backend").parquet(path)
    return spark.read.schema("id long, raw string, code string").parquet(f"{path}/backend=svg").select("id", F.concat(F.lit(""), "raw").alias("raw"), "code")


@query("""SELECT event_id, event_type, value FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, event_type, value FROM events WHERE user_id % 2 = 1""")
def shard_union(spark, sf_dir):
    # each shard appends files of its own; the folder is their union
    path, schema = folder(spark, "log"), "event_id long, event_type string, value double"
    for shard in range(2):
        files.append_lines(events(spark, sf_dir).where(F.col("user_id") % 2 == shard).select("event_id", "event_type", "value"), path)
    return files.read_lines(spark, path, schema)


@query("""SELECT event_id, value * 2 AS value FROM events""")
def rewrite_in_place(spark, sf_dir):
    path = folder(spark, "rewritten")
    files.replace_table(events(spark, sf_dir).select("event_id", "value"), path)
    files.replace_table(spark.read.parquet(path).withColumn("value", F.col("value") * 2), path)
    return spark.read.parquet(path)


@query("""
    SELECT user_id::VARCHAR AS sample_id, max(event_id) % 5 + 1 AS judge_score, (max(event_id) % 5 + 1) >= 4 AS kept FROM events WHERE user_id % 3 = 0 GROUP BY 1
    UNION ALL SELECT user_id::VARCHAR, min(event_id) % 5 + 1, (min(event_id) % 5 + 1) >= 4 FROM events WHERE user_id % 3 <> 0 GROUP BY 1""")
def judge_summary(spark, sf_dir):
    # two runs: all samples, then a third of them again; the latest row of each counts
    by_user = events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    row = lambda score: [F.col("user_id").cast("string").alias("sample_id"), (score % 5 + 1).alias("judge_score"), aggregates.keep_gate(score % 5 + 1).alias("kept")]
    path = folder(spark, "summary")
    files.append_run(by_user.select(*row(F.col("lo"))), path, "sample_id")
    return files.append_run(by_user.where(F.col("user_id") % 3 == 0).select(*row(F.col("hi"))), path, "sample_id")


@query("""SELECT event_id % 7 AS epoch, round(avg(value), 6) AS train_loss, round(avg(value) + 1, 6) AS val_loss, 1.5::DOUBLE AS seconds FROM events GROUP BY 1""")
def training_log(spark, sf_dir):
    path = folder(spark, "log")
    epochs = aggregates.epoch_losses(events(spark, sf_dir).select((F.col("event_id") % 7).alias("epoch"), F.col("value").alias("loss")))
    records.write_training_log(epochs.select("epoch", F.col("mean_loss").alias("train_loss"), (F.col("mean_loss") + 1).alias("val_loss"), F.lit(1.5).alias("seconds")), path)
    return records.read_training_log(spark, path).select("epoch", r6("train_loss").alias("train_loss"), r6("val_loss").alias("val_loss"), "seconds")


@query("""SELECT count(*) AS n, round(avg(value), 6) AS mean, (SELECT count(*) FROM events WHERE value >= 50) AS good, max(event_id) AS last_id FROM events""")
def validation_json(spark, sf_dir):
    path = folder(spark, "validation")
    rows = events(spark, sf_dir).select("event_id", "value")
    records.write_validation(rows.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean")), rows, path)
    summary, each = records.read_validation(spark, path, "n long, mean double", "event_id long, value double")
    return each.agg(F.count_if(F.col("value") >= 50).alias("good"), F.max("event_id").alias("last_id")).crossJoin(summary)  # one row each


@query("""SELECT 's' || (event_id % 40) AS image_id, 'p' || event_id AS id, trunc(value)::INT AS x, -trunc(value / 3)::INT AS y FROM events""")
def seed_points(spark, sf_dir):
    path = folder(spark, "seeds")
    entry = F.struct(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("id"), F.col("value").alias("x"), (-F.col("value") / 3).alias("y"))
    lists = events(spark, sf_dir).groupBy(F.concat(F.lit("s"), (F.col("event_id") % 40).cast("string")).alias("image_id")).agg(F.to_json(F.collect_list(entry)).alias("j"))
    files.write_each(lists.select(F.concat("image_id", F.lit(".json")).alias("path"), F.encode("j", "utf-8").alias("content")), path)
    return segmentation.seeds(spark, path)


# Records of annotations -----------------------------------------------------


def _record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each user as an image, as the annotation tool writes it: (id, json)."""
    pos = F.when(F.col("value") > 20, 1).otherwise(0)
    mask = F.when(F.col("event_id") % 3 != 0, '{"size": [2, 2], "counts": "04"}')
    original = F.when(F.col("event_type") == "click", F.array("value", F.lit(2.0)))
    source = F.when(F.col("event_type") == "click", review.MOVED).otherwise(review.PROPOSED)
    point = F.struct(F.lit("p").alias("id"), F.col("value").alias("x"), F.lit(1.0).alias("y"), pos.alias("label"), source.alias("source"), original.alias("original_xy"))
    detail = F.to_json(F.struct(F.lit("proposed").alias("from"), F.when(F.col("event_type") == "view", "confirm_points").otherwise("open_points").alias("action")))
    event = F.struct(F.lit("2024-01-01T00:00:00+00:00").alias("timestamp"), F.lit("human").alias("actor"), F.when(F.col("event_type") == "click", "point_move").otherwise("state_change").alias("action"), F.parse_json(detail).alias("detail"))
    state = F.when(F.col("event_type").isin("click", "view"), "accepted").otherwise("proposed")
    inst = F.struct(F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("id"), F.col("user_id").cast("string").alias("image_id"), F.array(point).alias("points"), mask.alias("mask_rle"), F.lit("sam3_auto").alias("mask_source"), state.alias("state"), F.lit(None).cast("string").alias("merged_into_id"), F.lit("").alias("created_at"), F.lit("").alias("updated_at"), F.array(event).alias("edit_log"))
    # the list names instances backwards, one that isn't there, and not the last one
    grouped = events(spark, sf_dir).select("user_id", "event_id", inst.alias("i")).groupBy("user_id").agg(F.collect_list("i").alias("all"), F.sort_array(F.collect_list("event_id"), asc=False).alias("ids"))
    order = F.concat(F.array(F.lit("gone")), F.transform(F.slice("ids", 2, 1 << 30), lambda x: F.concat(F.lit("i"), x.cast("string"))))
    stats = F.struct(F.lit(1).alias("points_added"), F.lit(0).alias("points_moved"), F.lit(0).alias("points_deleted"), F.lit(0).alias("masks_manually_fixed"), F.lit(1.5).alias("time_seconds"))
    image = F.struct(F.col("user_id").cast("string").alias("id"), F.lit("x.png").alias("file_path"), F.lit(2).alias("width"), F.lit(2).alias("height"), order.alias("instances"), stats.alias("session_stats"))
    return grouped.select(F.col("user_id").cast("string").alias("id"), records.to_json(image, F.col("all")).alias("json"))


_LISTED = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), s AS (SELECT * FROM l WHERE k > 1) "


@query(_LISTED + """SELECT user_id::VARCHAR AS id, (k - 2)::INT AS place, 'i' || event_id AS instance, value AS x, CASE WHEN event_type = 'click' THEN value END AS original_x, event_type IN ('click', 'view') AS touched, 1.5::DOUBLE AS time_seconds FROM s""")
def record_store(spark, sf_dir):
    path = folder(spark, "records")
    records.write_record(_record_texts(spark, sf_dir), path)
    read = records.read_records(spark, path)
    shown = read.select("id", "record.image.session_stats.time_seconds", F.posexplode(records.ordered_instances(F.col("record.image.instances"), F.col("record.instances"))).alias("place", "i"))
    return shown.select("id", "place", F.col("i.id").alias("instance"), F.col("i.points")[0]["x"].alias("x"), F.get(F.col("i.points")[0]["original_xy"], F.lit(0)).alias("original_x"), records.human_touched(F.col("i")).alias("touched"), "time_seconds")


@query(_LISTED + """, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS r FROM s)
    SELECT user_id::VARCHAR AS image_id, (k - 2)::INT AS place, 'i' || event_id AS instance_id FROM a WHERE event_type IN ('click', 'view') AND event_id % 3 <> 0""")
def accepted_instances(spark, sf_dir):
    parsed = _record_texts(spark, sf_dir).select(records.from_json(F.col("json")).alias("r")).select("r.*")
    return records.accepted(parsed).select("image_id", "place", F.col("instance.id").alias("instance_id"))


@query(_LISTED + """SELECT user_id::VARCHAR AS image_id, 'i' || event_id AS instance_id, event_id % 3 <> 0 AS has_mask FROM events WHERE event_id % 4 = 0 AND event_id NOT IN (SELECT event_id FROM l WHERE k = 1)
    UNION ALL SELECT user_id::VARCHAR, 'i' || event_id, false FROM l WHERE event_id % 4 = 0 AND k = 1""")
def manifest_join(spark, sf_dir):
    manifest = events(spark, sf_dir).where(F.col("event_id") % 4 == 0).select(F.col("user_id").cast("string").alias("image_id"), F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("instance_id"))
    parsed = _record_texts(spark, sf_dir).select(records.from_json(F.col("json")).alias("r")).select("r.*")
    return joins.with_instances(manifest, parsed).select("image_id", "instance_id", F.col("mask_rle").isNotNull().alias("has_mask"))


@query("""SELECT event_id, event_type <> 'error' AND value > 20 AS acceptable, event_type IN ('view', 'click', 'signup') AS is_open, (value > 20)::INT AS n_positive FROM events""")
def accept_rules(spark, sf_dir):
    state = F.when(F.col("event_type") == "view", "proposed").when(F.col("event_type") == "click", "needs_point_review").when(F.col("event_type") == "signup", "needs_mask_review").otherwise("merged")
    points = F.array(F.struct(F.when(F.col("value") > 20, 1).otherwise(0).alias("label")), F.struct(F.lit(0).alias("label")))
    return events(spark, sf_dir).select("event_id", review.can_accept(points, F.when(F.col("event_type") != "error", F.lit("m"))).alias("acceptable"), review.unresolved(state).alias("is_open"), F.size(review.positive_points(points)).alias("n_positive"))


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'unknown user' WHEN event_type = 'error' THEN 'unknown status' WHEN event_id % 3 = 0 THEN 'unknown sample' END AS problem FROM events""")
def write_checks(spark, sf_dir):
    writes = events(spark, sf_dir).select("event_id", F.col("event_id").cast("string").alias("sample_id"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("user"), F.when(F.col("event_type") == "error", "odd").when(F.col("event_type") == "view", "done").alias("status"))
    return records.checked(writes, ["u1", "u2", "u3"], writes.where(F.col("event_id") % 3 != 0).select("sample_id")).select("event_id", "problem")


@query("""SELECT event_id::VARCHAR AS sample_id, event_type <> 'error' AND value > 30 AS compiled_ok, CASE WHEN event_type <> 'error' THEN 'raw' END AS raw_output, CASE WHEN event_type = 'error' OR value > 30 THEN '' ELSE 'log' END AS compile_log,
       CASE WHEN event_type = 'error' THEN 'bad' END AS error, CASE WHEN event_type <> 'error' AND value > 30 THEN 'skipped: --skip-judge' ELSE 'skipped: compile failed' END AS judge_rationale FROM events""")
def result_records(spark, sf_dir):
    made = {"image_path": F.lit("i"), "gt_tex_path": F.lit("t"), "raw_output": F.lit("raw"), "generated_tex": F.lit("x"), "compiled_ok": F.col("value") > 30, "rendered_png_path": F.when(F.col("value") > 30, "p"), "compile_log": F.lit("log"), "latency_s": F.lit(0.5), "error": F.when(F.col("event_type") == "error", "bad")}
    rows = records.results(events(spark, sf_dir).select(F.col("event_id").alias("sample_id"), "event_type", "value").withColumns(made))
    return records.scored(rows).select("sample_id", "compiled_ok", "raw_output", "compile_log", "error", "judge_rationale")


@query("""SELECT user_id % 4 AS shard, count(*) AS n_done, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (value >= 50) AS n_kept FROM events GROUP BY 1""")
def shard_counters(spark, sf_dir):
    return aggregates.counters(events(spark, sf_dir).withColumn("shard", F.col("user_id") % 4), {"n_ok": F.col("event_type") != "error", "n_kept": F.col("value") >= 50}, ["shard"])


# Review events --------------------------------------------------------------


@query(_FSM + """SELECT r.user_id, r.k AS step, r.state AS from_state, t.d AS to_state, e.action FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 JOIN t ON t.s = r.state AND t.a = e.action""")
def audit_events(spark, sf_dir):
    acted = events(spark, sf_dir).withColumn("action", looked_up(ACTIONS, "event_type"))
    numbered = acted.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    return review.audit(numbered, "user_id", ["step"]).select("user_id", "step", F.col("from").alias("from_state"), F.col("to").alias("to_state"), "action")


_SESSION = {"view": "activate", "click": "add_positive", "purchase": "confirm_points", "error": "delete_positive", "signup": "accept"}


@query("""
    WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SESSION.items()) + """ END AS a FROM events),
    t(s, a, d) AS (VALUES """ + ", ".join(f"('{s}', '{a}', '{d}')" for (s, a), d in review.TRANSITIONS.items()) + """), run AS (
      SELECT user_id, 0::BIGINT AS k, 'proposed' AS state, 0 AS n, false AS mask FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, k, CASE WHEN again AND n2 = 0 AND state2 = 'needs_mask_review' THEN 'needs_point_review' ELSE state2 END, n2, CASE WHEN again THEN n2 > 0 ELSE mask END FROM (
        SELECT *, a IN ('add_positive', 'delete_positive') OR (a = 'confirm_points' AND state2 <> state) AS again FROM (
          SELECT x.*, coalesce(t.d, x.state) AS state2 FROM (
            SELECT r.user_id, r.k + 1 AS k, r.state, r.mask, e.a, greatest(r.n + CASE e.a WHEN 'add_positive' THEN 1 WHEN 'delete_positive' THEN -1 ELSE 0 END, 0) AS n2,
                   CASE WHEN e.a = 'activate' AND r.state = 'proposed' THEN CASE WHEN r.mask THEN 'open_mask' ELSE 'open_points' END
                        WHEN e.a IN ('add_positive', 'delete_positive') AND r.state = 'needs_mask_review' THEN 'back_to_points'
                        WHEN e.a = 'accept' AND NOT (r.n > 0 AND r.mask) THEN NULL WHEN e.a = 'confirm_points' AND r.n = 0 THEN NULL ELSE e.a END AS meant
            FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) x LEFT JOIN t ON t.s = x.state AND t.a = x.meant)))
    SELECT user_id, arg_max(state, k) AS state, arg_max(n, k) AS n_positive, arg_max(mask, k) AS has_mask FROM run GROUP BY 1""")
def edit_sessions(spark, sf_dir):
    acted = events(spark, sf_dir).withColumn("action", looked_up(_SESSION, "event_type"))
    return review.edit_session(acted, "user_id", ["ts", "event_id"]).select("user_id", "state", "n_positive", "has_mask")


@query("""
    WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
    SELECT user_id, max(k) AS n_edits, 's' || max(event_id) FILTER (k = 1) AS state FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) GROUP BY 1""")
def undo_redo(spark, sf_dir):
    # every edit is undone and redone before the next one, so the last edit's state is the current one
    steps = F.array(F.struct(F.lit(0).alias("s"), F.lit("edit").alias("action")), F.struct(F.lit(1).alias("s"), F.lit("undo").alias("action")), F.struct(F.lit(2).alias("s"), F.lit("redo").alias("action")))
    log = events(spark, sf_dir).select("user_id", "event_id", F.inline(steps)).select("user_id", (F.col("event_id") * 3 + F.col("s")).alias("at"), "action", F.when(F.col("action") == "edit", F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("state"))
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_edits"))
    return review.undo_stack(log, "user_id", "at").where(F.size("undo") <= review.UNDO_LIMIT + 1).select("user_id", "state").join(n, "user_id")


# Geometry of answers and screens ---------------------------------------------


@query("""SELECT event_id, r.reading, CASE r.reading WHEN 'raw_pixels' THEN 20.0 ELSE round(20.0 / 1000 * 640, 6) END::DOUBLE AS x0, CASE r.reading WHEN 'raw_pixels' THEN value ELSE round(value / 1000 * 480, 6) END AS y0,
       CASE r.reading WHEN 'raw_pixels' THEN 500.0 ELSE 320.0 END::DOUBLE AS x1, CASE r.reading WHEN 'raw_pixels' THEN value + 1 ELSE round((value + 1) / 1000 * 480, 6) END AS y1 FROM events, (VALUES ('raw_pixels'), ('div1000_x_w_h')) r(reading)""")
def frame_readings(spark, sf_dir):
    sides = F.array(F.col("value"), F.lit(20.0), F.col("value") + 1, F.lit(500.0))
    read = events(spark, sf_dir).select("event_id", F.inline(G.frame_readings(sides, F.lit(640.0), F.lit(480.0))))
    return read.select("event_id", "reading", *[F.when(F.col("reading") == "raw_pixels", F.col(c)).otherwise(r6(c)).alias(c) for c in G.SIDES])


@query("""SELECT event_id, round(value / 2.5 + user_id, 6) AS x, value / 2.5 + user_id >= 0 AND value / 2.5 + user_id < 60 AND event_id % 40 < 30 AS inside FROM events""")
def display_points(spark, sf_dir):
    x = G.display_to_image(F.col("value"), F.col("user_id"), F.lit(2.5))
    return events(spark, sf_dir).select("event_id", r6(x).alias("x"), G.in_image(x, F.col("event_id") % 40, F.lit(60), F.lit(30)).alias("inside"))


@query(_BITS + """SELECT vec_id, greatest(coalesce(min(i // 8) FILTER (bit), 0) - 2, 0)::DOUBLE AS x0, greatest(coalesce(min(i % 8) FILTER (bit), 0) - 2, 0)::DOUBLE AS y0,
       least(coalesce(max(i // 8) FILTER (bit), 0) + 2, 8)::DOUBLE AS x1, least(coalesce(max(i % 8) FILTER (bit), 0) + 2, 8)::DOUBLE AS y1 FROM b GROUP BY 1""")
def mask_crops(spark, sf_dir):
    bounds = _masks(spark, sf_dir).select("vec_id", masks.bbox("mask").alias("b"))
    return bounds.select("vec_id", G.mask_crop(F.col("b"), 2, F.lit(8), F.lit(8)).alias("c")).select("vec_id", *[F.col(f"c.{s}").cast("double").alias(s) for s in G.SIDES])


# Masks and stages -----------------------------------------------------------


@query(_BITS + "SELECT vec_id, row_number() OVER (ORDER BY count(*) FILTER (bit) DESC, vec_id) AS place FROM b GROUP BY 1 QUALIFY place <= 50")
def masks_by_area(spark, sf_dir):
    top = masks.largest(_masks(spark, sf_dir), "vec_id", 50)
    return top.select("vec_id", F.row_number().over(Window.orderBy(F.desc("area"), "vec_id")).cast("long").alias("place"))  # 50 rows


@query("""SELECT user_id % 40 AS image_id, sum(event_id) AS ids, count(*) FILTER (value >= 0) AS n_points, count(*) FILTER (event_id % 3 = 0) AS n_rasters FROM events GROUP BY 1""")
def stage_join(spark, sf_dir):
    # points, their masks and their diagram's image, stage by stage
    points = events(spark, sf_dir).select((F.col("user_id") % 40).alias("image_id"), F.col("event_id").alias("object_id"), "value", (F.col("event_id") % 3 == 0).alias("is_raster"))
    held = points.select("image_id", "object_id", F.col("object_id").alias("mask"))
    return joins.of_stages(points, held, points.select("image_id").distinct()).groupBy("image_id").agg(F.sum("mask").alias("ids"), F.count("value").alias("n_points"), F.count_if("is_raster").alias("n_rasters"))


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding, lambda e, i: CASE WHEN (i + vec_id) % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t FROM embeddings),
    z AS (SELECT vec_id, list_transform(list_zip(x, t), lambda z: {'x': z[1], 't': z[2]}) AS z FROM v), e AS (SELECT vec_id, unnest(z).x AS x, unnest(z).t AS t FROM z)
    SELECT vec_id, round(1 - (2 * sum(t / (1 + exp(-x))) + 1) / (sum(1 / (1 + exp(-x))) + sum(t) + 1), 6) AS dice, round(avg(greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))), 6) AS bce,
           round(pow(0.5 - count(*) FILTER (x > 0 AND t > 0) / greatest(count(*) FILTER (x > 0 OR t > 0), 1), 2), 6) AS overlap_error FROM e GROUP BY 1""")
def mask_losses(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    t = F.transform("embedding", lambda v, i: F.when((i + 1 + F.col("vec_id")) % 3 == 0, 1.0).otherwise(0.0))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), t.alias("t"))
    x, t = F.col("x"), F.col("t")
    return rows.select("vec_id", r6(losses.dice_of(x, t)).alias("dice"), r6(losses.cross_entropy_of(x, t)).alias("bce"), r6(losses.overlap_error_of(F.lit(0.5), x, t)).alias("overlap_error"))


def _rule(mark: str, answer: str) -> str:
    """A scripted predictor, registered by a name of its own."""
    name = f"rule {mark} {answer}"
    predictors.REGISTRY[name] = lambda: predictors.Scripted({mark: answer})
    return name


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("x.png").alias("image_path"), F.lit(100).alias("width"), F.lit(200).alias("height"))


@query("""SELECT 'd' || doc_id AS id, k.kind, k.object_id, k.x, k.y FROM documents, (VALUES ('node', 0, 10.0::DOUBLE, 40.0::DOUBLE), ('node', 1, 60.0, 60.0), ('raster', 0, 50.0, 100.0)) k(kind, object_id, x, y)""")
def stage_point(spark, sf_dir):
    name = "points of two kinds"
    predictors.REGISTRY[name] = lambda: predictors.Scripted({"shape": '<points coords="0 100 200, 1 600 300">', "picture": '<points coords="0 500 500">'})
    return stages.point(_samples(spark, sf_dir), name)


@query("""SELECT 'd' || doc_id AS id, 0 AS object_id, 1.0::DOUBLE AS x0, 2.0::DOUBLE AS y0, 30.0::DOUBLE AS x1, 40.0::DOUBLE AS y1 FROM documents WHERE doc_id % 2 = 0""")
def stage_box(spark, sf_dir):
    # samples without a hint of a picture cost no call
    samples = _samples(spark, sf_dir)
    points = samples.select("id", F.when(F.substring("id", -1, 1).cast("int") % 2 == 0, "raster").otherwise("node").alias("kind"), F.lit(0).alias("object_id"), F.lit(5.0).alias("x"), F.lit(6.0).alias("y"))
    return stages.box(samples, points, _rule("id 0: (5.0, 6.0)", '[{"object_id": 0, "box": [1, 2, 30, 40]}, {"object_id": 9, "box": [1, 2, 3, 4]}]'))


@query("""SELECT 'd' || doc_id AS image_id, 'node_0' AS id, 1.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 2.0::DOUBLE AS x1, 3.0::DOUBLE AS y1, 0.75::DOUBLE AS conf, 1 AS n_nodes, 0 AS n_blocks FROM documents""")
def stage_segment_assemble(spark, sf_dir):
    mask = masks.to_text({"h": 4, "w": 5, "counts": [4, 8, 8]})
    samples = _samples(spark, sf_dir)
    points = samples.select("id", F.lit("node").alias("kind"), F.lit(0).alias("object_id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    # kept between the stages, as the engine keeps it, so that the model answers each point once
    manifest = stored(stages.segment(samples, points, _rule('"point":[1.0,2.0]', mask[:-1] + ', "score": 0.75}')), "manifest")
    n = F.col("nodes")[0]
    return stages.assemble(manifest).select("image_id", n["id"].alias("id"), *[n["bbox"][s].alias(s) for s in G.SIDES], n["conf"].alias("conf"), F.size("nodes").alias("n_nodes"), F.size("blocks").alias("n_blocks"))


def _diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagrams of two nodes, or of none where the id is a multiple of 5."""
    item = lambda k: F.struct(F.lit(f"n{k}").alias("id"), F.lit(f"label {k}").alias("text"), F.struct(*[F.lit(float(k)).alias(s) for s in G.SIDES]).alias("bbox"), F.lit(None).cast("string").alias("mask"), F.lit(None).cast("double").alias("conf"), F.lit("sam").alias("src")).cast(layout.ITEM)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    nodes = F.when(F.col("doc_id") % 5 == 0, none(layout.ITEM)).otherwise(F.array(item(0), item(1)))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("image_id"), none(layout.BLOCK).alias("blocks"), nodes.alias("nodes"), none(layout.ITEM).alias("rasters"), none(layout.ARROW).alias("arrows"))


@query("""SELECT 'd' || doc_id AS image_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS n_arrows, CASE WHEN doc_id % 5 <> 0 THEN 'n1' END AS src_id, CASE WHEN doc_id % 5 <> 0 THEN 'n0' END AS dst_id FROM documents""")
def stage_edges(spark, sf_dir):
    answer = '[{"from": 1, "to": 0}, {"from": 1, "to": 7}, {"from": 1, "to": 1}]'
    a = F.get("arrows", F.lit(0))
    return stages.edges(_samples(spark, sf_dir), _diagrams(spark, sf_dir), _rule("0: label 0\n1: label 1", answer)).select("image_id", F.size("arrows").alias("n_arrows"), a["src_id"].alias("src_id"), a["dst_id"].alias("dst_id"))


@query("""SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN '<svg>x</svg>' END AS code, true AS has_raw FROM documents""")
def stage_codegen(spark, sf_dir):
    # the answer of an empty diagram holds no code, and is kept all the same
    name = "code or none"
    predictors.REGISTRY[name] = lambda: predictors.Scripted({'t="label 1" b="1.00 1.00 1.00 1.00" src="sam"/>': "Here: ```svg\n<svg>x</svg>``` done", "<diagram/>": "nothing, done"})
    made = stages.codegen(_samples(spark, sf_dir), _diagrams(spark, sf_dir), name, "svg")
    return made.select("id", "code", F.col("raw").contains("done").alias("has_raw"))


@query("""
    SELECT 'd' || doc_id AS sample_id, 'tikz' AS backend, doc_id % 3 <> 0 AS render_ok, CASE WHEN doc_id % 3 <> 0 THEN left(sha256('code ' || (doc_id % 3)), 16) || '.png' END AS render_png_path,
           CASE WHEN doc_id % 3 <> 0 THEN 4 ELSE 0 END AS judge_score, CASE WHEN doc_id % 3 <> 0 THEN 'fine' ELSE '' END AS judge_rationale, doc_id % 3 <> 0 AS kept FROM documents""")
def stage_render_judge(spark, sf_dir):
    # three distinct codes, one of which can't be rendered; the cache holds the other two, and a second run draws only the failure again
    def draw(code: str):
        return (False, None, "broken") if code.endswith("0") else (True, code.encode(), "")

    predictors.RENDERERS["drawn"] = draw
    samples, cache = _samples(spark, sf_dir), folder(spark, "renders")
    codes = samples.select("id", F.concat(F.lit("code "), (F.substring("id", 2, 20).cast("long") % 3).cast("string")).alias("code"))
    stages.render(spark, codes, "drawn", cache).count()
    rendered = stages.render(spark, codes, "drawn", cache)
    judged = stages.judge(samples, rendered, _rule(".png", 'ok {"score": 4, "rationale": "fine"}'), "tikz")
    return judged.withColumn("judge_score", F.coalesce("judge_score", F.lit(0)))


@query("""SELECT left(sha256(l), 16) AS digest, n > 0 AS drawn FROM (SELECT DISTINCT coalesce(lang, 'none') AS l, 1 AS n FROM documents)""")
def render_cache(spark, sf_dir):
    predictors.RENDERERS["echo"] = lambda code: (True, code.encode(), "")
    codes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("code"))
    cache = folder(spark, "renders")
    stages.render(spark, codes, "echo", cache).count()
    stages.render(spark, codes, "echo", cache).count()
    return spark.read.parquet(cache).select("digest", F.col("png").isNotNull().alias("drawn"))
