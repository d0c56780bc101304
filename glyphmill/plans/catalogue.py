"""Queries over the test tables, each with the SQL that checks it.

The test data hold no diagrams, so every operator runs on a documented mapping
of its inputs onto the tables: order lines are the boxes of an image, events
are actions of a review, conversations are the steps of a drawing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.functions import masks
from glyphmill.functions import text as T
from glyphmill.functions import vectors as V
from glyphmill.operators import aggregates, animation, drawing, joins, layout, ordered, review, sampling
from glyphmill.sources import files
from glyphmill.sources.scratch import folder
from glyphmill.streaming import review as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def looked_up(values: dict[str, str], key: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


# Evaluation -----------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return aggregates.gate_scores(table(spark, sf_dir, "events").withColumn("score", F.col("value")), ok, ["score"]).withColumn("ok", ok)


def _evaluation(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    out = aggregates.evaluation(_records(spark, sf_dir), F.col("ok"), ["score"], [key])
    return out.withColumns({"compile_rate": r6("compile_rate"), "score_mean": r6("score_mean")})


def _evaluation_sql(key: str) -> str:
    return f"""
    SELECT {key}, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_compiled,
           round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS compile_rate,
           round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS score_mean,
           count(CASE WHEN event_type <> 'error' THEN value END) AS n_score
    FROM events GROUP BY {key}"""


@query(_evaluation_sql("user_id"))
def eval_summary(spark, sf_dir):
    return _evaluation(spark, sf_dir, "user_id")


@query(_evaluation_sql("event_type"))
def eval_summary_by_type(spark, sf_dir):
    return _evaluation(spark, sf_dir, "event_type")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS score, CASE WHEN event_type = 'error' THEN 'skipped: compile failed' END AS rationale FROM events""")
def score_gate(spark, sf_dir):
    return _records(spark, sf_dir).select("event_id", "score", "rationale")


@query("""SELECT doc_id, quality, quality IS NOT NULL AND quality >= 1 AS kept FROM labels""")
def keep_gate(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "quality", aggregates.keep_gate(F.col("quality"), 1).alias("kept"))


@query("""
    WITH v AS (SELECT event_type, value / max(value) OVER () AS iou FROM events)
    SELECT event_type, count(iou) AS n, round(avg(iou), 6) AS mean, round(median(iou), 6) AS median,
           round(avg((iou >= 0.5)::INT), 6) AS share_50, round(avg((iou >= 0.7)::INT), 6) AS share_70, round(avg((iou >= 0.9)::INT), 6) AS share_90
    FROM v GROUP BY event_type""")
def validation_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    top = F.broadcast(events.agg(F.max("value").alias("top")))  # one row
    out = aggregates.validation(events.join(top).withColumn("iou", F.col("value") / F.col("top")), "iou", by=["event_type"])
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("event_type", "n")})


# Annotation progress and tables ---------------------------------------------


@query("""
    SELECT o_orderpriority AS annotator, count(*) AS done, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) AS total_done,
           (SELECT round(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*)) FROM orders)::INT AS percent
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def annotation_progress(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("annotator", F.col("o_orderpriority"))
    out = aggregates.progress(orders, "annotator", F.col("o_orderstatus") == "F")
    return out.select("annotator", "done", "total", "total_done", aggregates.percent(F.col("total_done"), F.col("total")).alias("percent"))


@query("""
    SELECT c_custkey, c_name, coalesce(o.status, 'pending') AS status FROM customer LEFT JOIN
    (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def sample_status_join(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return joins.with_status(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), latest, "c_custkey")


@query("""
    SELECT d.doc_id, b.text IS NOT NULL AS overridden, substr(sha256(coalesce(b.text, d.text)), 1, 16) AS digest
    FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id""")
def text_override(spark, sf_dir):
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    out = joins.overridden(table(spark, sf_dir, "documents").select("doc_id", "text"), new, "doc_id", "text")
    return out.select("doc_id", "overridden", T.digest(F.col("text")).alias("digest"))


@query("""SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1' AND contains(lower(text), 'the')""")
def sample_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where((F.col("lang") == "en") & (F.col("source") == "src1") & F.contains(F.lower("text"), F.lit("the"))).select("doc_id", "lang", "source")


@query("""
    SELECT user_id, arg_max('draft ' || event_id, (ts, event_id)) FILTER (event_type = 'view') AS tex,
           arg_max(event_type, (ts, event_id)) AS annotated_by,
           coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'done' ELSE 'pending' END, (ts, event_id)) FILTER (event_type IN ('purchase', 'signup')), 'pending') AS status,
           count(*) AS n_writes
    FROM events WHERE event_type IN ('view', 'purchase', 'signup') GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase", "signup"))
    tex = F.when(F.col("event_type") == "view", F.concat(F.lit("draft "), F.col("event_id").cast("string")))
    writes = events.select("user_id", "ts", "event_id", tex.alias("tex"), F.col("event_type").alias("annotated_by"), looked_up({"purchase": "done", "signup": "pending"}, "event_type").alias("status"))
    return ordered.upsert(writes, "user_id", ["ts", "event_id"], "tex", "annotated_by", "status")


@query("""SELECT o_orderkey AS id, o_orderpriority AS annotated_by, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY id""")
def export_manifest(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return done.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("annotated_by"), F.col("o_orderstatus").alias("status")).orderBy("id")


@query("""SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def skip_existing(spark, sf_dir):
    return joins.skip_existing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def only_listed(spark, sf_dir):
    return joins.only_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT lang, min(source) AS source, arg_min(doc_id, (source, doc_id)) AS doc_id FROM documents GROUP BY lang""")
def variant_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("variant", F.struct("source", "doc_id"))
    return joins.pick_variant(docs, "lang", "variant", "doc_id").select("lang", "variant.source", "doc_id")


@query("""SELECT 'doc' AS kind, array_to_string(list_sort(list(DISTINCT lang)), ' ') AS langs, array_to_string(list_sort(list(DISTINCT source)), ' ') AS sources FROM documents""")
def distinct_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.lit("doc").alias("kind"), F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("langs"), F.array_join(F.array_sort(F.collect_set("source")), " ").alias("sources"))


# Review events --------------------------------------------------------------

ACTIONS = {"view": "open_points", "click": "confirm_points", "purchase": "accept", "error": "reject", "signup": "reopen"}


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.replay(table(spark, sf_dir, "events").withColumn("action", looked_up(ACTIONS, "event_type")), "user_id", ["ts", "event_id"])


_FSM = (
    "WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ACTIONS.items())
    + " END AS action FROM events), t(s, a, d) AS (VALUES "
    + ", ".join(f"('{s}', '{a}', '{d}')" for (s, a), d in review.TRANSITIONS.items())
    + """), run AS (
      SELECT user_id, 0::BIGINT AS k, 'proposed' AS state, 0 AS n_legal, 0 AS n_illegal, 0 AS n_reopened FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT r.user_id, r.k + 1, coalesce(t.d, r.state), r.n_legal + (t.d IS NOT NULL)::INT, r.n_illegal + (t.d IS NULL)::INT, r.n_reopened + (t.d IS NOT NULL AND e.action = 'reopen')::INT
      FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 LEFT JOIN t ON t.s = r.state AND t.a = e.action
    ), final AS (SELECT user_id, arg_max(state, k) AS state, max(n_legal) AS n_legal, max(n_illegal) AS n_illegal, max(n_reopened) AS n_reopened FROM run GROUP BY user_id) """
)


@query(_FSM + "SELECT user_id, state, n_legal, n_reopened FROM final")
def fsm_replay(spark, sf_dir):
    return _replayed(spark, sf_dir).select("user_id", "state", "n_legal", "n_reopened")


@query(_FSM + "SELECT user_id, n_illegal FROM final WHERE n_illegal > 0")
def fsm_illegal(spark, sf_dir):
    return _replayed(spark, sf_dir).where(F.col("n_illegal") > 0).select("user_id", "n_illegal")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.state_counts(_replayed(spark, sf_dir).withColumn("image_id", F.col("user_id") % 10), "image_id", list(review.STATES))


_COUNTS = ", counts AS (SELECT user_id % 10 AS image_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in review.STATES) + ", count(*) AS n FROM final GROUP BY 1) "


@query(_FSM + _COUNTS + "SELECT * FROM counts")
def state_counts(spark, sf_dir):
    return _states(spark, sf_dir)


@query(_FSM + _COUNTS + "SELECT count(*) AS images, " + ", ".join(f"coalesce(sum(n_{s}), 0)::BIGINT AS total_{s}" for s in review.TERMINAL) + " FROM counts WHERE " + " + ".join(f"n_{s}" for s in review.TERMINAL) + " > 0")
def review_totals(spark, sf_dir):
    return aggregates.review_totals(_states(spark, sf_dir), list(review.TERMINAL))


@query("""
    SELECT user_id, bool_or(event_id % 10 < 5 AND value > 30 OR (event_type = 'view' AND event_id % 10 = 6 AND value > 20)) AS touched FROM events GROUP BY user_id""")
def human_touch_guard(spark, sf_dir):
    # the five actions that count, and those that don't: accepting a mask, and opening
    named = F.element_at(F.array(*map(F.lit, ("point_add", "point_move", "point_delete", "point_label_toggle", "mask_reject_manual_box", "mask_accept", "state_change", "mask_accept", "point_toggle", "open_points"))), (F.col("event_id") % 10 + 1).cast("int"))
    action = F.when((F.col("event_id") % 10 < 5) & (F.col("value") <= 30), "mask_accept").otherwise(named)
    entry = F.struct(action.alias("action"), F.when((F.col("event_type") == "view") & (F.col("value") > 20), "confirm_points").otherwise("open_points").alias("detail"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(entry).alias("log")).select("user_id", review.human_touched(F.col("log")).alias("touched"))


@query("""
    WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
    SELECT user_id, round(coalesce(sum(gap) FILTER (gap > 0 AND gap < 120), 0), 6) AS active_seconds, count(*) AS n_events FROM g GROUP BY user_id""")
def active_time(spark, sf_dir):
    return ordered.active_time(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").withColumn("active_seconds", r6("active_seconds"))


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'view') AS points_added, count(*) FILTER (event_type = 'click') AS points_moved,
           count(*) FILTER (event_type = 'error') AS points_deleted, count(*) FILTER (event_type = 'purchase') AS masks_manually_fixed FROM events GROUP BY user_id""")
def session_counters(spark, sf_dir):
    of = {"points_added": "view", "points_moved": "click", "points_deleted": "error", "masks_manually_fixed": "purchase"}
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == e).alias(n) for n, e in of.items()])


@query("""
    WITH c AS (SELECT event_id, user_id, event_type, floor(value)::INT % 4 AS hit, nullif(event_id % 3, 0) AS sel FROM events)
    SELECT event_id, CASE WHEN hit > 0 AND hit = sel THEN 'deselect' WHEN hit > 0 THEN 'select' WHEN sel IS NOT NULL AND user_id % 2 = 0 THEN 'move' WHEN event_type = 'view' THEN 'add' ELSE 'none' END AS action FROM c""")
def click_resolution(spark, sf_dir):
    hit = F.floor("value").cast("int") % 4
    events = table(spark, sf_dir, "events").withColumns({"hit": F.when(hit > 0, hit), "sel": F.nullif(F.col("event_id") % 3, F.lit(0))})
    return events.select("event_id", review.resolve_click(F.col("hit"), F.col("sel"), F.col("user_id") % 2 == 0, F.col("event_type") == "view").alias("action"))


@query("""
    WITH RECURSIVE e AS (
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value,
             CASE event_type WHEN 'view' THEN 'propose' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'add' ELSE 'add_negative' END WHEN 'click' THEN 'move' WHEN 'error' THEN 'delete' ELSE 'toggle' END AS a FROM events
    ), run AS (
      SELECT user_id, 0::BIGINT AS k, NULL::DOUBLE AS x, 1 AS label, NULL::VARCHAR AS source, NULL::DOUBLE AS original_x, false AS present FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT r.user_id, r.k + 1, CASE WHEN a IN ('propose', 'add', 'add_negative', 'move') THEN value ELSE x END,
             CASE WHEN a = 'toggle' THEN 1 - label WHEN a IN ('propose', 'add') THEN 1 WHEN a = 'add_negative' THEN 0 ELSE label END,
             CASE WHEN a = 'propose' THEN 'molmo' WHEN a LIKE 'add%' THEN 'human_added' WHEN a = 'move' AND source = 'molmo' THEN 'human_moved' ELSE source END,
             CASE WHEN a = 'move' AND source = 'molmo' THEN x ELSE original_x END,
             CASE WHEN a = 'delete' THEN false WHEN a IN ('propose', 'add', 'add_negative') THEN true ELSE present END
      FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1
    ) SELECT user_id, arg_max(label, k) AS label, arg_max(coalesce(source, ''), k) AS source, arg_max(present, k) AS present, arg_max(coalesce(x, -1), k) AS x, arg_max(coalesce(original_x, -1), k) AS original_x FROM run GROUP BY user_id""")
def point_edits(spark, sf_dir):
    action = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 1), "add_negative").otherwise(looked_up({"view": "propose", "signup": "add", "click": "move", "error": "delete", "purchase": "toggle"}, "event_type"))
    edits = table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action"), F.col("value").alias("x"), F.col("value").alias("y"))
    got = review.edited_points(edits, "user_id", "event_id")
    return got.select("user_id", "label", F.coalesce("source", F.lit("")).alias("source"), "present", F.coalesce("x", F.lit(-1.0)).alias("x"), F.coalesce("original_x", F.lit(-1.0)).alias("original_x"))


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
    SELECT event_id, user_id, event_type AS x FROM e WHERE k = 1 OR event_type <> p""")
def click_dedup(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("x"), F.lit(0).alias("y"))
    return ordered.deduplicated_clicks(clicks, "user_id", "event_id").select("event_id", "user_id", "x")


# Layout geometry ------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes of an image: (image_id, ord, box, flag, src, dst)."""
    b = G.box_xywh(F.col("l_quantity"), F.col("l_partkey") % 50, F.col("l_linenumber") * 8, F.col("l_suppkey") % 40)
    return _numbered_lines(table(spark, sf_dir, "lineitem")).select("image_id", "ord", b.alias("box"), F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % 20).alias("src"), (F.col("l_suppkey") % 20).alias("dst"))


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines with their image and number in it; named first, so that later windows and joins on the image reuse this shuffle."""
    ord_ = F.row_number().over(Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return lines.select(F.col("l_orderkey").alias("image_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").withColumn("ord", ord_)


_BOXES = """
b AS (
  SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS ord,
         l_quantity AS x0, (l_partkey % 50)::DOUBLE AS y0, l_quantity + l_linenumber * 8 AS x1, (l_partkey % 50 + l_suppkey % 40)::DOUBLE AS y1,
         l_returnflag AS flag, l_partkey % 20 AS src, l_suppkey % 20 AS dst
  FROM lineitem
), r AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY image_id ORDER BY (x1 - x0) * (y1 - y0) DESC, ord) AS rank FROM b) """
_ROLES = _BOXES + """, claims AS (
  SELECT i.image_id, i.ord, arg_min(o.ord, o.rank) AS owner FROM r i JOIN r o ON i.image_id = o.image_id AND i.ord <> o.ord
   AND o.x0 - 1 <= i.x0 AND o.y0 - 1 <= i.y0 AND o.x1 + 1 >= i.x1 AND o.y1 + 1 >= i.y1 GROUP BY 1, 2
), roles AS (
  SELECT b.image_id, b.ord, c.owner, CASE WHEN c.owner IS NULL THEN CASE WHEN k.ord IS NOT NULL THEN 'block' ELSE 'node' END WHEN oc.ord IS NOT NULL THEN 'dropped' ELSE 'child' END AS role
  FROM b LEFT JOIN claims c ON c.image_id = b.image_id AND c.ord = b.ord
  LEFT JOIN (SELECT DISTINCT image_id, owner AS ord FROM claims) k ON k.image_id = b.image_id AND k.ord = b.ord
  LEFT JOIN claims oc ON oc.image_id = b.image_id AND oc.ord = c.owner
) """


@query("WITH " + _ROLES + "SELECT image_id, ord, owner FROM claims")
def containment_claim(spark, sf_dir):
    return joins.claims(_items(spark, sf_dir))


@query("WITH " + _ROLES + "SELECT image_id, ord, coalesce(owner, -1) AS owner, role FROM roles")
def layout_classify(spark, sf_dir):
    return joins.classify(_items(spark, sf_dir)).withColumn("owner", F.coalesce("owner", F.lit(-1)))


@query("WITH " + _ROLES + "SELECT image_id, ord, owner FROM roles WHERE role = 'dropped'")
def dropped_items(spark, sf_dir):
    return joins.classify(_items(spark, sf_dir)).where(F.col("role") == "dropped").select("image_id", "ord", "owner")


@query("WITH " + _BOXES + """
    SELECT p.image_id, p.ord, coalesce(min(o.ord), -1) AS block_ord FROM b p LEFT JOIN b o ON o.flag <> 'R' AND p.image_id = o.image_id
     AND o.x0 - 1 <= p.x0 AND o.y0 - 1 <= p.y0 AND o.x1 + 1 >= p.x1 AND o.y1 + 1 >= p.y1 WHERE p.flag = 'R' GROUP BY 1, 2""")
def raster_owner(spark, sf_dir):
    items = _items(spark, sf_dir)
    return joins.raster_owners(items.where(F.col("flag") == "R"), items.where(F.col("flag") != "R")).withColumn("block_ord", F.coalesce("block_ord", F.lit(-1)))


@query("WITH " + _BOXES + """
    SELECT p.image_id, p.ord AS point_ord, arg_min(o.ord, (o.area, o.ord)) AS box_ord FROM r p JOIN r o ON p.image_id = o.image_id AND o.flag <> 'R'
     AND o.x0 <= p.x0 AND p.x0 < o.x1 AND o.y0 <= p.y0 AND p.y0 < o.y1 WHERE p.flag = 'R' GROUP BY 1, 2""")
def smallest_container(spark, sf_dir):
    items = _items(spark, sf_dir)
    points = items.where(F.col("flag") == "R").select("image_id", F.col("ord").alias("point_ord"), F.col("box.x0").alias("x"), F.col("box.y0").alias("y"))
    return joins.smallest_container(points, items.where(F.col("flag") != "R"))


@query("WITH " + _BOXES + """, d AS (
      SELECT p.image_id, p.ord AS click_ord, o.ord AS point_ord, sqrt((p.x0 - o.x0) ** 2 + (p.y0 - o.y0) ** 2) AS d FROM b p JOIN b o ON p.image_id = o.image_id AND o.flag <> 'R' WHERE p.flag = 'R')
    SELECT image_id, click_ord, arg_min(point_ord, (d, point_ord)) AS point_ord, round(min(d), 6) AS distance FROM d WHERE d <= 10 GROUP BY 1, 2""")
def nearest_point(spark, sf_dir):
    items = _items(spark, sf_dir)
    clicks = items.where(F.col("flag") == "R").select("image_id", F.col("ord").alias("click_ord"), F.col("box.x0").alias("x"), F.col("box.y0").alias("y"))
    points = items.where(F.col("flag") != "R").select("image_id", F.col("ord").alias("point_ord"), F.col("box.x0").alias("px"), F.col("box.y0").alias("py"))
    return joins.nearest_point(clicks, points).withColumn("distance", r6("distance"))


_SHARED = "greatest(least({0}x1, {1}x1) - greatest({0}x0, {1}x0), 0) * greatest(least({0}y1, {1}y1) - greatest({0}y0, {1}y0), 0)"


@query("WITH " + _BOXES + f""", p AS (
      SELECT l.image_id, l.ord AS a, q.ord AS b, {_SHARED.format("l.", "q.")} AS s, l.area AS la, q.area AS qa FROM r l JOIN r q ON l.image_id = q.image_id AND l.ord < q.ord)
    SELECT image_id, a, b, round(s / (la + qa - s), 6) AS iou FROM p WHERE s > 0 AND s / (la + qa - s) > 0.5""")
def box_iou_pairs(spark, sf_dir):
    return joins.iou_pairs(_items(spark, sf_dir), 0.5).withColumn("iou", r6("iou"))


@query("WITH RECURSIVE " + _BOXES.replace("FROM lineitem", "FROM lineitem WHERE l_returnflag = 'R'") + f""", walk AS (
      SELECT image_id, 1::BIGINT AS k, [{{'ord': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area}}] AS kept FROM r WHERE rank = 1
      UNION ALL
      SELECT w.image_id, w.k + 1, CASE WHEN len(list_filter(w.kept, lambda o: ({_SHARED.format("o.", "r.")}) > 0 AND ({_SHARED.format("o.", "r.")}) / (o.area + r.area - ({_SHARED.format("o.", "r.")})) > 0.3)) > 0
             THEN w.kept ELSE list_append(w.kept, {{'ord': r.ord, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'area': r.area}}) END
      FROM walk w JOIN r ON r.image_id = w.image_id AND r.rank = w.k + 1
    ), done AS (SELECT image_id, arg_max(kept, k) AS kept FROM walk GROUP BY 1)
    SELECT image_id, u.ord AS ord FROM (SELECT image_id, unnest(kept) AS u FROM done)""")
def box_nms(spark, sf_dir):
    lines = _numbered_lines(table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R"))
    b = G.box_xywh(F.col("l_quantity"), F.col("l_partkey") % 50, F.col("l_linenumber") * 8, F.col("l_suppkey") % 40)
    return joins.suppress(lines.select("image_id", "ord", b.alias("box")), 0.3)


@query("""
    WITH q AS (SELECT l_orderkey AS image_id, l_linenumber AS line, count(*) OVER (PARTITION BY l_orderkey, floor(l_quantity / 25), l_partkey % 2) AS n_same FROM lineitem)
    SELECT image_id, line, n_same FROM q WHERE n_same > 1""")
def duplicate_boxes(spark, sf_dir):
    b = G.box(F.floor(F.col("l_quantity") / 25), F.col("l_partkey") % 2, F.lit(1), F.lit(1))
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"), b.alias("box"))
    return joins.duplicate_boxes(q).select("image_id", "line", "n_same")


@query("WITH " + _BOXES + """, m AS (SELECT DISTINCT image_id, src AS mark FROM b)
    SELECT b.image_id, b.ord, 'n' || b.src AS src_id, 'n' || b.dst AS dst_id FROM b JOIN m s ON s.image_id = b.image_id AND s.mark = b.src JOIN m d ON d.image_id = b.image_id AND d.mark = b.dst WHERE b.src <> b.dst""")
def edge_list_clean(spark, sf_dir):
    items = _items(spark, sf_dir).drop("box", "flag")
    marks = items.select("image_id", F.col("src").alias("mark_id")).distinct().withColumn("node_id", F.concat(F.lit("n"), F.col("mark_id").cast("string")))
    return joins.resolve_edges(items, marks).select("image_id", "ord", "src_id", "dst_id")


@query("""SELECT doc_id AS image_id, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 2 ELSE -1 END AS kind FROM documents""")
def find_id(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("id"))
    kinds = [ids.where(F.col("id") % k == 0) for k in (2, 3, 5)]
    return joins.find_id(ids, *kinds).select("image_id", F.coalesce("kind", F.lit(-1)).alias("kind"))


@query("""
    SELECT l_orderkey AS image_id, l_linenumber AS line, l_quantity * 20 BETWEEN 0 AND 900 AS inside, round(l_quantity * 20 / 1000 * 640, 6) AS px,
           round((l_partkey % 1000) / 1000 * 480, 6) AS py, round(greatest(0, least(639, l_extendedprice / 100)), 6) AS clamped FROM lineitem""")
def coord_denorm(spark, sf_dir):
    x = F.col("l_quantity") * 20
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("line"),
        x.between(0, 900).alias("inside"),
        r6(G.denormalise(x, F.lit(640))).alias("px"),
        r6(G.denormalise(F.col("l_partkey") % 1000, F.lit(480))).alias("py"),
        r6(G.clamp(F.col("l_extendedprice") / 100, F.lit(0), F.lit(639))).alias("clamped"),
    )


@query("""
    SELECT l_orderkey AS image_id, greatest(min(l_quantity) - 5, 0)::DOUBLE AS x0, greatest(min(l_partkey % 50) - 5, 0)::DOUBLE AS y0,
           least(max(l_quantity) + 5, 50)::DOUBLE AS x1, least(max(l_partkey % 50) + 5, 50)::DOUBLE AS y1 FROM lineitem GROUP BY 1""")
def point_crop(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list("l_quantity").alias("xs"), F.collect_list((F.col("l_partkey") % 50).cast("double")).alias("ys"))
    return points.select("image_id", G.crop(F.col("xs"), F.col("ys"), 5.0, F.lit(50.0), F.lit(50.0)).alias("b")).select("image_id", "b.*")


@query("WITH " + _ROLES + "SELECT image_id, count(*) FILTER (role = 'block') AS n_blocks, count(*) FILTER (role = 'node') AS n_nodes, count(*) FILTER (role = 'child') AS n_children FROM roles GROUP BY 1")
def diagram_sizes(spark, sf_dir):
    none = F.lit(None)
    items = _items(spark, sf_dir).select("image_id", "ord", F.concat(F.lit("node_"), F.col("ord").cast("string")).alias("id"), F.lit("").alias("text"), "box", none.cast("string").alias("mask"), none.cast("double").alias("conf"), F.lit(False).alias("is_raster"))
    nodes, blocks = F.col("nodes"), F.col("blocks")
    inside = F.size(layout.everything(nodes, blocks, "nodes")) - F.size(nodes)
    return layout.assemble(items).select("image_id", F.size(blocks).cast("long").alias("n_blocks"), F.size(nodes).cast("long").alias("n_nodes"), inside.cast("long").alias("n_children"))


@query("""
    WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS mark FROM conversations)
    SELECT conv_id AS image_id, string_agg(mark || ': ' || role, chr(10) ORDER BY mark) AS legend, count(*) AS n FROM c GROUP BY 1""")
def mark_legend(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), F.lit(0).alias("place"), F.col("turn").alias("ord"), "role")
    names = F.transform(F.array_sort(F.collect_list(F.struct("mark_id", "role"))), lambda x: x["role"])
    return ordered.marks(turns).groupBy("image_id").agg(T.legend(names).alias("legend"), F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id AS image_id, turn, round((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / count(*) OVER (PARTITION BY conv_id), 6) AS hue FROM conversations""")
def instance_hue(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    i = F.row_number().over(w.orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), "turn", r6(G.hue(i, F.count(F.lit(1)).over(w))).alias("hue"))


# Structured text ------------------------------------------------------------


@query("""SELECT event_id, (props::JSON->>'k')::INT AS src, ((props::JSON->>'k')::INT * 7) % 10 AS dst FROM events UNION ALL SELECT event_id, 4, 1 FROM events WHERE event_id % 3 = 0""")
def json_edges(spark, sf_dir):
    # every answer holds one or two good items, and bad ones that must not cost them
    k = F.regexp_extract("props", r"(\d+)", 1)
    more = F.when(F.col("event_id") % 3 == 0, ', {"from": 4.7, "to": true}').otherwise(', {"from": "4.7", "to": 1}')
    answer = F.concat(F.lit('Edges: [{"from": "'), k, F.lit('", "to": '), ((k.cast("int") * 7) % 10).cast("string"), F.lit('.0}, {"from": "x", "to": 1}, {"to": 2}, {"from": null, "to": 2}'), more, F.when(F.col("event_id") % 5 == 0, ", 7, [1]] end").otherwise("] end"))
    # an outer explode reads the answer once; a plain one would read it again to leave empty lists out first
    return table(spark, sf_dir, "events").select("event_id", F.explode_outer(T.edges(answer)).alias("e")).where(F.col("e").isNotNull()).select("event_id", "e.src", "e.dst")


@query("""SELECT event_id, user_id % 7 AS object_id, 1.5::DOUBLE AS x0, 1.0::DOUBLE AS y0, (event_id % 50 + 2)::DOUBLE AS x1, 3.5::DOUBLE AS y1 FROM events WHERE user_id % 7 <= 4""")
def json_boxes(spark, sf_dir):
    good = F.format_string('{"object_id": %d, "box": [1.5, "1", %d, 3.5]}', F.col("user_id") % 7, F.col("event_id") % 50 + 2)
    bad = ', {"object_id": 1, "box": [5, 5, 4, 9]}, {"object_id": 2, "box": [1, 2]}, {"object_id": 2, "box": [1, 2, 3, 4, 5]}, {"id": 2, "box": [1, 2, 3, 4]}, {"object_id": "2.5", "box": [1, 2, 3, 4]}]'
    answer = F.concat(F.lit("<think>no []</think>["), good, F.lit(bad))
    ids = F.array(*[F.lit(i) for i in range(5)])
    return table(spark, sf_dir, "events").select("event_id", F.explode_outer(T.boxes(answer, ids)).alias("b")).where(F.col("b").isNotNull()).select("event_id", F.col("b.object_id").cast("long").alias("object_id"), "b.x0", "b.y0", "b.x1", "b.y1")


@query("""
    SELECT event_id, CASE WHEN user_id % 8 BETWEEN 1 AND 5 AND event_id % 4 <> 3 THEN (user_id % 8)::INT ELSE 0 END AS score,
           CASE WHEN event_id % 4 = 3 THEN 'could not parse judge output: Answer {"score": "' || (user_id % 8) || '.5", "rationale": "' || event_type || '"}'
                WHEN user_id % 8 BETWEEN 1 AND 5 THEN event_type ELSE 'score out of range: ' || (user_id % 8) END AS reason FROM events""")
def judge_parse(spark, sf_dir):
    # whole numbers, numbers with a fraction, quoted whole numbers, and quoted others, which count for nothing
    form = F.element_at(F.array(*map(F.lit, ("%d", "%d.7", '"%d"', '"%d.5"'))), (F.col("event_id") % 4 + 1).cast("int"))
    score = F.replace(form, F.lit("%d"), (F.col("user_id") % 8).cast("string"))
    answer = F.concat(F.lit('Answer {"score": '), score, F.lit(', "rationale": "'), F.col("event_type"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", T.judge(answer).alias("j")).select("event_id", F.coalesce("j.score", F.lit(0)).alias("score"), "j.reason")


@query("""SELECT event_id, (user_id % 9)::INT AS object_id, round((100 + event_id % 900) / 1000 * 640, 6) AS x, 120.0::DOUBLE AS y FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 3, 64.0, 480.0 FROM events WHERE event_id % 2 = 0""")
def point_tags(spark, sf_dir):
    # two tags, a point of too few digits and one outside; coords outside a tag, or before other attributes, are none
    tag = F.format_string('coords="1 200 200" <points n="2" coords="%d %d 250; 2 12 300"/> <tracks coords="3 100 1000, 4 1001 100">', F.col("user_id") % 9, F.col("event_id") % 900 + 100)
    other = F.format_string('<points coords="%d %d 250" alt="a">', F.col("user_id") % 9, F.col("event_id") % 900 + 100)
    answer = F.when(F.col("event_id") % 2 == 0, tag).otherwise(other)
    return table(spark, sf_dir, "events").select("event_id", F.explode_outer(T.point_tags(answer, F.lit(640.0), F.lit(480.0))).alias("p")).where(F.col("p").isNotNull()).select("event_id", "p.object_id", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query(r"""
    SELECT page_id, '\documentclass{a} ' || length(html) || '\end{document}' AS tikz, '<svg>' || url || '</svg>' AS svg,
           'no \documentclass found in model output' || CASE WHEN page_id % 2 = 0 THEN ' -- likely truncated by max_new_tokens before reaching the answer' ELSE '' END AS reason FROM pages""")
def code_extract(spark, sf_dir):
    n = F.length("html").cast("string")
    tikz = F.concat(F.lit("<think>plan</think> Here:\n```latex\n\\documentclass{a} "), n, F.lit("\\end{document} trailing\n```\n```x``` bye"))
    svg = F.concat(F.lit("text <svg>"), F.col("url"), F.lit("</svg> tail"))
    bad = F.when(F.col("page_id") % 2 == 0, "<think>\\documentclass</think> sorry").otherwise("nothing")
    return table(spark, sf_dir, "pages").select("page_id", T.extract_code(tikz, "tikz").alias("tikz"), T.extract_code(svg, "svg").alias("svg"), T.failure_reason(bad).alias("reason"))


@query(r"""
    WITH n AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ICML_' || (2000 + user_id % 30) || '_arch' || event_id WHEN 1 THEN 'CVPR_' || (2000 + user_id % 30) || '_pipe' || event_id
                 WHEN 2 THEN 'ICML' || (2000 + user_id % 30) || '-arch' || event_id WHEN 3 THEN 'CVPR_2020_arch' || event_id || 'x' ELSE 'x/ICML_2020_arch1' END AS id FROM events),
    m AS (SELECT *, regexp_matches(id, '^[A-Za-z]+_\d{4}_(arch|pipe)\d+$') AS good FROM n)
    SELECT event_id, CASE WHEN good THEN split_part(id, '_', 1) END AS venue, CASE WHEN good THEN split_part(id, '_', 2) END AS year, CASE WHEN good THEN left(split_part(id, '_', 3), 4) END AS kind FROM m""")
def id_parse(spark, sf_dir):
    year, n = (F.col("user_id") % 30 + 2000).cast("string"), F.col("event_id").cast("string")
    forms = [F.concat(F.lit("ICML_"), year, F.lit("_arch"), n), F.concat(F.lit("CVPR_"), year, F.lit("_pipe"), n), F.concat(F.lit("ICML"), year, F.lit("-arch"), n), F.concat(F.lit("CVPR_2020_arch"), n, F.lit("x")), F.lit("x/ICML_2020_arch1")]
    name = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("id")).select("event_id", T.sample_name(F.col("id")).alias("n")).select("event_id", "n.*")


@query("""SELECT substr(sha256(text), 1, 16) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def content_dedup(spark, sf_dir):
    return ordered.content_dedup(table(spark, sf_dir, "documents"), T.digest(F.col("text")), "doc_id")


@query("""SELECT DISTINCT substr(sha256(text), 1, 16) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""")
def render_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = docs.where(F.col("doc_id") % 3 == 0).select(T.digest(F.col("text")).alias("digest"))
    return joins.render_misses(docs, cache, T.digest(F.col("text"))).select("digest")


# Vectors --------------------------------------------------------------------

_VECTORS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v) """
_SIMILARITY = "round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm), 6) AS similarity"


@query(_VECTORS + f""", p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_SIMILARITY} FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, similarity FROM p) WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return V.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 10)


@query(_VECTORS + f"SELECT a.vec_id, b.vec_id AS next_id, {_SIMILARITY} FROM n a JOIN n b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("e2"))
    return rows.join(other, "vec_id").select("vec_id", "next_id", r6(V.cosine(F.col("embedding"), F.col("e2"))).alias("similarity"))


# Order, shards, splits ------------------------------------------------------


@query("""SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::INT AS shard FROM documents""")
def shard_round_robin(spark, sf_dir):
    return ordered.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4)


@query("""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents""")
def batch_assign(spark, sf_dir):
    return ordered.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 16)


@query("""SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('7:' || o_custkey), 1, 7))::BIGINT < 26843545 THEN 'val' ELSE 'train' END AS split FROM orders""")
def group_split(spark, sf_dir):
    return sampling.split_groups(table(spark, sf_dir, "orders"), F.col("o_custkey"), 7, 0.1).select("o_orderkey", "split")


@query("""SELECT doc_id FROM documents ORDER BY ('0x' || substr(sha256('3:' || doc_id), 1, 7))::BIGINT, doc_id LIMIT 50""")
def sample_k(spark, sf_dir):
    return sampling.sample_k(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 3)


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25""")
def first_samples(spark, sf_dir):
    return sampling.first_n(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 25)


@query("""
    SELECT c_nationkey, c_custkey, coalesce(min(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
           min(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey END) OVER (PARTITION BY c_nationkey), -1) AS next_index FROM customer""")
def next_flagged(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return ordered.next_flagged(customers, "c_nationkey", "c_custkey", F.col("c_mktsegment") == "MACHINERY").select("c_nationkey", "c_custkey", F.coalesce("next_index", F.lit(-1)).alias("next_index"))


@query("""
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1)
    SELECT day, loss, coalesce(loss < min(loss) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), loss IS NOT NULL) AS is_best FROM d""")
def running_best(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(r6(F.avg("value")).alias("loss"))
    return ordered.running_best(daily, "day", "loss")


@query("""SELECT user_id, string_agg(event_id::VARCHAR, ' ' ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, event_id) AS shown FROM events GROUP BY 1""")
def instance_list(spark, sf_dir):
    state = looked_up({"view": "needs_point_review", "click": "needs_mask_review", "signup": "proposed", "purchase": "accepted", "error": "rejected"}, "event_type")
    shown = F.transform(F.array_sort(F.collect_list(F.struct(review.display_order(state).alias("p"), "event_id"))), lambda x: x["event_id"].cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(shown, " ").alias("shown"))


# Animation ------------------------------------------------------------------


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("double")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("diagram"), F.col("turn").alias("step"), F.concat("role", F.col("turn").cast("string")).alias("element"), (n % 100).alias("x0"), (n % 70).alias("y0"), (n % 100 + 10).alias("x1"), (n % 70 + 10).alias("y1"))


_STEPS = """s AS (
  SELECT conv_id AS diagram, turn AS step, role || turn AS element, (length(text) % 100)::DOUBLE AS x0, (length(text) % 70)::DOUBLE AS y0,
         (length(text) % 100 + 10)::DOUBLE AS x1, (length(text) % 70 + 10)::DOUBLE AS y1, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) """


@query("WITH " + _STEPS + ", f AS (SELECT *, unnest(range(0, last + 1)) AS frame FROM s) SELECT diagram, frame, element, CASE WHEN frame >= step THEN 1.0 ELSE 0.0 END::DOUBLE AS opacity FROM f")
def reveal_schedule(spark, sf_dir):
    return animation.reveal(_steps(spark, sf_dir))


@query("WITH " + _STEPS + ", f AS (SELECT *, unnest(range(0, last + 2)) AS frame FROM s) SELECT diagram, frame, element, CASE WHEN frame = step OR frame = last + 1 THEN 1.0 ELSE 0.15 END::DOUBLE AS opacity FROM f")
def alpha_schedule(spark, sf_dir):
    return animation.alpha(_steps(spark, sf_dir))


@query("WITH " + _STEPS + "SELECT diagram, step AS frame, element, x0, y0, x1, y1 FROM s")
def hop_box(spark, sf_dir):
    return animation.hop(_steps(spark, sf_dir))


@query("WITH " + _STEPS + """, l AS (
      SELECT *, lead(x0) OVER w AS a, lead(y0) OVER w AS b, lead(x1) OVER w AS c, lead(y1) OVER w AS d, row_number() OVER w - 1 AS k FROM s WINDOW w AS (PARTITION BY diagram ORDER BY step)
    ), f AS (SELECT *, unnest(range(0, CASE WHEN a IS NULL THEN 1 ELSE 4 END)) AS j FROM l)
    SELECT diagram, k * 4 + j AS frame, round(x0 + (coalesce(a, x0) - x0) * j / 4, 6) AS x0, round(y0 + (coalesce(b, y0) - y0) * j / 4, 6) AS y0,
           round(x1 + (coalesce(c, x1) - x1) * j / 4, 6) AS x1, round(y1 + (coalesce(d, y1) - y1) * j / 4, 6) AS y1 FROM f""")
def slide_box(spark, sf_dir):
    return animation.slide(_steps(spark, sf_dir)).withColumns({c: r6(c) for c in ("x0", "y0", "x1", "y1")})


# Masks, documents, streams ---------------------------------------------------


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of a vector as an 8 by 8 mask, down the columns: (vec_id, mask)."""
    e = F.col("embedding")
    bits = F.transform(e, lambda x: (x > 0).cast("int"))
    # runs of equal signs; a mask that starts with a set pixel has an empty first run
    runs = F.aggregate(
        bits,
        F.struct(F.array(F.lit(0)).alias("counts"), F.lit(0).alias("last")),
        lambda s, b: F.struct(
            F.when(b == s["last"], F.concat(F.slice(s["counts"], F.lit(1), F.size(s["counts"]) - 1), F.array(F.element_at(s["counts"], -1) + 1))).otherwise(F.concat(s["counts"], F.array(F.lit(1)))).alias("counts"),
            b.alias("last"),
        ),
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), runs["counts"].alias("counts")).alias("mask"))


_BITS = "WITH b AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: x > 0)) AS bit, unnest(range(0, 64)) AS i FROM embeddings) "


@query(_BITS + "SELECT vec_id, count(*) FILTER (bit) AS area, coalesce(min(i // 8) FILTER (bit), 0)::DOUBLE AS x0, coalesce(min(i % 8) FILTER (bit), 0)::DOUBLE AS y0, coalesce(max(i // 8) FILTER (bit), 0)::DOUBLE AS x1, coalesce(max(i % 8) FILTER (bit), 0)::DOUBLE AS y1 FROM b GROUP BY 1")
def mask_bounds(spark, sf_dir):
    return _masks(spark, sf_dir).select("vec_id", masks.area(F.col("mask")).alias("area"), masks.bbox("mask").alias("b")).select("vec_id", "area", "b.x0", "b.y0", "b.x1", "b.y1")


@query(_BITS + "SELECT a.vec_id, round(count(*) FILTER (a.bit AND o.bit) / count(*) FILTER (a.bit OR o.bit), 6) AS iou FROM b a JOIN b o ON o.vec_id = a.vec_id + 1 AND o.i = a.i GROUP BY 1")
def mask_iou(spark, sf_dir):
    m = _masks(spark, sf_dir)
    other = m.select((F.col("vec_id") - 1).alias("vec_id"), F.col("mask").alias("m2"))
    return m.join(other, "vec_id").select("vec_id", r6(masks.iou("mask", "m2")).alias("iou"))


@query(_BITS + "SELECT a.vec_id, count(*) FILTER (a.bit OR o.bit) AS n_or, count(*) FILTER (a.bit AND o.bit) AS n_and, count(*) FILTER (a.bit AND NOT o.bit) AS n_not FROM b a JOIN b o ON o.vec_id = a.vec_id + 1 AND o.i = a.i GROUP BY 1")
def mask_set_ops(spark, sf_dir):
    m = _masks(spark, sf_dir)
    both = m.join(m.select((F.col("vec_id") - 1).alias("vec_id"), F.col("mask").alias("m2")), "vec_id")
    made = both.select("vec_id", masks.union("mask", "m2").alias("o"), masks.intersection("mask", "m2").alias("a"), masks.difference("mask", "m2").alias("d"))
    return made.select("vec_id", masks.area(F.col("o")).alias("n_or"), masks.area(F.col("a")).alias("n_and"), masks.area(F.col("d")).alias("n_not"))


@query("SELECT vec_id, true AS same FROM embeddings")
def mask_rle_roundtrip(spark, sf_dir):
    m = _masks(spark, sf_dir)
    return m.select("vec_id", "mask", masks.of_text(masks.text_of("mask")).alias("back")).select("vec_id", (F.col("mask.counts") == F.col("back.counts")).alias("same"))


@query("WITH " + _ROLES + "SELECT image_id, count(*) FILTER (role = 'block') AS n_blocks, count(*) FILTER (role = 'node') AS n_nodes, count(*) FILTER (role = 'child') AS n_children FROM roles GROUP BY 1")
def xml_roundtrip(spark, sf_dir):
    none = F.lit(None)
    items = _items(spark, sf_dir).select("image_id", "ord", F.concat(F.lit("node_"), F.col("ord").cast("string")).alias("id"), F.lit("a < b").alias("text"), "box", none.cast("string").alias("mask"), none.cast("double").alias("conf"), F.lit(False).alias("is_raster"))
    back = files.parse_xml(files.write_xml(layout.assemble(items)))
    inside = F.size(layout.everything(F.col("nodes"), F.col("blocks"), "nodes")) - F.size("nodes")
    return back.select("image_id", F.size("blocks").cast("long").alias("n_blocks"), F.size("nodes").cast("long").alias("n_nodes"), inside.cast("long").alias("n_children"))


def _drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what there is, and returns what it emitted: all of it, or in complete mode what the last batch did.

    Batches are written by the tasks that hold them, below the folder that all
    executors share, as the stream's own state is.
    """
    spark, out, landed = stream.sparkSession, folder(stream.sparkSession, name), []

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{number}")
        landed.append(number)

    stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(landed))[-1:] if mode == "complete" else sorted(set(landed))
    return spark.read.schema(stream.schema).parquet(*[f"{out}/rows/{n}" for n in wanted]) if wanted else spark.createDataFrame([], stream.schema)


@query(_FSM + "SELECT user_id, state, n_legal, n_illegal FROM final")
def stream_fsm(spark, sf_dir):
    events = streams.stream_table(spark, sf_dir, "events").withColumn("action", looked_up(ACTIONS, "event_type"))
    seen = _drained(streams.replay(events, "user_id"), "update", "fsm")
    last = seen.groupBy("key").agg(F.max_by(F.struct("state", "n_legal", "n_illegal"), F.col("n_legal") + F.col("n_illegal")).alias("s"))
    return last.select(F.col("key").alias("user_id"), "s.*")


@query("""
    WITH g AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 120000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
    t AS (SELECT user_id, k, count(*) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS active_seconds, epoch_us(min(ts)) AS started FROM s GROUP BY 1, 2)
    SELECT user_id, n_events, active_seconds, started FROM t""")
def stream_session(spark, sf_dir):
    # complete mode, so that sessions that are still open are there too; it keeps all sessions, so no watermark leaves events out
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    spans = streams.stream_table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp")).groupBy(F.session_window("t", "120 seconds"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("t").alias("a"), F.max("t").alias("b"))
    out = _drained(spans, "complete", "session")
    return out.select("user_id", "n_events", r6((F.unix_micros("b") - F.unix_micros("a")) / 1e6).alias("active_seconds"), F.unix_micros("a").alias("started"))


# Drawing --------------------------------------------------------------------


@query("WITH " + _BOXES + """, h AS (SELECT *, round((row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1) / count(*) OVER (PARTITION BY image_id), 6) AS hue FROM b)
    SELECT image_id, ord, 'box' AS kind, x0, y0, x1, y1, '' AS text, hue FROM h
    UNION ALL SELECT image_id, ord, 'text', (x0 + x1) / 2, (y0 + y1) / 2, (x0 + x1) / 2, (y0 + y1) / 2, flag, hue FROM h""")
def overlay_rows(spark, sf_dir):
    return drawing.overlay(_items(spark, sf_dir), F.col("flag")).withColumn("hue", r6("hue"))


@query("WITH " + _BOXES + "SELECT image_id, ord, row_number() OVER (PARTITION BY image_id ORDER BY ord)::INT AS rank FROM b WHERE flag <> 'N'")
def label_ranks(spark, sf_dir):
    return drawing.label_ranks(_items(spark, sf_dir), F.col("flag") != "N").select("image_id", "ord", "rank")


@query("""SELECT l_orderkey AS image_id, l_linenumber AS ord, arg_min(l_quantity, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS x, arg_min(l_extendedprice, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""")
def mask_prompts(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ord"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("point_ord"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") != "N").cast("int").alias("label"))
    return drawing.prompts(points)


@query("WITH " + _BOXES + """, n AS (SELECT image_id, ord AS id, x0, y0, x1, y1 FROM b), e AS (SELECT image_id, ord AS s, ord + 1 AS d FROM b)
    SELECT e.image_id, e.s AS src_id, e.d AS dst_id, (p.x0 + p.x1) / 2 AS x0, (p.y0 + p.y1) / 2 AS y0, (q.x0 + q.x1) / 2 AS x1, (q.y0 + q.y1) / 2 AS y1
    FROM e JOIN n p ON p.image_id = e.image_id AND p.id = e.s JOIN n q ON q.image_id = e.image_id AND q.id = e.d""")
def edge_lines(spark, sf_dir):
    items = _items(spark, sf_dir)
    edges = items.select("image_id", F.col("ord").alias("src_id"), (F.col("ord") + 1).alias("dst_id"))
    return drawing.edge_lines(edges, items.select("image_id", F.col("ord").alias("id"), "box"))
