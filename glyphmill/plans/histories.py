"""Queries over logs, answers and stores that vary by row, with the SQL that checks them; importing this registers them in the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import masks
from glyphmill.functions import text as T
from glyphmill.operators import aggregates, drawing, ordered, review
from glyphmill.plans.catalogue import _BITS, _masks, looked_up, query, r6, table
from glyphmill.sources import files, store
from glyphmill.sources.scratch import folder, stored


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# Logs -------------------------------------------------------------------------

#: Steps of a review that reach every state, by type of event.
MERGES = {"view": "open_points", "click": "merge", "purchase": "reopen", "error": "reject", "signup": "confirm_points"}
ACCEPTS = {"view": "open_mask", "click": "accept", "purchase": "reopen", "error": "point_move", "signup": "confirm_points"}


def _walk(actions: dict[str, str]) -> str:
    """Recursive SQL: for each step of a user's log the state before it and where it leads, null if it is illegal."""
    named = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in actions.items())
    legal = ", ".join(f"('{s}', '{a}', '{d}')" for (s, a), d in review.TRANSITIONS.items())
    return f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type {named} END AS action FROM events), t(s, a, d) AS (VALUES {legal}),
    run AS (
      SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, ''::VARCHAR AS action, ''::VARCHAR AS was, NULL::VARCHAR AS goes, 'proposed'::VARCHAR AS state, NULL::BIGINT AS into_id FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT r.user_id, r.k + 1, e.event_id, e.action, r.state, t.d, coalesce(t.d, r.state), CASE WHEN t.d = 'merged' THEN e.event_id % 50 WHEN t.d IS NULL THEN r.into_id END
      FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 LEFT JOIN t ON t.s = r.state AND t.a = e.action) """


@query(_walk(MERGES) + "SELECT user_id, arg_max(state, k) AS state, arg_max(coalesce(into_id, -1), k) AS merged_into FROM run GROUP BY 1")
def merged_into(spark, sf_dir):
    log = events(spark, sf_dir).select("user_id", "ts", "event_id", looked_up(MERGES, "event_type").alias("action"), (F.col("event_id") % 50).alias("target"))
    done = review.replay(log, "user_id", ["ts", "event_id"], into="target")
    return done.select("user_id", "state", F.coalesce(F.col("merged_into_id").cast("long"), F.lit(-1)).alias("merged_into"))


@query(_walk(ACCEPTS) + """
    SELECT user_id, event_id, 0 AS seq, action AS event, '' AS was, '' AS goes FROM run WHERE action = 'point_move'
    UNION ALL SELECT user_id, event_id, 0, 'mask_accept', '', '' FROM run WHERE action = 'accept' AND goes IS NOT NULL
    UNION ALL SELECT user_id, event_id, CASE action WHEN 'accept' THEN 1 ELSE 0 END, 'state_change', was, goes FROM run WHERE goes IS NOT NULL""")
def audit_log(spark, sf_dir):
    log = events(spark, sf_dir).withColumn("action", looked_up(ACCEPTS, "event_type"))
    rows = review.audit(log, "user_id", ["ts", "event_id"], full=True)
    return rows.select("user_id", "event_id", "seq", "event", F.coalesce("from", F.lit("")).alias("was"), F.coalesce("to", F.lit("")).alias("goes"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 's' || event_id AS s, CASE event_type WHEN 'click' THEN 'undo' WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'edit' END AS a FROM events),
    run AS (
      SELECT user_id, 0::BIGINT AS k, NULL::VARCHAR AS state, []::VARCHAR[] AS undo, []::VARCHAR[] AS redo FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT r.user_id, r.k + 1,
             CASE WHEN a = 'edit' THEN s WHEN a = 'undo' AND len(undo) > 0 THEN undo[-1] WHEN a = 'redo' AND len(redo) > 0 THEN redo[-1] ELSE state END,
             CASE WHEN a = 'edit' THEN list_append(undo, state)[greatest(len(undo) + 1 - 19, 1):] WHEN a = 'undo' AND len(undo) > 0 THEN undo[:len(undo) - 1] WHEN a = 'redo' AND len(redo) > 0 THEN list_append(undo, state) ELSE undo END,
             CASE WHEN a = 'edit' THEN [] WHEN a = 'undo' AND len(undo) > 0 THEN list_append(redo, state) WHEN a = 'redo' AND len(redo) > 0 THEN redo[:len(redo) - 1] ELSE redo END
      FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT user_id, coalesce(arg_max(coalesce(state, ''), k), '') AS state, arg_max(len(undo), k) AS n_undo, arg_max(len(redo), k) AS n_redo FROM run GROUP BY 1""")
def undo_history(spark, sf_dir):
    # edits, undos and redos as they come: undone past the first edit, redone past the last, and cut off by new edits
    action = F.coalesce(looked_up({"click": "undo", "error": "undo", "purchase": "redo"}, "event_type"), F.lit("edit"))
    log = events(spark, sf_dir).select("user_id", "event_id", action.alias("action"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("state"))
    return review.undo_stack(log, "user_id", "event_id").select("user_id", F.coalesce("state", F.lit("")).alias("state"), F.size("undo").cast("long").alias("n_undo"), F.size("redo").cast("long").alias("n_redo"))


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.01), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.9), 6) AS q2, max(value) AS q3 FROM events GROUP BY 1""")
def exact_quantiles(spark, sf_dir):
    found = aggregates.quantiles(events(spark, sf_dir), "value", [0.01, 0.5, 0.9, 1.0], ["event_type"])
    return found.select("event_type", "n", *[r6(f"q{k}").alias(f"q{k}") for k in range(4)])


@query("""
    SELECT event_id, max(value) OVER w AS greatest_before, round(sum(value) OVER w, 4) AS sum_before, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER w AS last_high
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prefix_scans(spark, sf_dir):
    # over all events, without one task that sees them all
    rows = events(spark, sf_dir).select("event_id", "ts", "value", F.when(F.col("value") > 50, F.col("value")).alias("high"))
    ranges = min(ordered.RANGE_ROWS, max(2_000, rows.count() // 50))
    rows = ordered.scans(rows, ["ts", "event_id"], {"greatest_before": ("value", "greatest"), "sum_before": ("value", "sum"), "last_high": ("high", "last")}, range_rows=ranges)
    return rows.select("event_id", "greatest_before", F.round("sum_before", 4).alias("sum_before"), "last_high")


# Masks ------------------------------------------------------------------------


@query(_BITS + """, p AS (SELECT b.vec_id // 5 AS image_id, max(b.vec_id) FILTER (bit) AS top, i FROM b GROUP BY 1, i)
    SELECT v.vec_id, count(p.top)::BIGINT AS seen FROM (SELECT DISTINCT vec_id FROM b) v LEFT JOIN p ON p.top = v.vec_id GROUP BY 1""")
def label_raster(spark, sf_dir):
    stacked = _masks(spark, sf_dir).select((F.floor(F.col("vec_id") / 5)).cast("long").alias("image_id"), F.col("vec_id").alias("ord"), "mask")
    return drawing.label_raster(stacked).select(F.col("ord").alias("vec_id"), masks.area(F.col("seen")).alias("seen"))


@query(_BITS + """, r AS (SELECT range AS x, range * 8 // 12 AS sx FROM range(12)), c AS (SELECT range AS y, range * 8 // 5 AS sy FROM range(5))
    SELECT vec_id, count(*) AS area, sum(x) AS sum_x, sum(y) AS sum_y FROM b, r, c WHERE bit AND b.i = sx * 8 + sy GROUP BY 1""")
def mask_resize(spark, sf_dir):
    small = _masks(spark, sf_dir).select("vec_id", masks.resized("mask", F.lit(5), F.lit(12)).alias("m"))
    # pixels of the runs, as places down the columns
    ends = F.transform("m.counts", lambda c, i: F.aggregate(F.slice("m.counts", F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))
    placed = small.select("vec_id", F.posexplode(ends).alias("run", "end"), "m.counts").where(F.col("run") % 2 == 1)
    start = F.col("end") - F.get("counts", F.col("run"))
    pixels = placed.where(F.col("end") > start).select("vec_id", F.explode(F.sequence(start, F.col("end") - 1)).alias("p"))
    return pixels.groupBy("vec_id").agg(F.count(F.lit(1)).alias("area"), F.sum(F.floor(F.col("p") / 5)).cast("long").alias("sum_x"), F.sum(F.col("p") % 5).cast("long").alias("sum_y"))


@query("""SELECT vec_id, vec_id % 4 = 0 AS read FROM embeddings""")
def broken_masks(spark, sf_dir):
    # a quarter of the texts is whole; others are cut off, hold a run too many, or are no JSON
    text = masks.text_of("mask")
    odd = F.when(F.col("vec_id") % 4 == 0, text).when(F.col("vec_id") % 4 == 1, F.substring(text, 1, F.length(text) - 4)).when(F.col("vec_id") % 4 == 2, F.replace(text, F.lit('"}'), F.lit('1"}'))).otherwise(F.lit("no mask"))
    read = _masks(spark, sf_dir).select("vec_id", "mask", masks.of_text(odd).alias("back"))
    return read.select("vec_id", F.coalesce(F.col("back.counts") == F.col("mask.counts"), F.lit(False)).alias("read"))


# Answers and documents --------------------------------------------------------


@query("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN 7 WHEN 4 THEN 1 ELSE -1 END AS src, CASE event_id % 6 WHEN 0 THEN event_id % 9 WHEN 1 THEN 2 WHEN 2 THEN event_id % 9 WHEN 4 THEN user_id ELSE -1 END AS dst,
           CASE event_id % 3 WHEN 0 THEN event_id % 5 + 1 WHEN 1 THEN -1 ELSE user_id % 5 + 1 END AS score FROM events""")
def odd_answers(spark, sf_dir):
    # one bad answer beside good ones: ids beyond all marks, text and fractions for numbers, repeated keys, quotes of the wrong kind
    user, rest = F.col("user_id").cast("string"), (F.col("event_id") % 9).cast("string")
    kinds = F.array(
        F.concat(F.lit('[{"from": 99999999999, "to": 1}, {"from": '), user, F.lit(', "to": '), rest, F.lit("}]")), F.concat(F.lit('so: [5, "x", {"from": "'), user, F.lit('", "to": 2.9}]')), F.concat(F.lit('[{"from": 6, "from": 7, "to": '), rest, F.lit("}]")),
        F.concat(F.lit("[{'from': "), user, F.lit(", 'to': 1}]")), F.concat(F.lit('[{"from": true, "to": " '), user, F.lit(' "}, {"from": "1.5", "to": 2}]')), F.concat(F.lit('[{"from": '), user, F.lit(', "to": 1}')),
    )
    judged = F.element_at(F.array(F.concat(F.lit('{"score": 9, "score": '), (F.col("event_id") % 5 + 1).cast("string"), F.lit("}")), F.lit("{'score': 3}"), F.concat(F.lit('{"score": "'), (F.col("user_id") % 5 + 1).cast("string"), F.lit('"}'))), (F.col("event_id") % 3 + 1).cast("int"))
    read = events(spark, sf_dir).select("event_id", F.get(T.edges(F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int"))), F.lit(0)).alias("e"), T.judge(judged).alias("j"))
    return read.select("event_id", *[F.coalesce(f"e.{n}", F.lit(-1)).cast("long").alias(n) for n in ("src", "dst")], F.coalesce("j.score", F.lit(-1)).cast("long").alias("score"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'not XML' WHEN 2 THEN 'not a number' ELSE '' END AS problem, CASE event_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS n_nodes, CASE WHEN event_id % 4 IN (0, 3) THEN value END AS conf FROM events""")
def bad_documents(spark, sf_dir):
    value = F.col("value").cast("string")
    kinds = F.array(
        F.concat(F.lit('<diagram><node i="n" b="0 0 1 1" conf="'), value, F.lit('"/></diagram>')), F.concat(F.lit('<diagram><node i="n" conf="'), value, F.lit('"></diagram>')),
        F.concat(F.lit('<diagram><node i="n" b="0 0 1" conf="'), value, F.lit('"/></diagram>')), F.concat(F.lit('<diagram><odd/><node conf=" '), value, F.lit(' "/></diagram>')),
    )
    documents = events(spark, sf_dir).select("event_id", F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("xml"))
    read = files.parse_xml(documents, key="event_id", strict=False)
    return read.select("event_id", F.coalesce("problem", F.lit("")).alias("problem"), F.size("nodes").alias("n_nodes"), F.get("nodes", F.lit(0))["conf"].alias("conf"))


# Stores -----------------------------------------------------------------------


@query("""
    WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
    SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 2 = 0 THEN 'first' ELSE 'made' END AS by_whom, n FROM c""")
def guarded_records(spark, sf_dir):
    # records are made; one writer replaces half of them; another one, which read before that, is refused as a whole
    path = folder(spark, "records")
    made = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    text = lambda who: F.to_json(F.struct(F.lit(who).alias("by_whom"), "n")).alias("json")
    store.save(made.select(F.col("conv_id").cast("string").alias("id"), F.lit(None).cast("string").alias("version"), text("made")), path)
    started = stored(store.load(spark, path), "seen").select("id", "version", F.from_json("json", "by_whom string, n long")["n"].alias("n"))
    store.save(started.where("id % 2 = 0").select("id", "version", text("first")), path)
    try:
        store.save(started.where("id % 3 = 0").select("id", "version", text("second")), path)
        raise AssertionError("the second writer started from records that have changed")
    except Exception as refused:
        if "changed since they were read" not in str(refused):
            raise
    return store.load(spark, path).select("id", F.from_json("json", "by_whom string, n long").alias("r")).select("id", "r.by_whom", "r.n")
