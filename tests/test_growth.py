from __future__ import annotations

import json
import math
import random
import re
import time
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from glyphmill.functions import text as T
from glyphmill.operators import layout, ordered
from glyphmill.plans import catalogue
from glyphmill.sources import files, records
from tests.conftest import DATA


def test_scans_of_a_stored_table_in_many_ranges(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, i * 7 % 5000, rng.choice([None, float(rng.randrange(100))])) for i in range(5000)]
    spark.createDataFrame(rows, "i int, at int, v double").select("i", F.timestamp_seconds("at").cast("timestamp_ntz").alias("at"), "v").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    one = ordered.scan(df, ["at", "i"], "v", "greatest", "most", range_rows=100)
    assert one.count() == 5000
    # filters that Spark infers from a lambda's result go to the other side of a join, which hasn't the order
    assert "lambda" not in one._jdf.queryExecution().optimizedPlan().toString()
    running = {"most": ("v", "greatest"), "sum": ("v", "sum"), "last": ("v", "last")}
    for backwards in (False, True):
        whole, cut = (ordered.scans(df, ["at", "i"], running, range_rows=n, backwards=backwards).orderBy("i").collect() for n in (10_000, 100))
        assert whole == cut
        held, sum_, want = None, None, {}
        for i, at, v in sorted(rows, key=lambda r: r[1], reverse=backwards):
            want[i] = (held, sum_)
            held, sum_ = (v, v + (sum_ or 0)) if v is not None else (held, sum_)
        assert {r.i: (r["last"], r["sum"]) for r in cut} == want


def test_next_flagged_is_one_pass_in_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None, "none"]), i, rng.random() < 0.1) for i in range(1500)]
    rows = [(g, i, f and g != "none") for g, i, f in rows]
    df = spark.createDataFrame(rows, "g string, i int, f boolean").repartition(3)
    want = {}
    for g, i, _ in rows:
        at = [j for h, j, f in rows if h == g and f]
        want[i] = min((j for j in at if j > i), default=min(at, default=None))
    for n in (10_000, 100):
        found = ordered.next_flagged(df, "g", "i", F.col("f"), n)
        assert found.columns == ["g", "i", "f", "next_index"]
        assert {r.i: r.next_index for r in found.collect()} == want
        # a frame that follows the row is summed up anew for each row
        assert not re.search(r"unboundedfollowing", found._jdf.queryExecution().optimizedPlan().toString())


def test_what_streams_emit_is_written_by_tasks(spark, tmp_path):
    for name in ("stream_session", "stream_fsm"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan and "LocalRelation" not in plan and "MemoryPlan" not in plan
    spark.read.parquet(f"{DATA}/events.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert catalogue.QUERIES["stream_session"](spark, str(tmp_path)).count() == 0


def test_instances_are_ordered_without_a_search_for_each(spark):
    rng = random.Random(10)
    cases = [(["b", "a", "b", "gone", None], ["a", "b", "c"]), ([], ["a"]), (["a"], []), (None, ["a"]), (["a"], None), (["b", "a"], ["a", "b", "a", None]), (["x", "y"], ["a"])]
    for _ in range(40):
        ids = rng.sample("abcdefghij", rng.randrange(10))
        cases.append((rng.choices("abcdefghijkl", k=rng.randrange(12)), ids))
    rows = [(k, order, None if ids is None else [(i, n) for n, i in enumerate(ids)]) for k, (order, ids) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, o array<string>, i array<struct<id:string,n:int>>").repartition(3)
    got = {r.k: r.x and [tuple(x) for x in r.x] for r in df.select("k", records.ordered_instances(F.col("o"), F.col("i")).alias("x")).collect()}
    for k, order, given in rows:
        want = None if given is None else sorted([x for x in given if x[0] is not None and x[0] in (order or [])], key=lambda x: order.index(x[0]))
        assert got[k] == want, k
    many = spark.range(1).select(F.transform(F.sequence(F.lit(30_000), F.lit(1), F.lit(-1)), lambda i: i.cast("string")).alias("o"), F.transform(F.sequence(F.lit(2), F.lit(30_001)), lambda i: F.struct(i.cast("string").alias("id"))).alias("i"))
    began = time.perf_counter()
    first = many.select(records.ordered_instances(F.col("o"), F.col("i")).alias("x")).select(F.size("x").alias("n"), F.col("x")[0]["id"].alias("id")).first()
    assert tuple(first) == (29_999, "30000") and time.perf_counter() - began < 10


def diagrams(rng, n):
    """Diagrams as dicts, with all that a document may hold."""
    number = lambda: rng.choice([rng.uniform(-1000, 1000), rng.randrange(-4000, 4000) / 8, rng.randrange(-(10**6), 10**6) / 200, -0.0, 1e300, math.nan, math.inf, -math.inf, -0.001, 1.005, 2.675, 1e15 + 0.5, 2.0**33 + 0.125, rng.uniform(-1e10, 1e10)])
    text = lambda: rng.choice([None, "", "a", 'a<b> & "c"', "x\r\n\t>", "\u00e9\U0001f600", "manual"])
    some = lambda f: [f() for _ in range(rng.randrange(3))]
    item = lambda: {"id": text(), "text": text(), "bbox": {k: number() for k in ("x0", "y0", "x1", "y1")}, "mask": text(), "conf": rng.choice([None, 0.5, 0.00005, number()]), "src": text()}
    arrow = lambda: {"src_id": text(), "dst_id": text(), "conf": rng.choice([None, number()]), "src": text()}
    parts = lambda: {"nodes": some(item), "rasters": some(item), "arrows": some(arrow)}
    return [{"blocks": some(lambda: item() | parts()), **parts()} for _ in range(n)]


def document(d):
    """A diagram's document, by a plain loop."""
    quoted = lambda v: '"' + escape(v or "", quote=False).replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#9;") + '"'

    def head(x):
        if "bbox" in x:
            out = f" i={quoted(x['id'])} t={quoted(x['text'])} b=\"{' '.join(f'{v:.2f}' for v in x['bbox'].values())}\"" + (f" mask={quoted(x['mask'])}" if x["mask"] is not None else "")
        else:
            out = f" s={quoted(x['src_id'])} d={quoted(x['dst_id'])}"
        out += f' conf="{x["conf"]:.4f}"' if x["conf"] is not None and not math.isnan(x["conf"]) else ""
        return out + (f" src={quoted(x['src'])}" if x["src"] not in (None, "manual") else "")

    def parts(of, pad):
        return "".join(f"{pad}<{k[:-1]}{head(x)}/>\n" for k in ("nodes", "rasters", "arrows") for x in of[k])

    body = "".join(f"  <block{head(b)}" + (f">\n{inside}  </block>\n" if (inside := parts(b, "    ")) else "/>\n") for b in d["blocks"]) + parts(d, "  ")
    return f"<diagram>\n{body}</diagram>\n" if body else "<diagram/>\n"


def test_documents_are_rendered_all_at_once(spark):
    made = diagrams(random.Random(11), 400)
    want = [document(d) for d in made]
    kinds = {f.name: f.dataType for f in _parse_datatype_string(layout.DIAGRAM).fields}
    columns = {k: pa.array([d[k] for d in made], to_arrow_type(kinds[k])) for k in made[0]}
    assert files._rendered(**columns).to_pylist() == want
    assert files._rendered(**{k: c.slice(100, 50) for k, c in columns.items()}).to_pylist() == want[100:150]
    assert files._rendered(**{k: c.slice(0, 0) for k, c in columns.items()}).to_pylist() == []
    df = spark.createDataFrame([{"image_id": str(k), **d} for k, d in enumerate(made)], layout.DIAGRAM).repartition(3)
    assert {int(r.image_id): r.xml for r in files.write_xml(df).collect()} == dict(enumerate(want))


def test_diagrams_are_assembled_in_one_shuffle(spark, monkeypatch):
    from glyphmill.operators import grid

    rng = random.Random(12)
    boxes = [(image, i, (x := rng.randrange(30), y := rng.randrange(30), x + rng.randrange(1, 25), y + rng.randrange(1, 25)), rng.random() < 0.2) for image, n in ((1, 60), (2, 4), (3, 1), (4, 25)) for i in range(n)]
    boxes += [(5, 0, (0, 0, 9, 9), True), (6, 0, (0, 0, 5, 5), False), (6, 1, (0, 0, 5, 5), False)]
    kind = "image_id int, ord int, box struct<x0:double,y0:double,x1:double,y1:double>, is_raster boolean"
    df = spark.createDataFrame([(m, i, tuple(map(float, b)), r) for m, i, b, r in boxes], kind).repartition(3)
    items = df.select("*", F.concat(F.lit("n"), F.col("ord").cast("string")).alias("id"), F.lit("").alias("text"), F.lit(None).cast("string").alias("mask"), F.lit(None).cast("double").alias("conf"))
    hold = lambda o, b: o[0] - 1 <= b[0] and o[1] - 1 <= b[1] and o[2] + 1 >= b[2] and o[3] + 1 >= b[3]
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])

    def plain(image, with_rasters):
        its = {i: b for m, i, b, r in boxes if m == image and not r}
        owner = {i: min((j for j in its if j != i and hold(its[j], its[i])), key=lambda j: (-area(its[j]), j), default=None) for i in its}
        blocks = [i for i in its if owner[i] is None and i in owner.values()]
        first = {i: min((j for j in blocks if hold(its[j], b)), default=None) for m, i, b, r in boxes if m == image and r and with_rasters}
        names = lambda of, k: [f"n{i}" for i in sorted(of) if of[i] == k]
        return [(f"n{k}", names(owner, k), names(first, k)) for k in sorted(blocks)], [f"n{i}" for i in sorted(its) if owner[i] is None and i not in blocks], names(first, None)

    ids = lambda a: [x.id for x in a]
    for dense in (None, 10):
        if dense:
            monkeypatch.setattr(grid, "DENSE", dense)
        for part in (items, items.where("NOT is_raster")):
            got = {r.image_id: ([(b.id, ids(b.nodes), ids(b.rasters)) for b in r.blocks], ids(r.nodes), ids(r.rasters)) for r in layout.assemble(part).collect()}
            assert got == {m: plain(m, part is items) for m in {m for m, _, _, r in boxes if part is items or not r}}
    monkeypatch.undo()
    plan = layout.assemble(items.withColumn("is_raster", F.lit(False)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2


def test_segment_and_assemble_ask_the_model_once_a_point(spark, monkeypatch, tmp_path):
    from glyphmill.adapters import predictors
    from glyphmill.plans import formats

    calls = str(tmp_path / "calls")

    def counting(mark, answer):
        class Counting:
            def predict(self, prompts, images):
                with open(calls, "a") as out:
                    out.write("x" * len(prompts))
                return [answer for _ in prompts]

            def unload(self):
                pass

        monkeypatch.setitem(predictors.REGISTRY, "counting", Counting)
        return "counting"

    monkeypatch.setattr(formats, "_rule", counting)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert catalogue.QUERIES["stage_segment_assemble"](spark, DATA).count() == n
    with open(calls) as done:
        assert len(done.read()) == n


def test_answers_are_parsed_once(spark):
    rng = random.Random(13)
    values = ["1", "2", '"3"', "4.7", '"4.7"', "true", "null", '"x"', "[1]", '{"a": 1}', "1e2", "1E400", "NaN", "Infinity", "99999999999", "-2147483649", "2147483647", '"1_0"', '"1__0"', '" +5 "', '"\\t6"', "01", "'1'", "5" + "0" * 120, "1" * 1500]

    def item():
        if rng.random() < 0.2:
            return rng.choice(values)
        keys = rng.choice([("from", "to"), ("to", "from"), ("from", "from", "to"), ("from",), ("From", "to")])
        return "{" + ", ".join(f'"{k}": {rng.choice(values)}' for k in keys) + "}"

    def plain(text):
        found = []
        if text is None or not (span := re.search(r"\[.*\]", text, re.DOTALL)):
            return found
        try:
            items = json.loads(span.group(0))
        except ValueError:
            return found
        for pair in items:
            try:
                edge = int(pair["from"]), int(pair["to"])
            except (KeyError, TypeError, ValueError, OverflowError):
                continue
            if all(-(2**31) <= n < 2**31 for n in edge):
                found.append(edge)
        return found

    answers = [rng.choice(["[", "so: [", "[["]) + ", ".join(item() for _ in range(rng.randrange(5))) + rng.choice(["]", "] end", "]]", ""]) for _ in range(3000)]
    # repeated keys beside an item that is no object, and a number that is too long, cost only their item
    answers += [None, "", "]x[", "[", '[7, {"from": 1, "from": 2, "to": 3}]', '[{"from": %s, "to": 1}, {"from": 1, "to": 2}]' % ("1" * 1500), "[" * 50_000 + "]" * 50_000]
    want = [plain(a) for a in answers[:-1]] + [[]]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, t string").repartition(3)
    assert {r.i: [tuple(e) for e in r.e] for r in df.select("i", T.edges(F.col("t")).alias("e")).collect()} == dict(enumerate(want))
    assert df.where("false").select(T.edges(F.col("t"))).collect() == []
    for name in ("json_edges", "mark_edges"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and len(re.findall(r"ArrowEvalPython", plan)) == 1


def test_documents_are_read_as_by_a_plain_loop(spark):
    rng = random.Random(14)
    texts = [document(d) for d in diagrams(rng, 150)]
    number = lambda: rng.choice(["1", "-2.5", " 3 ", "1e3", ".5", "inf", "nan", "1_0", "0x1", "1d", "", "x"] if rng.random() < 0.1 else ["1", "2.25", "-7"])

    def some(tag, depth=0):
        values = {"i": rng.choice(["a", " a ", "x&#10;y&lt;"]), "t": "t", "b": " ".join(number() for _ in range(4)), "conf": number(), "mask": "m", "src": rng.choice(["manual", "sam", ""]), "s": "p", "d": "q", "z": "1"}
        kept = " ".join(f'{k}="{v}"' for k, v in values.items() if rng.random() < 0.6)
        inside = "".join(some(rng.choice(["node", "raster", "arrow", "block", "other"]), depth + 1) for _ in range(rng.randrange(3))) if depth < 2 else ""
        return f"<{tag} {kept}>{inside}</{tag}>"

    for _ in range(300):
        body = "".join(some(rng.choice(["block", "block", "node", "raster", "arrow", "other"])) for _ in range(rng.randrange(4)))
        texts.append(rng.choice(["", '<?xml version="1.0" encoding="utf-8"?>', "<!-- n -->"] if rng.random() < 0.2 else [""]) + f"<diagram>{body}" + rng.choice(["</diagram>"] * 12 + ["", "</node>", "</diagram><a/>", "&no;</diagram>", "x</diagram>\n"]))
    texts += [None, "", " ", "<a", "</diagram>", "</diagram><diagram>", "<node i='n'/>", '<arrow b="x"/>', '<diagram><arrow b="x"/></diagram>', '<diagram><node b="0 0 0 0 0"/></diagram>', "<diagram>" * 3000 + "</diagram>" * 3000]

    def plain(text):
        def part(e):
            ends = {"conf": float(e.get("conf")) if e.get("conf") is not None else None, "src": e.get("src", "pointing" if e.tag == "raster" else "manual")}
            if e.tag == "arrow":
                return {"src_id": e.get("s", ""), "dst_id": e.get("d", ""), **ends}
            x0, y0, x1, y1 = (float(v) for v in e.get("b", "0 0 0 0").split())
            inside = parts(e) if e.tag == "block" else {}
            return {"id": e.get("i", ""), "text": e.get("t", ""), "bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "mask": e.get("mask"), **ends, **inside}

        parts = lambda of, tags=("node", "raster", "arrow"): {f"{tag}s": [part(e) for e in of if e.tag == tag] for tag in tags}
        all_ = ("block", "node", "raster", "arrow")
        try:
            return {**parts(() if text is None else ElementTree.fromstring(text), all_), "problem": None}
        except (ElementTree.ParseError, ValueError) as e:
            return {**parts((), all_), "problem": "not XML" if isinstance(e, ElementTree.ParseError) else "not a number"}

    want = [plain(t) for t in texts]
    assert {"not XML", "not a number", None} == {w["problem"] for w in want}
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "image_id string, xml string").repartition(3)
    got = {int(r.image_id): {k: v for k, v in r.asDict(True).items() if k != "image_id"} for r in files.parse_xml(df, strict=False).collect()}
    assert all(repr(got[k]) == repr(w) for k, w in enumerate(want))
    fine = [k for k, w in enumerate(want) if w["problem"] is None]
    read = files.parse_xml(df.where(F.col("image_id").isin([str(k) for k in fine])))
    assert sorted(int(r.image_id) for r in read.collect()) == fine
    assert "from_xml" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert files.parse_xml(df.where("false")).collect() == []
