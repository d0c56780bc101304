"""Operators against plain Python on random small inputs, and cases with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.functions import images, masks, png
from glyphmill.functions import text as T
from glyphmill.operators import joins, layout, ordered, review, sampling
from glyphmill.sources import files


def boxes(spark, n_images=40, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n_images):
        for k in range(1, rng.randrange(2, 9)):
            x, y = rng.randrange(30), rng.randrange(30)
            data.append((i, k, float(x), float(y), float(x + rng.randrange(1, 30)), float(y + rng.randrange(1, 30))))
    df = spark.createDataFrame(data, "image_id long, ord int, x0 double, y0 double, x1 double, y1 double")
    return data, df.select("image_id", "ord", G.box(*[F.col(s) for s in G.SIDES]).alias("box"))


def test_claims_equal_a_greedy_loop(spark):
    data, df = boxes(spark)
    want = {}
    for image in {d[0] for d in data}:
        items = sorted((d for d in data if d[0] == image), key=lambda d: (-(d[4] - d[2]) * (d[5] - d[3]), d[1]))
        for o in items:
            for i in items:
                inside = o[2] - 1 <= i[2] and o[3] - 1 <= i[3] and o[4] + 1 >= i[4] and o[5] + 1 >= i[5]
                if o is not i and inside and (image, i[1]) not in want:
                    want[image, i[1]] = o[1]
    assert {(r.image_id, r.ord): r.owner for r in joins.claims(df).collect()} == want


def test_suppression_equals_a_loop(spark):
    data, df = boxes(spark, seed=2)

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        s = max(0, w) * max(0, h)
        return s / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - s) if s else 0

    want = set()
    for image in {d[0] for d in data}:
        kept = []
        for d in sorted((d for d in data if d[0] == image), key=lambda d: (-(d[4] - d[2]) * (d[5] - d[3]), d[1])):
            if all(iou(d, k) <= 0.3 for k in kept):
                kept.append(d)
        want |= {(d[0], d[1]) for d in kept}
    assert {(r.image_id, r.ord) for r in joins.suppress(df, 0.3).collect()} == want


@pytest.mark.parametrize(
    ("actions", "state", "illegal"),
    [
        (["open_points", "confirm_points", "accept", "reopen"], "needs_point_review", 0),
        (["accept"], "proposed", 1),
        (["open_points", "merge", "reopen"], "needs_point_review", 0),
        (["open_mask", "back_to_points", "reject", "accept"], "rejected", 1),
    ],
)
def test_state_machine(spark, actions, state, illegal):
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(actions)], "k int, at int, action string")
    r = review.replay(df, "k", ["at"]).first()
    assert (r.state, r.n_illegal) == (state, illegal)


def test_point_edits_keep_the_first_place(spark):
    log = [(1, 0, "propose", 1.0, 1.0), (1, 1, "move", 5.0, 6.0), (1, 2, "move", 7.0, 8.0), (1, 3, "toggle", None, None), (2, 0, "add", 3.0, 3.0), (2, 1, "move", 4.0, 4.0), (2, 2, "delete", None, None)]
    got = {r.p: r for r in review.edited_points(spark.createDataFrame(log, "p int, at int, action string, x double, y double"), "p", "at").collect()}
    assert (got[1].x, got[1].original_x, got[1].original_y, got[1].source, got[1].label) == (7.0, 1.0, 1.0, "human_moved", 0)
    assert (got[2].source, got[2].present, got[2].original_x) == ("human_added", False, None)


def test_undo_stack_is_bounded(spark):
    log = [(1, i, "do", str(i)) for i in range(25)] + [(1, 25, "undo", None), (1, 26, "undo", None), (1, 27, "redo", None)]
    r = review.undo_stack(spark.createDataFrame(log, "k int, at int, action string, state string"), "k", "at").first()
    assert r.undo == [str(i) for i in range(4, 23)] and r.redo == ["24"] and r.state == "23"


def test_code_extraction(spark):
    cases = [
        ("```latex\n\\documentclass{a}x\\end{document}junk\n```", "\\documentclass{a}x\\end{document}"),
        ("<think>\\documentclass no</think>\\documentclass{b} cut off", "\\documentclass{b} cut off"),
        ("```a```\n```tex\n\\documentclass{long}\\end{document}```", "\\documentclass{long}\\end{document}"),
        ("nothing", None),
        (None, None),
        ("", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.c for r in df.select("i", T.extract_code(F.col("t"), "tikz").alias("c")).orderBy("i").collect()] == [w for _, w in cases]


def test_bad_items_cost_only_themselves(spark):
    df = spark.createDataFrame([('x [{"from": 1, "to": "2"}, {"from": "a", "to": 3}, 7, {"from": 4.7, "to": true}] y',), ("[broken",), (None,)], "t string")
    got = [[(e.src, e.dst) for e in (r.e or [])] for r in df.select(T.edges(F.col("t")).alias("e")).collect()]
    assert got == [[(1, 2), (4, 1)], [], []]


def test_box_text_rounds_exactly(spark):
    df = spark.createDataFrame([(0.125, 2.675, 1.005, 3.0)], "a double, b double, c double, d double")
    assert df.select(T.box_text(G.box(*[F.col(c) for c in "abcd"])).alias("t")).first().t == "0.12 2.67 1.00 3.00"


def test_xml_round_trip(spark):
    none = F.lit(None)
    _, df = boxes(spark, 10, 3)
    items = df.select("image_id", "ord", F.concat(F.lit("n"), F.col("ord").cast("string")).alias("id"), F.lit('a<b> & "c"').alias("text"), "box", none.cast("string").alias("mask"), F.lit(0.5).alias("conf"), (F.col("ord") == 2).alias("is_raster"))
    made = layout.assemble(items)
    back = files.parse_xml(files.write_xml(made))
    key = lambda df: sorted((r.image_id, str(r.blocks), str(r.nodes), str(r.rasters)) for r in df.collect())
    assert key(back) == key(made)


def test_mask_text_round_trip():
    rng = np.random.default_rng(0)
    for h, w, p in ((48, 64, 0.3), (5, 7, 1.0), (5, 7, 0.0), (1, 1, 1.0), (300, 200, 0.001)):
        m = rng.random((h, w)) < p
        assert (masks.decode(masks.from_text(masks.to_text(masks.encode(m)))) == m).all()


def figure():
    grey = np.full((400, 500), 255, np.uint8)
    truth = [(40, 40, 120, 90), (250, 60, 150, 100), (60, 220, 140, 120), (300, 250, 110, 80)]
    for x, y, w, h in truth:
        grey[y : y + h, [x, x + 1, x + w - 2, x + w - 1]] = 0
        grey[[y, y + 1, y + h - 2, y + h - 1], x : x + w] = 0
    return grey, truth


def test_segmentation_finds_boxes():
    grey, truth = figure()
    found = images.reconcile(grey, [(str(i), x + w // 2, y + h // 2) for i, (x, y, w, h) in enumerate(truth)])
    for (x, y, w, h), f in zip(truth, found):
        assert f["source"] == "flood" and images.iou_xywh(f["box"], (x + 2, y + 2, w - 4, h - 4)) >= 0.9
    assert images.reconcile(grey, [("stray", 240, 10)])[0]["source"] == "needs_review"


def test_labels_equal_a_flood():
    rng = np.random.default_rng(1)
    mask = rng.random((30, 30)) < 0.55
    got = images.label(mask)
    seen, n = np.zeros_like(got), 0
    for y, x in np.argwhere(mask):
        if not seen[y, x]:
            n += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 30 and 0 <= b < 30 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert (got == seen).all()


def test_fill_keeps_the_mask_where_opening_would_lose_it():
    line = np.zeros((20, 20), bool)
    line[10, 3:17] = True
    assert images.fill(line)[0].any() and not images.fill(line)[1]


def test_numbering_in_ranges_equals_a_window(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"))
    got = {r.k: r.idx for r in ordered.numbered(df, "k", range_rows=100).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    cuts = [3, 7, 7.5, 20, 21, 40, 41, 99]
    keys = spark.createDataFrame([(float(k),) for k in range(-2, 105)], "k double")
    assert {r.k: r.r for r in keys.select("k", ordered.range_of(F.col("k"), cuts).alias("r")).collect()} == {float(k): sum(c <= k for c in cuts) for k in range(-2, 105)}


def test_numbers_of_ties_follow_their_order(spark):
    df = spark.range(600).select((F.col("id") % 3).alias("k"), (F.lit(1000) - F.col("id")).alias("t"))
    got = [(r.k, r.t) for r in ordered.numbered(df, "k", range_rows=100, ties=("t",)).orderBy("idx").collect()]
    assert got == sorted(got)


def test_samples_rerun_alike(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    pick = lambda: [r.k for r in sampling.select_samples(df, "k", 10, 3).collect()]
    ids = list(range(50))
    random.Random(3).shuffle(ids)
    assert pick() == pick() == ids[:10]
    assert [r.k for r in sampling.select_samples(df, "k", 60, 3).collect()] == list(range(50))


def _touch(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")


def test_images_are_paired_by_folder_and_name(spark, tmp_path):
    _touch(tmp_path, "images/b.png", "images/a.png", "images/c.jpg", "tex_files/a.tex", "xml_files/layout_b.xml", "old/tex_files/b.tex", "layout_a.xml", "gt/a.tex")
    got = files.discover_images(spark, str(tmp_path)).collect()
    assert [(r.id, bool(r.gt_tex_path), bool(r.gt_xml_path)) for r in got] == [("a", True, False), ("b", False, True)]
    assert files.listing(spark, str(tmp_path / "none")).count() == files.discover_samples(spark, str(tmp_path / "none")).count() == 0


def test_samples_by_id(spark, tmp_path):
    _touch(tmp_path, "tex_files/ICML_2020_arch1.tex", "tex_files/CVPR_2021_pipe2.tex", "tex_files/CVPR_2020_arch12x.tex", "original_images/ICML_2020_arch1.png", "original_images/CVPR_2021_pipe2.jpg")
    _touch(tmp_path, "tex_images/ICML_2020_arch1.png", "tex_pdfs/ICML_2020_arch1.pdf", "failure_cases/CVPR_2021_pipe2.log", "rendered/CVPR_2021_pipe2.png")
    got = {r.id: r for r in files.discover_samples(spark, str(tmp_path)).collect()}
    assert list(got) == sorted(got) and len(got) == 3
    a, b, c = got["ICML_2020_arch1"], got["CVPR_2021_pipe2"], got["CVPR_2020_arch12x"]
    assert a.image_path and a.has_rendered and a.pdf_path and not a.failed_compile and (a.venue, a.year, a.kind) == ("ICML", "2020", "arch")
    assert not b.image_path and not b.has_rendered and b.failed_compile and (b.venue, b.year, b.kind) == ("CVPR", "2021", "pipe")
    assert (c.venue, c.year, c.kind) == (None, None, None)


def test_samples_below_a_folder(spark, tmp_path):
    root = tmp_path / "set" / "x" / "set"
    _touch(root, "a.tex", "set/b.tex", "set/b.png", "c/d.tex", "c/crops/deep/1.png", "e/f.tex", "e/target.jpeg", "e/aa.png")
    got = {r.id: r.image_path for r in files.discover_samples(spark, str(root)).collect()}
    ends = {i: p and p.rsplit(str(root), 1)[1] for i, p in got.items()}
    assert ends == {"a": None, "set/b": "/set/b.png", "c/d": "/c/crops/deep/1.png", "e/f": "/e/target.jpeg"}


def test_tables_are_replaced_and_zipped(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, tex string")
    files.replace_table(df, str(tmp_path / "t"))
    files.replace_table(df.union(df), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert files.export_zip(df, "id", "tex")[:2] == b"PK"


LAYOUT = """<diagram>
  <block i="b1" t="A" b="-1.00 0.00 10.00 20.00" mask="m.png" conf="0.9000" src="sam">
    <node i="n1" t="x &amp; &quot;y&quot;" b="1.00 2.00 3.00 4.00"/>
    <raster i="r1" t="" b="1.00 1.00 2.00 2.00" src="pointing"/>
    <arrow s="n1" d="b1" conf="0.2500"/>
  </block>
  <node i="n2" t="" b="0.00 0.00 0.00 0.00"/>
  <arrow s="n1" d="n2" src="som"/>
</diagram>
"""


def test_layout_documents_as_written(spark):
    read = files.parse_xml(spark.createDataFrame([("i", LAYOUT)], "image_id string, xml string"))
    b = read.first().blocks[0]
    assert (b.id, b.text, b.bbox.x0, b.mask, b.conf, b.src) == ("b1", "A", -1.0, "m.png", 0.9, "sam") and b.nodes[0].text == 'x & "y"' and b.rasters[0].src == "pointing" and b.arrows[0].conf == 0.25
    assert files.write_xml(read).first().xml == LAYOUT
    odd = spark.createDataFrame([("e", "<diagram/>"), ("n", '<diagram><block i="a"><block i="in"/></block><odd i="z"/><raster b="1.005 2 3 4"/></diagram>')], "image_id string, xml string")
    got = {r.image_id: r for r in files.parse_xml(odd).collect()}
    assert got["e"].blocks == got["e"].nodes == [] and len(got["n"].blocks) == 1 and got["n"].blocks[0].bbox.x1 == 0 and got["n"].rasters[0].src == "pointing" and got["n"].nodes == []
    assert files.write_xml(files.parse_xml(odd.where("image_id = 'e'"))).first().xml == "<diagram/>\n"


def test_answers_of_models(spark):
    one = lambda c, text: spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("r")).first().r
    edges = lambda t: [(e.src, e.dst) for e in one(T.edges, t)]
    assert edges('so [{"from": "3", "to": 4.7}, {"from": "4.7", "to": 1}, {"from": true, "to": 2}, {"from": 1}, [1, 2], 5, {"from": null, "to": 1}] ok') == [(3, 4), (1, 2)]
    assert edges("none") == edges('[{"from": 1, "to"') == []
    box = lambda t: [tuple(b) for b in one(lambda c: T.boxes(c, F.array(F.lit(1), F.lit(2))), t)]
    assert box('<think>[{"object_id": 2, "box": [0, 0, 1, 1]}]</think> [{"object_id": 1, "box": [1, "2", 3.5, 4]}, {"object_id": 9, "box": [1, 2, 3, 4]}, {"object_id": 2, "box": [3, 2, 1, 4]}, {"object_id": 2, "box": [1, 2, 3]}, {"object_id": 2, "box": [1, 2, 3, 4, 5]}, {"id": 2, "box": [1, 2, 3, 4]}]') == [(1, 1.0, 2.0, 3.5, 4.0)]
    judge = lambda t: tuple(one(T.judge, t))
    assert judge('x {"score": 5, "rationale": "fine"} y') == (5, "fine") and judge('{"score": "4"}') == (4, "") and judge('{"score": 4.7, "rationale": "r"}') == (4, "r")
    assert judge('{"score": 6}') == (None, "score out of range: 6") and judge('{"score": 0, "rationale": "r"}') == (None, "score out of range: 0")
    assert judge("no") == (None, "could not parse judge output: no") and judge('{"score": 1} {"score": 2}')[1].startswith("could not parse judge output: {") and judge('{"score": "4.5"}')[0] is None
    points = lambda t: [(p.object_id, p.x, p.y) for p in one(lambda c: T.point_tags(c, F.lit(100.0), F.lit(200.0)), t)]
    assert points('<points n="1" coords="1 500 250; 2 12 300, 3 1000 1000"/> <tracks coords="4 100 100">') == [(1, 50.0, 50.0), (3, 100.0, 200.0), (4, 10.0, 20.0)]
    assert points('coords="1 500 250"') == points('<points coords="1 500 250" alt="x">') == points('<points coords="1 1001 250">') == []
    reason = lambda t: one(T.failure_reason, t)
    assert reason("x") == "no \\documentclass found in model output" and reason("\\documentclass <think></think> x").endswith("before reaching the answer") and reason("\\documentclass{a}") is None


def test_human_actions(spark):
    actions = ["point_add", "point_move", "point_delete", "point_label_toggle", "mask_reject_manual_box", "mask_accept", "state_change", "point_toggle"]
    df = spark.createDataFrame([(a,) for a in actions], "a string").select("a", review.human_touched(F.array(F.struct(F.col("a").alias("action"), F.lit("open_points").alias("detail")))).alias("t"))
    assert [r.a for r in df.collect() if r.t] == actions[:5]


def test_undo_and_redo_bring_back_states(spark):
    log = [("edit", "s1"), ("edit", "s2"), ("undo", None), ("redo", None), ("undo", None), ("undo", None), ("undo", None), ("redo", None)]
    state, undo, redo = None, [], []
    for action, new in log:
        if action == "edit":
            undo, redo, state = [*undo, state][-20:], [], new
        elif action == "undo" and undo:
            redo, state, undo = [*redo, state], undo[-1], undo[:-1]
        elif action == "redo" and redo:
            undo, state, redo = [*undo, state], redo[-1], redo[:-1]
    got = review.undo_stack(spark.createDataFrame([(1, i, *x) for i, x in enumerate(log)], "k int, at int, action string, state string"), "k", "at").first()
    assert (got.state, got.undo, got.redo) == (state, undo, redo) == ("s1", [None], ["s2"])


def test_opening_is_a_plus():
    mask = np.zeros((30, 30), bool)
    mask[5:25, 5:25] = True
    mask[2, 2] = True
    got, opened = images.fill(mask)
    assert opened and not got[2, 2] and got[6:24, 6:24].all() and not got[5, 5] and got[5, 6]


def _png(pixels):


    return png.encode(pixels)


def test_segmentation_of_image_files(spark, tmp_path):
    from glyphmill.operators import segmentation

    grey, truth = figure()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "fig.png").write_bytes(_png(np.stack([grey] * 3, axis=2)))
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    (tmp_path / "points").mkdir()
    seeds = [{"id": f"p{i}", "x": x + w / 2 + 0.9, "y": y + h // 2} for i, (x, y, w, h) in enumerate(truth)] + [{"id": "stray", "x": 240, "y": 10}]
    (tmp_path / "points" / "fig.json").write_text(__import__("json").dumps(seeds))
    found = segmentation.segment(segmentation.read_images(spark, str(tmp_path / "in")), segmentation.seeds(spark, str(tmp_path / "points")))
    got = {r.id: r for r in found.collect()}
    assert len(got) == 5 and got["stray"].source == "needs_review" and got["stray"].png is None
    for i, (x, y, w, h) in enumerate(truth):
        r = got[f"p{i}"]
        assert r.source == "flood" and images.iou_xywh((r.x, r.y, r.w, r.h), (x + 2, y + 2, w - 4, h - 4)) >= 0.9
        assert masks.decode(masks.from_text(r.rle)).sum() == r.w * r.h
    segmentation.write_outputs(found, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out" / "masks" / "fig").iterdir()) == [f"p{i}.png" for i in range(4)]
    assert sorted(__import__("json").loads((tmp_path / "out" / "fig.json").read_text())) == [f"p{i}" for i in range(4)]
    back = spark.read.format("image").load(str(tmp_path / "out" / "masks" / "fig" / "p0.png")).select("image.*").first()
    assert (back.height, back.width) == grey.shape and sum(b == 255 for b in back.data) // back.nChannels == got["p0"].w * got["p0"].h
    outside = spark.createDataFrame([("fig", "o", 500, 3)], "image_id string, id string, x int, y int")
    with pytest.raises(Exception, match="points outside"):
        segmentation.segment(segmentation.read_images(spark, str(tmp_path / "in")), outside).collect()


def test_stages_from_images_to_judged_rows(spark, tmp_path):
    from glyphmill import __main__ as cli
    from glyphmill.adapters import predictors
    from glyphmill.plans import stages

    (tmp_path / "data" / "images").mkdir(parents=True)
    for name in ("a", "b"):
        (tmp_path / "data" / "images" / f"{name}.png").write_bytes(_png(np.full((100, 200), 255, np.uint8)))
    big, small = (masks.to_text(masks.encode(images.filled(b, 100, 200))) for b in ((5, 5, 180, 90), (20, 20, 30, 30)))
    rules = {
        "hold a label": '<points coords="0 500 500, 1 150 300">',
        "every picture": '<points coords="7 800 800">',
        "Hint points": '[{"object_id": 7, "box": [150, 70, 170, 90]}]',
        '"point":[100.0,50.0]': big,
        '"point":[30.0,30.0]': small,
        '"point":[160.0,80.0]': small[:-1] + ', "score": 0.5}',
        "Numbered markers": '[{"from": 0, "to": 1}]',
        "TikZ": "```latex\n\\documentclass{a} x \\end{document}\n```",
        "Compare": '{"score": 4, "rationale": "same"}',
    }
    predictors.REGISTRY["rules"] = lambda: predictors.Scripted(rules)
    kept = predictors.RENDERERS["tikz"]
    predictors.RENDERERS["tikz"] = lambda code: (True, code.encode(), "")
    try:
        models = [x for part in ("pointing", "boxing", "segmentation", "edging", "coding", "judging") for x in (f"--{part}", "rules")]
        with pytest.raises(FileNotFoundError, match="run `point` first"):
            cli.main(["box", str(tmp_path / "data"), str(tmp_path / "out"), *models])
        for name in stages.Engine.NAMES:
            assert cli.main([name, str(tmp_path / "data"), str(tmp_path / "out"), *models]) == 0
        engine = stages.Engine(spark, str(tmp_path / "out"), "data", files.discover_images(spark, str(tmp_path / "data")), *["rules"] * 6)
        d = engine.load("edges").orderBy("image_id").first()
        assert [b.id for b in d.blocks] == ["node_0"] and [n.id for n in d.blocks[0].nodes] == ["node_1"] and [r.id for r in d.blocks[0].rasters] == ["raster_7"]
        assert [(a.src_id, a.dst_id, a.src) for a in d.arrows] == [("node_0", "node_1", "som")] and d.blocks[0].src == "sam"
        assert engine.load("box").count() == 2
        judged = engine.run("judge").collect()
        assert sorted((r.sample_id, r.render_ok, r.judge_score, r.kept) for r in judged) == [("a", True, 4, True), ("b", True, 4, True)]
        assert spark.read.json(engine.path("judge")).count() == 4  # the command's run and this one
    finally:
        predictors.RENDERERS["tikz"] = kept


def test_benchmark_and_score(spark, tmp_path):
    from glyphmill import __main__ as cli
    from glyphmill.adapters import predictors

    _touch(tmp_path, "data/tex_files/A_2020_arch1.tex", "data/tex_files/A_2020_arch2.tex", "data/original_images/A_2020_arch1.png", "data/original_images/A_2020_arch2.png")
    predictors.REGISTRY["tex"] = lambda: predictors.Scripted({"TikZ": "\\documentclass{a}\\end{document}", "Compare": '{"score": 3, "rationale": "r"}'})
    kept = predictors.RENDERERS["tikz"]
    predictors.RENDERERS["tikz"] = lambda code: (True, b"x", "")
    try:
        assert cli.main(["benchmark", str(tmp_path / "data"), str(tmp_path / "out"), "--model", "tex"]) == 0
        assert cli.main(["score", str(tmp_path / "out"), "--judge", "tex"]) == 0
        summary = spark.read.json(str(tmp_path / "out" / "summary")).first()
        assert (summary.n, summary.n_compiled, summary.judge_score_mean) == (2, 2, 3.0)
    finally:
        predictors.RENDERERS["tikz"] = kept


def test_records_from_points_to_masks(spark, tmp_path):
    from glyphmill import __main__ as cli
    from glyphmill.sources import records

    points = spark.createDataFrame([("img", "m", "node", 0, 1.0, 2.0), ("img", "m", "node", 1, 3.0, 4.0), ("old", "m", "node", 0, 1.0, 1.0)], "id string, model string, kind string, object_id long, x double, y double")
    records.write_points(points, str(tmp_path / "points"))
    folder, path = f"file://{tmp_path}/records", str(tmp_path / "records")
    _touch(tmp_path, "records/old.json")
    (tmp_path / "records" / "old.json").write_text('{"schema_version": 1, "image": {"id": "old", "instances": []}, "instances": []}')
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "img.png").write_bytes(png.encode(np.zeros((20, 30), bool)))
    assert cli.main(["ingest", str(tmp_path / "points"), folder, "--model", "m", "--images", str(tmp_path / "images")]) == 0
    read = {r.id: r.record for r in records.read_records(spark, path).collect()}
    assert [i.state for i in read["img"].instances] == ["proposed"] * 2 and read["img"].instances[0].points[0].source == "molmo" and read["old"].instances == [] and read["img"].instances[0].edit_log == []
    form = __import__("json").loads((tmp_path / "records" / "img.json").read_text())
    m = np.zeros((20, 20), bool)
    m[5:15, 5:15] = True
    form["instances"][0] |= {"state": "accepted", "mask_rle": masks.to_text(masks.encode(m)), "mask_source": "sam3_auto"}
    (tmp_path / "records" / "img.json").write_text(__import__("json").dumps(form))
    for name in ("export", "prepare", "validate"):
        assert cli.main([name, path, f"file://{tmp_path}/{name}"]) == 0
    assert spark.read.json(str(tmp_path / "export" / "totals")).first().total_accepted == 1
    row = spark.read.json(str(tmp_path / "prepare" / "manifest")).first()
    assert set(row.asDict()) == {"instance_id", "image_id", "file_path", "mask_path", "width", "height", "points", "mask_source", "opening_applied"}
    assert (row.width, row.height, row.file_path.endswith("images/img.png"), [p.asDict() for p in row.points]) == (30, 20, True, [{"x": 1.0, "y": 2.0, "label": 1}])
    assert row.opening_applied and (tmp_path / "prepare" / "img").is_dir()
    assert spark.read.json(str(tmp_path / "validate" / "summary")).first()["mean"] > 0.9
    assert cli.main(["qa", path, str(tmp_path / "prepare")]) == 0
    (tmp_path / "records" / "bad.json").write_text('{"schema_version": 2}')
    with pytest.raises(Exception, match="schema version of bad is 2"):
        records.read_records(spark, path).collect()


def test_predictors(spark):
    from glyphmill.adapters import predictors

    df = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, prompt string")
    assert predictors.predict(df, "stub").where("ok").count() == 2
    with pytest.raises(KeyError):
        predictors.get("none")
    assert predictors.replayed(df, spark.createDataFrame([("a", "y")], "id string, answer string")).where("ok").count() == 1


def test_records_round_trip(spark):
    from glyphmill.sources import records

    points = spark.createDataFrame([("img", 0, 10.0, 20.0), ("img", 1, 30.0, 40.0)], "image_id string, object_id int, x double, y double")
    made = records.proposed(points)
    ids = [r.instance.id for r in made.orderBy("instance.id").collect()]
    image = F.struct(F.lit("img").alias("id"), F.array(F.lit("gone"), *map(F.lit, reversed(ids))).alias("instances"))
    whole = made.groupBy("image_id").agg(F.collect_list("instance").alias("all")).select(records.to_json(image, F.col("all")).alias("j")).select(records.from_json(F.col("j")).alias("r")).first().r
    assert [i.id for i in whole.instances] == ids[::-1] and {i.state for i in whole.instances} == {"proposed"} and whole.schema_version == 1


def test_writes_are_checked(spark):
    from glyphmill.sources import records

    writes = spark.createDataFrame([("a", "u", "done"), ("a", "x", "done"), ("a", "u", "odd"), ("z", "u", None), ("a", None, None)], "sample_id string, user string, status string")
    got = records.checked(writes, ["u"], spark.createDataFrame([("a",)], "sample_id string"))
    assert sorted(str(r.problem) for r in got.collect()) == ["None", "unknown sample", "unknown status", "unknown user", "unknown user"]


def test_stages_write_and_read(spark, tmp_path):
    from glyphmill.plans.stages import Pipeline

    p = Pipeline(str(tmp_path), "set")

    @p.stage("double")
    def double(df):
        return df.withColumn("x", F.col("id") * 2)

    @p.stage("few")
    def few(df):
        return df.where("x < 10")

    assert p.run(spark, spark.range(100)).count() == 5
    with pytest.raises(KeyError):
        p.run(spark, spark.range(1), only=["none"])


def test_stream_of_writes_equals_batch(spark, tmp_path):
    from glyphmill.streaming import review as streams

    rows = [(i % 7, i, f"t{i}" if i % 2 else None, f"u{i}", "done" if i % 5 == 0 else None) for i in range(60)]
    schema = "k int, at int, tex string, user string, status string"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    streams.upsert_stream(stream, str(tmp_path / "log"), str(tmp_path / "check"), "k", ["at"], "tex", "user", "status").awaitTermination()
    got = streams.current(spark, str(tmp_path / "log"), "k", ["at"], "tex", "user", "status")
    want = ordered.upsert(spark.createDataFrame(rows, schema), "k", ["at"], "tex", "user", "status")
    key = lambda df: sorted((r.k, r.tex, r.user, r.status) for r in df.collect())
    assert key(got) == key(want)


def test_losses():
    from glyphmill.functions import losses

    truth = np.zeros((8, 8))
    truth[2:6, 2:6] = 1
    good, bad = (truth * 2 - 1) * 9, (1 - truth * 2) * 9
    assert losses.dice(good, truth) < 0.01 < losses.dice(bad, truth) and losses.cross_entropy(good, truth) < 0.01 < losses.cross_entropy(bad, truth)
    assert losses.overlap_error(1.0, good, truth) == 0 and losses.overlap_error(1.0, bad, truth) == 1 and losses.overlap_error(0.0, good * 0 - 1, truth * 0) == 0


@pytest.mark.parametrize(("queries", "rows_"), [(4_000, 2_000), (3, 7)])
def test_top_k_equals_all_pairs(spark, monkeypatch, queries, rows_):
    from glyphmill.functions import vectors

    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", queries)
    monkeypatch.setattr(vectors, "ROWS", rows_)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(60, 5)), 1)
    v[7] = 0
    v[20:23] = v[3]  # ties go to the least id
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in vectors.top_k(df, df.where("vec_id % 5 = 0"), 4).collect()}
    want = {}
    for q in (i for i in range(0, 60, 5) if i != 7):
        best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in range(60) if i not in (q, 7))[:4]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in got)


def test_interactive_masks_embed_each_image_once():
    from glyphmill.adapters.predictors import Interactive

    seen = []
    backend = Interactive(lambda i: seen.append(i) or i.upper(), lambda held, points, box: ((held, len(points), box), 1.0))
    with pytest.raises(RuntimeError, match="isn't embedded"):
        backend.segment("a", [(1, 2, True)])
    backend.open("a")
    backend.open("a")
    assert backend.segment("a", [(1, 2, True)])[0] == ("A", 1, None) and backend.segment("a", box=(0, 0, 1, 1))[0][2] == (0, 0, 1, 1)
    with pytest.raises(ValueError, match="points or a box"):
        backend.segment("a")
    backend.open("b")
    with pytest.raises(RuntimeError):
        backend.segment("a", [(1, 2, True)])
    assert seen == ["a", "b"]
