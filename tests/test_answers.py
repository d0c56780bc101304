"""Odd answers of models and odd documents: each stands in a row with good ones, which stay as they are."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.sources import files

GOOD_EDGES = ('[{"from": 1, "to": 2}]', [(1, 2)])
EDGES = [
    ('[{"from": 99999999999, "to": 1}, {"from": 1, "to": 2}]', [(1, 2)]),
    ('[{"from": 99999999999999999999999, "to": 1}, {"from": 3, "to": 2}]', [(3, 2)]),
    ('[{"from": "3", "to": " 4 "}]', [(3, 4)]),
    ('[{"from": "1_0", "to": "+2"}]', [(10, 2)]),
    ('[{"from": 1.9, "to": true}]', [(1, 1)]),
    ('[{"from": "1.9", "to": 1}, {"from": "true", "to": 1}, {"from": null, "to": 1}, {"to": 1}]', []),
    ('[5, "x", null, [1], {"from": 1, "to": 2}]', [(1, 2)]),
    ('[{"from": 7, "from": 8, "to": 9}]', [(8, 9)]),
    ("[{'from': 1, 'to': 2}]", []),
    ('[{"from": 1, "to": 2}]]', []),
    ('[{"from": 1, "to": 2}] and [{"from": 3, "to": 4}]', []),
    ('so: [{"from": 1, "to": 2}, {"from": -5, "to": 2}] done', [(1, 2), (-5, 2)]),
    ('[{"from": {"a": 1}, "to": 2}]', []),
    ('[{"from": "' + "1_" * 9000 + '1", "to": 1}, {"from": "1__0", "to": 1}, {"from": "_1", "to": 1}, {"from": 2, "to": "1_"}, {"from": 2, "to": 1}]', [(2, 1)]),
    ("", []),
    (None, []),
    ("[]", []),
]
BOXES = [
    ('[{"object_id": 99999999999, "box": [1, 2, 3, 4]}, {"object_id": 1, "box": [1, 2, 3, 4]}]', [(1, 1, 2, 3, 4)]),
    ('[{"object_id": 1, "box": ["1d", 2, 3, 4]}, {"object_id": 2, "box": ["1e0", " 2 ", "3.5", 4]}]', [(2, 1, 2, 3.5, 4)]),
    ('[{"object_id": 1, "box": "1234"}, {"object_id": 2, "box": "12345"}, {"object_id": 2, "box": 1234}]', [(1, 1, 2, 3, 4)]),
    ('[{"object_id": "2", "box": [0, 0, 1, 1]}]', [(2, 0, 0, 1, 1)]),
    ('[{"object_id": 1, "box": [0, 0, 1]}, {"object_id": 1, "box": [2, 0, 1, 1]}, {"object_id": 1, "box": [0, null, 1, 1]}, {"object_id": 1}]', []),
    ('[{"object_id": 1, "box": ["' + "1_" * 9000 + '1", "0", "1' + "0" * 400 + '", "1._5"]}, {"object_id": 1, "box": ["1_0.5", "-.5e1", "Infinity", "1."]}]', [(1, 10.5, -5.0, float("inf"), 1.0)]),
    ('<think>[1]</think> [{"object_id": 1, "box": [0, false, true, 1]}]', [(1, 0, 0, 1, 1)]),
    ('[{"object_id": 3, "box": [0, 0, 1, 1]}]', []),
    (None, None),
]
JUDGED = [
    ('{"score": 3, "rationale": "ok"}', (3, "ok")),
    ('{"score": 3, "score": 5, "rationale": "last"}', (5, "last")),
    ("{'score': 3}", (None, "could not parse judge output: {'score': 3}")),
    ('{"score": 99999999999}', (None, "score out of range: 99999999999")),
    ('{"score": "4"}', (4, "")),
    ('{"score": "4.0"}', (None, 'could not parse judge output: {"score": "4.0"}')),
    ('{"score": 4.9}', (4, "")),
    ('{"score": 0}', (None, "score out of range: 0")),
    ('{"score": 3} {"score": 4}', (None, 'could not parse judge output: {"score": 3} {"score": 4}')),
    ('{"score": 3}}', (None, 'could not parse judge output: {"score": 3}}')),
    ("no json", (None, "could not parse judge output: no json")),
    ("[3]", (None, "could not parse judge output: [3]")),
]
POINTS = [
    ('<points coords="99999999999 500 500"/>', [(99999999999, 50.0, 100.0)]),
    ('<points coords="99999999999999999999 500 500; 2 100 100"/>', [(2, 10.0, 20.0)]),
    ('<points coords="1 1001 500; 3 1000 1000"/>', [(3, 100.0, 200.0)]),
]


def _of(spark, cases, column):
    """All cases in one table, so that a bad row would take the others along."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").repartition(2)
    return {r.i: r.v for r in df.select("i", column(F.col("t")).alias("v")).collect()}


def test_edges(spark):
    cases = [GOOD_EDGES, *EDGES]
    got = _of(spark, cases, T.edges)
    assert [[tuple(e) for e in got[i]] for i in range(len(cases))] == [want for _, want in cases]


def test_boxes(spark):
    got = _of(spark, BOXES, lambda c: T.boxes(c, F.array(F.lit(1), F.lit(2))))
    assert [[tuple(b) for b in got[i]] if got[i] else [] for i in range(len(BOXES))] == [want or [] for _, want in BOXES]


def test_judge(spark):
    got = _of(spark, JUDGED, T.judge)
    assert [tuple(got[i]) for i in range(len(JUDGED))] == [want for _, want in JUDGED]


def test_point_tags(spark):
    got = _of(spark, POINTS, lambda c: T.point_tags(c, F.lit(100.0), F.lit(200.0)))
    assert [[tuple(p) for p in got[i]] for i in range(len(POINTS))] == [want for _, want in POINTS]


DOCUMENTS = {
    "fine": ('<diagram><node i="n" b="0 0 1 1" conf="0.5"/></diagram>', None),
    "number": ('<diagram><node i="n" b="0 0 1 1" conf=" 1e-1 "/></diagram>', None),
    "conf": ('<diagram><node i="n" b="0 0 1 1" conf="abc"/></diagram>', "not a number"),
    "java": ('<diagram><arrow s="a" d="b" conf="1d"/></diagram>', "not a number"),
    "inner": ('<diagram><block i="b" b="0 0 9 9"><raster i="r" b="1 2 x 4"/></block></diagram>', "not a number"),
    "short": ('<diagram><node i="n" b="0 0 1"/></diagram>', "not a number"),
    "open": ("<diagram><node", "not XML"),
    "empty": ("", "not XML"),
    "crossed": ("<diagram><a></diagram>", "not XML"),
    "none": (None, None),
}


def test_bad_documents_are_reported_or_raise(spark):
    df = spark.createDataFrame([(k, x) for k, (x, _) in DOCUMENTS.items()], "image_id string, xml string")
    got = {r.image_id: r for r in files.parse_xml(df, strict=False).collect()}
    assert {k: r.problem for k, r in got.items()} == {k: p for k, (_, p) in DOCUMENTS.items()}
    assert got["fine"].nodes[0].conf == 0.5 and got["number"].nodes[0].conf == 0.1
    assert all(not (r.blocks or r.nodes or r.arrows) for r in got.values() if r.problem)
    for k, (_, problem) in DOCUMENTS.items():
        one = files.parse_xml(df.where(F.col("image_id") == k))
        if problem is None:
            assert "problem" not in one.columns and one.count() == 1 and len(one.collect()) == 1
        else:
            with pytest.raises(Exception, match=f"document {k}: {problem}"):
                one.collect()
