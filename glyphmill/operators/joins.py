"""Joins of layout items, points, samples and stages.

Every geometric join has image and cell as equality keys, so Catalyst plans a
hash or sort-merge join with the geometry as a residual condition, and an image of
any number of boxes is spread over tasks; picks are ``min_by`` aggregates, which
combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.operators.grid import CELL, Grid, grid
from glyphmill.sources.scratch import stored

#: Overlaps that one pass in tasks of whole images decides; more are decided in rounds first.
AT_ONCE = 1_000_000


def _sides(df: DataFrame, margin: float = 0.0) -> DataFrame:
    """(image_id, x0, y0, x1, y1) of boxes with a margin, for a grid."""
    return df.select("image_id", *[(F.col("box")[n] + (margin if n[1] == "1" else -margin)).alias(n) for n in G.SIDES])


def _spread(g: Grid, df: DataFrame, box: str = "box", margin: float = 0.0) -> DataFrame:
    """A row for each cell that a box with a margin covers."""
    b = F.col(box)
    return g.over(df, b["x0"] - margin, b["y0"] - margin, b["x1"] + margin, b["y1"] + margin)


def area_rank(items: DataFrame, image: str = "image_id", order: str = "ord") -> DataFrame:
    """Rank by area, largest first, in input order on ties."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy(F.desc(G.area(F.col("box"))), order)))


def layout_grid(items: DataFrame, tolerance: float = 1.0) -> Grid:
    """The grid for boxes that meet within a tolerance; one serves all joins of the same items, or of parts of them."""
    return grid(_sides(items, tolerance))


def claims(items: DataFrame, tolerance: float = 1.0, cells: Grid | None = None) -> DataFrame:
    """Who contains whom: a row (image_id, ord, owner) for each item that some other item contains.

    An item is claimed once, by the container that comes first by area, in
    input order on ties.  Two boxes that contain each other within the
    tolerance claim each other.
    """
    plain = items.select("image_id", "ord", "box")
    g = cells or layout_grid(plain, tolerance)
    outer = _spread(g, plain.select("image_id", F.col("ord").alias("owner"), F.col("box").alias("outer")), "outer", tolerance)
    # what holds an item holds its lower corner
    inner = g.at(plain, F.col("box")["x0"], F.col("box")["y0"])
    pairs = inner.join(outer, CELL).where((F.col("owner") != F.col("ord")) & G.contains(F.col("outer"), F.col("box"), tolerance))
    return pairs.groupBy("image_id", "ord").agg(F.min_by("owner", F.struct(-G.area(F.col("outer")), "owner")).alias("owner"))


def owned(items: DataFrame, what: str, tolerance: float = 1.0, cells: Grid | None = None) -> DataFrame:
    """Each item (image_id, ord, ``what``) with the owner that ``claims`` has for it, or null."""
    g = cells or layout_grid(items, tolerance)
    its = [f"its_{c}" for c in CELL]
    outer = _spread(g, items.select("image_id", F.col("ord").alias("owner"), F.col("box").alias("outer")), "outer", tolerance)
    outer = outer.select(*[F.col(c).alias(n) for c, n in zip(CELL, its)], "owner", "outer")
    inner = g.at(items.select("image_id", "ord", "box", what), F.col("box")["x0"], F.col("box")["y0"])
    meets = (F.col("owner") != F.col("ord")) & G.contains(F.col("outer"), F.col("box"), tolerance)
    for c, n in zip(CELL, its):
        meets = meets & (F.col(c) == F.col(n))
    first = F.min_by("owner", F.struct(-G.area(F.col("outer")), "owner"))
    return inner.join(outer, meets, "left").groupBy("image_id", "ord").agg(F.first(what).alias(what), first.alias("owner"))


def classify(items: DataFrame, tolerance: float = 1.0, cells: Grid | None = None) -> DataFrame:
    """Role of each item: block (unclaimed with children), node (unclaimed without), child, or dropped (its owner is claimed too)."""
    # claims are made once and told to both sides: an item hears who owns it and whether it owns; then owned ones ask whether their owner is owned
    claim = claims(items, tolerance, cells)
    no = F.lit(None).cast(claim.schema["owner"].dataType)
    told = items.select("image_id", "ord", no.alias("owner"), F.lit(True).alias("real"), F.lit(False).alias("owns"))
    told = told.unionAll(claim.select("image_id", "ord", "owner", F.lit(False), F.lit(False))).unionAll(claim.select("image_id", F.col("owner").alias("ord"), no, F.lit(False), F.lit(True)))
    known = told.groupBy("image_id", "ord").agg(F.max("owner").alias("owner"), F.max("owns").alias("owns"), F.max("real").alias("real")).where("real")
    claimed = claim.select("image_id", F.col("ord").alias("owner"), F.lit(True).alias("owner_claimed"))
    role = F.when(F.col("owner").isNull(), F.when(F.col("owns"), "block").otherwise("node")).when(F.col("owner_claimed"), "dropped").otherwise("child")
    return known.join(claimed, ["image_id", "owner"], "left").select("image_id", "ord", "owner", role.alias("role"))


def raster_owners(rasters: DataFrame, blocks: DataFrame, tolerance: float = 1.0, cells: Grid | None = None) -> DataFrame:
    """The first block in block order that contains each raster: (image_id, ord, block_ord), null if none does."""
    g = cells or grid(_sides(rasters), _sides(blocks, tolerance))
    b = _spread(g, blocks.select("image_id", F.col("ord").alias("block_ord"), F.col("box").alias("outer")), "outer", tolerance)
    r = g.at(rasters.select("image_id", "ord", "box"), F.col("box")["x0"], F.col("box")["y0"])
    found = r.join(b, CELL).where(G.contains(F.col("outer"), F.col("box"), tolerance)).groupBy("image_id", "ord").agg(F.min("block_ord").alias("block_ord"))
    return rasters.select("image_id", "ord").join(found, ["image_id", "ord"], "left")


def _points(df: DataFrame, x: str = "x", y: str = "y", margin: float = 0.0) -> DataFrame:
    """(image_id, x0, y0, x1, y1) of points with a margin, for a grid."""
    return df.select("image_id", *[(F.col(c).cast("double") + m).alias(n) for n, c, m in zip(G.SIDES, (x, y, x, y), (-margin, -margin, margin, margin))])


def smallest_container(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The smallest box around each point, the first on ties: (image_id, point_ord, box_ord)."""
    g = grid(_points(points), _sides(boxes))
    around = _spread(g, boxes.select("image_id", F.col("ord").alias("box_ord"), "box"))
    found = g.at(points, F.col("x"), F.col("y")).join(around, CELL).where(G.holds_point(F.col("box"), F.col("x"), F.col("y")))
    return found.groupBy("image_id", "point_ord").agg(F.min_by("box_ord", F.struct(G.area(F.col("box")), "box_ord")).alias("box_ord"))


def nearest_point(clicks: DataFrame, points: DataFrame, radius: float = 10.0) -> DataFrame:
    """The nearest point within the radius of each click, the earliest on ties."""
    d = G.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    g = grid(_points(clicks, margin=radius), _points(points, "px", "py"))
    reach = g.over(clicks, F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius)
    near = reach.join(g.at(points, F.col("px"), F.col("py")), CELL).withColumn("d", d).where(F.col("d") <= radius)
    return near.groupBy("image_id", "click_ord").agg(F.min_by(F.struct("point_ord", "d"), F.struct("d", "point_ord")).alias("hit")).select("image_id", "click_ord", "hit.point_ord", F.col("hit.d").alias("distance"))


def iou_pairs(items: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of an image with more than ``least`` overlap: (image_id, a, b, iou)."""
    return _overlapping(items.select("image_id", "ord", "box"), least).select("image_id", "a", "b", "iou")


def _overlapping(items: DataFrame, least: float) -> DataFrame:
    """Pairs (image_id, a, b, p, q, iou) of boxes in input order, each from the one cell that holds the lower corner of what they share."""
    g = grid(_sides(items))
    cells = _spread(g, items)
    left, right = cells.select(*CELL, F.col("ord").alias("a"), F.col("box").alias("p")), cells.select(*CELL, F.col("ord").alias("b"), F.col("box").alias("q"))
    pairs = left.join(right, CELL).where(F.col("a") < F.col("b")).withColumn("iou", G.iou(F.col("p"), F.col("q"))).where(F.col("iou") > least)
    corner = [F.greatest(F.col("p")[n], F.col("q")[n]) for n in ("x0", "y0")]
    return g.meeting(pairs).where(g.owns(*corner)).select("image_id", "a", "b", "p", "q", "iou")


def suppress(items: DataFrame, limit: float = 0.9, at_once: int | None = None) -> DataFrame:
    """Greedy suppression: boxes by area, largest first, in input order on ties; one is kept if its overlap with all kept ones is within the limit.

    In rounds, each of joins on (image, box): a box that comes first among its
    undecided overlaps is kept, and what it overlaps goes; that is what the
    greedy order decides.  Overlaps that are ``at_once`` or fewer are decided
    in one pass over each image's overlaps in that order.  Boxes in an order
    of random areas take some ten rounds; a chain of n boxes that each overlap
    the next takes n / 2.
    """
    at_once = AT_ONCE if at_once is None else at_once
    place = lambda box, ord_: F.struct((-G.area(F.col(box))).alias("key"), F.col(ord_).alias("ord"))
    pairs = _overlapping(items.select("image_id", "ord", "box"), limit).select("image_id", place("p", "a").alias("a"), place("q", "b").alias("b"))
    edges = stored(pairs.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "overlaps")
    gone: list[DataFrame] = []
    while (n := edges.count()) > at_once:
        first = edges.select("image_id", "a").join(edges.select("image_id", F.col("b").alias("a")), ["image_id", "a"], "left_anti").distinct()
        out = stored(edges.join(first, ["image_id", "a"], "left_semi").select("image_id", F.col("b").alias("o")).distinct(), "suppressed")
        left = edges.join(out.withColumnRenamed("o", "a"), ["image_id", "a"], "left_anti").join(out.withColumnRenamed("o", "b"), ["image_id", "b"], "left_anti")
        edges = stored(left.select("image_id", "a", "b"), "overlaps")
        gone.append(out.select("image_id", F.col("o.ord").alias("ord")))
    if n:
        gone.append(_greedy(edges, items.schema["ord"].dataType.simpleString()))
    kept = items.select("image_id", "ord")
    for out in gone:
        kept = kept.join(out, ["image_id", "ord"], "left_anti")
    return kept


def _greedy(edges: DataFrame, ord_type: str) -> DataFrame:
    """The boxes (image_id, ord) that go, from a bounded number of overlaps (image_id, a, b), read in the order of ``a``."""
    kind = edges.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, out = None, set()
        for batch in batches:
            rows: list[tuple] = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if i != image:
                    image, out = i, set()
                if a not in out and b not in out:
                    out.add(b)
                    rows.append((i, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.types[0]), pa.array([r[1] for r in rows], batch.schema.types[1])], ["image_id", "ord"])

    ordered = edges.repartition("image_id").sortWithinPartitions("image_id", "a", "b").select("image_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))
    return ordered.mapInArrow(run, f"image_id {kind}, ord {ord_type}")


def duplicate_boxes(items: DataFrame) -> DataFrame:
    """Items that share their exact box with another item of the image; all are kept and reported."""
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id", "box"))
    return items.withColumn("n_same", n).where(F.col("n_same") > 1)


def resolve_edges(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges between marks as edges between nodes; unknown ends and loops fall out, repeats stay."""
    src, dst = marks.select("image_id", F.col("mark_id").alias("src"), F.col("node_id").alias("src_id")), marks.select("image_id", F.col("mark_id").alias("dst"), F.col("node_id").alias("dst_id"))
    return edges.join(src, ["image_id", "src"]).join(dst, ["image_id", "dst"]).where(F.col("src_id") != F.col("dst_id"))


def find_id(wanted: DataFrame, *kinds: DataFrame) -> DataFrame:
    """The first kind that has an id: rows (image_id, id, kind) for tables (image_id, id) in order of precedence."""
    all_ = None
    for k, df in enumerate(kinds):
        part = df.select("image_id", "id", F.lit(k).alias("kind"))
        all_ = part if all_ is None else all_.unionByName(part)
    return wanted.join(all_.groupBy("image_id", "id").agg(F.min("kind").alias("kind")), ["image_id", "id"], "left")


def with_status(samples: DataFrame, annotations: DataFrame, key: str, default: str = "pending") -> DataFrame:
    """Samples with their annotation's status, ``default`` where there is none."""
    return samples.join(annotations, key, "left").withColumn("status", F.coalesce("status", F.lit(default)))


def overridden(samples: DataFrame, annotations: DataFrame, key: str, column: str) -> DataFrame:
    """Samples with the annotation's text where there is one."""
    other = annotations.select(key, F.col(column).alias("__new"))
    return samples.join(other, key, "left").withColumn("overridden", F.col("__new").isNotNull()).withColumn(column, F.coalesce("__new", column)).drop("__new")


def pick_variant(stage: DataFrame, key: str, variant: str, payload: str) -> DataFrame:
    """Of the variants of a stage's output, the first by name."""
    return stage.groupBy(key).agg(F.min_by(payload, variant).alias(payload), F.min(variant).alias(variant))


def skip_existing(candidates: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Candidates that are not done yet."""
    return candidates if force else candidates.join(done.select(key), key, "left_anti")


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def render_misses(sources: DataFrame, cache: DataFrame, digest: Column, key: str = "digest") -> DataFrame:
    """One row for each distinct source that the render cache doesn't hold."""
    return sources.withColumn(key, digest).dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def with_instances(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Manifest rows (image_id, instance_id) with the mask that the image's record holds for the instance, null where it holds none."""
    held = records.select(F.col("image.id").alias("image_id"), F.explode("instances").alias("i")).select("image_id", F.col("i.id").alias("instance_id"), F.col("i.mask_rle").alias("mask_rle"), F.col("i.state").alias("state"))
    return manifest.join(held, ["image_id", "instance_id"], "left")


def of_stages(points: DataFrame, masks: DataFrame, diagrams: DataFrame) -> DataFrame:
    """What the stages made of each sample: points with their masks, of images that have a diagram."""
    return points.join(masks, ["image_id", "object_id"]).join(diagrams, "image_id")
