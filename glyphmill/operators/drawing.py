"""Overlays as rows of draw instructions, ranks of painted masks, and prompts of a mask dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import geometry as G
from glyphmill.functions import masks


def overlay(items: DataFrame, name: Column) -> DataFrame:
    """Two instructions for each box, its outline and its name at the centre, in one colour for each item: (image_id, ord, kind, x0, y0, x1, y1, text, hue)."""
    w = Window.partitionBy("image_id")
    hue = G.hue(F.row_number().over(w.orderBy("ord")) - 1, F.count(F.lit(1)).over(w))
    b, c = F.col("box"), G.centre(F.col("box"))
    outline = F.struct(F.lit("box").alias("kind"), *[b[s].alias(s) for s in G.SIDES], F.lit("").alias("text"))
    label = F.struct(F.lit("text").alias("kind"), c["x"].alias("x0"), c["y"].alias("y0"), c["x"].alias("x1"), c["y"].alias("y1"), name.alias("text"))
    # the window comes first: a generator in the same projection would run below it
    coloured = items.withColumn("hue", hue)
    return coloured.select("image_id", "ord", "hue", F.explode(F.array(outline, label)).alias("d")).select("image_id", "ord", "d.*", "hue")


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A line from centre to centre for each edge (image_id, src_id, dst_id) between known nodes (image_id, id, box)."""
    end = lambda p: nodes.select("image_id", F.col("id").alias(f"{p}_id"), G.centre(F.col("box")).alias(p))
    return edges.join(end("src"), ["image_id", "src_id"]).join(end("dst"), ["image_id", "dst_id"]).select("image_id", "src_id", "dst_id", F.col("src.x").alias("x0"), F.col("src.y").alias("y0"), F.col("dst.x").alias("x1"), F.col("dst.y").alias("y1"))


def label_ranks(instances: DataFrame, shown: Column) -> DataFrame:
    """1-based ranks, in order, of the instances of an image that are painted; others take no rank."""
    return instances.where(shown).withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy("ord")))


def prompts(instances: DataFrame) -> DataFrame:
    """The first positive point of each instance, by point order: (image_id, ord, x, y)."""
    return instances.where(F.col("label") == 1).groupBy("image_id", "ord").agg(F.min_by(F.struct("x", "y"), "point_ord").alias("p")).select("image_id", "ord", "p.x", "p.y")


def label_raster(instances: DataFrame) -> DataFrame:
    """What is seen of each mask (image_id, ord, mask) where an image's masks are painted in order, later ones on top: (image_id, ord, rank, seen).

    Masks of an image are of the size of its first one; others take no rank.
    The runs of an image's masks are folded from the top down, so what a mask
    shows is what those above it leave.
    """
    size = F.struct("mask.h", "mask.w")
    first = F.first(size).over(Window.partitionBy("image_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    ranked = label_ranks(instances.withColumn("same", size == first).where("same"), F.lit(True))
    entry = F.struct((-F.col("rank")).alias("down"), "rank", "ord", "mask")
    stacked = ranked.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    kind = "struct<h:int,w:int,counts:array<int>>"
    ord_type = instances.schema["ord"].dataType.simpleString()
    seen = f"array<struct<rank:int,ord:{ord_type},seen:{kind}>>"
    top = F.get("all", F.lit(0))["mask"]
    bare = F.struct(top["h"].alias("h"), top["w"].alias("w"), F.array(top["h"] * top["w"]).alias("counts")).cast(kind)
    step = lambda acc, e: F.struct(masks.union(acc["covered"], e["mask"]).cast(kind).alias("covered"), F.concat(acc["out"], F.array(F.struct(e["rank"].alias("rank"), e["ord"].alias("ord"), masks.difference(e["mask"], acc["covered"]).cast(kind).alias("seen")))).cast(seen).alias("out"))
    done = F.aggregate("all", F.struct(bare.alias("covered"), F.array().cast(seen).alias("out")), step)
    return stacked.select("image_id", F.inline(done["out"])).select("image_id", "ord", "rank", "seen")
