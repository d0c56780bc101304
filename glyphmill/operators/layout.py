"""Layout documents: diagrams of blocks, nodes, rasters and arrows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import joins

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
ITEM = f"struct<id:string,text:string,bbox:{BOX},mask:string,conf:double,src:string>"
ARROW = "struct<src_id:string,dst_id:string,conf:double,src:string>"
BLOCK = f"struct<id:string,text:string,bbox:{BOX},mask:string,conf:double,src:string,nodes:array<{ITEM}>,rasters:array<{ITEM}>,arrows:array<{ARROW}>>"
# Where detected items and discovered edges come from.
DETECTED, DISCOVERED = "sam", "som"
DIAGRAM = f"image_id string, blocks array<{BLOCK}>, nodes array<{ITEM}>, rasters array<{ITEM}>, arrows array<{ARROW}>"


def everything(top: Column, blocks: Column, part: str) -> Column:
    """Parts at the top, then those inside blocks, in order."""
    return F.concat(top, F.flatten(F.transform(blocks, lambda b: b[part])))


def markable(blocks: Column, nodes: Column) -> Column:
    """Ids that get marks: blocks, nodes at the top, nodes inside blocks."""
    ids = lambda a: F.transform(a, lambda x: x["id"])
    return F.concat(ids(blocks), ids(nodes), F.flatten(F.transform(blocks, lambda b: ids(b["nodes"]))))


def assemble(items: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Diagrams from detected items (image_id, ord, id, text, box, mask, conf, is_raster).

    Items that others contain go to their owner if that is at the top; items
    whose owner is contained too are dropped, as ``joins.classify`` reports.
    Rasters go to the first block that contains them.
    """
    item = F.struct("id", "text", F.col("box").alias("bbox"), "mask", "conf", F.lit(DETECTED).alias("src")).cast(ITEM)
    cells = joins.layout_grid(items.select("image_id", "box"), tolerance)
    owned = joins.owned(items.where(~F.col("is_raster")).select("image_id", "ord", "box", item.alias("i")), "i", tolerance, cells)
    # what an item owns meets it under its number; where it is owned itself it isn't there
    alone = F.col("owner").isNull()
    groups = owned.groupBy("image_id", F.coalesce("owner", "ord").alias("ord")).agg(F.first(F.when(alone, F.col("i")), ignorenulls=True).alias("top"), _in_order(F.col("i"), ~alone).alias("kids"))
    none_a = F.array().cast(f"array<{ARROW}>")
    is_block = F.col("top").isNotNull() & (F.size("kids") > 0)
    block = lambda pictures: F.struct("top.*", F.col("kids").alias("nodes"), pictures.alias("rasters"), none_a.alias("arrows")).cast(BLOCK)
    rasters, pictures, no = items.where("is_raster"), F.array().cast(f"array<{ITEM}>"), lambda kind: F.lit(None).cast(kind)
    loose = None
    if not rasters.isEmpty():
        blocks = groups.where(is_block).select("image_id", "ord", F.col("top.bbox").alias("box"))
        owner = joins.raster_owners(rasters.select("image_id", "ord", "box"), blocks, tolerance, cells)
        with_owner = rasters.select("image_id", "ord", item.alias("i")).join(owner, ["image_id", "ord"])
        inside = F.col("block_ord").isNotNull()
        held = with_owner.where(inside).groupBy("image_id", F.col("block_ord").alias("ord")).agg(_in_order(F.col("i"), F.lit(True)).alias("pictures"))
        groups, pictures = groups.join(held, ["image_id", "ord"], "left"), F.coalesce("pictures", pictures)
        loose = with_owner.select("image_id", "ord", no(BLOCK).alias("block"), no(ITEM).alias("node"), F.when(~inside, F.col("i")).alias("raster"))
    rows = groups.select("image_id", "ord", F.when(is_block, block(pictures)).alias("block"), F.when(~is_block, F.col("top")).alias("node"), no(ITEM).alias("raster"))
    rows = rows if loose is None else rows.unionByName(loose)
    return rows.groupBy("image_id").agg(*[_in_order(F.col(c), F.col(c).isNotNull()).alias(f"{c}s") for c in ("block", "node", "raster")]).select("image_id", "blocks", "nodes", "rasters", none_a.alias("arrows"))


def _in_order(what: Column, where: Column) -> Column:
    """A group's values in the order of ``ord``, of the rows that are meant."""
    return F.sort_array(F.collect_list(F.when(where, F.struct("ord", what.alias("i")))))["i"]


def mark_edges(marks: Column, found: Column) -> Column:
    """Arrows between the ids that marks stand for, from pairs (src, dst) of mark numbers; unknown marks and loops are skipped."""
    n = F.size(marks)
    good = F.filter(found, lambda e: e["src"].between(0, n - 1) & e["dst"].between(0, n - 1) & (e["src"] != e["dst"]))
    return F.transform(good, lambda e: F.struct(F.get(marks, e["src"]).alias("src_id"), F.get(marks, e["dst"]).alias("dst_id"), F.lit(None).cast("double").alias("conf"), F.lit(DISCOVERED).alias("src")))
