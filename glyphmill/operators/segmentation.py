"""Classical segmentation of images as an operator: images and seed points in, boxes and masks out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import images, masks, png
from glyphmill.sources import files

RESULT = "image_id string, id string, x int, y int, w int, h int, source string, iou double, rle string, png binary"


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder (image_id, height, width, channels, data), decoded by Spark; channels are in the order blue, green, red, alpha.  Broken files are left out."""
    read = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    name = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\.[^.]*$", "")
    return read.select(name.alias("image_id"), "height", "width", F.col("nChannels").alias("channels"), "data")


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seed points (image_id, id, x, y) of JSON files, each a list of {id, x, y}; coordinates lose their fractions."""
    text = spark.read.option("wholetext", "true").text(f"{folder}/*.json").select("value", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "").alias("image_id"))
    listed = text.select("image_id", F.inline(F.from_json("value", "array<struct<id:string,x:double,y:double>>")))
    return listed.select("image_id", "id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def segment(pictures: DataFrame, points: DataFrame, min_area: int = images.MIN_AREA, max_share: float = images.MAX_SHARE) -> DataFrame:
    """A row for each point: its box (x, y, w, h), source flood, contour or needs_review, overlap with the rectangle around it, and its mask as run lengths and as a PNG.

    An image's points, which a person or a model placed, travel with it; a task
    holds one image at a time.  Points of unknown images are left out, and
    points outside their image are errors.
    """
    by_image = points.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("points"))
    whole = pictures.join(by_image, "image_id").select("image_id", "height", "width", "channels", "data", "points")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                outside = [p["id"] for p in r.points if not (0 <= p["x"] < r.width and 0 <= p["y"] < r.height)]
                if outside:
                    raise ValueError(f"points outside {r.image_id}: {outside}")
                grey = images.normalise(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels), "BGR")
                found = images.reconcile(grey, [(p["id"], p["x"], p["y"]) for p in r.points], min_area, max_share)
                rows = [(r.image_id, f["id"], *(f["box"] or (None,) * 4), f["source"], f["iou"], None if f["mask"] is None else masks.to_text(masks.encode(f["mask"])), None if f["mask"] is None else png.encode(f["mask"])) for f in found]
                out = pd.DataFrame(rows, columns=["image_id", "id", "x", "y", "w", "h", "source", "iou", "rle", "png"])
                yield out.astype({c: "Int32" for c in ("x", "y", "w", "h")})

    return whole.mapInPandas(run, RESULT)


def boxes_json(found: DataFrame) -> DataFrame:
    """(image_id, boxes): a JSON object of each image's boxes [x, y, w, h] by id; unresolved points are left out."""
    entry = F.struct("id", F.array("x", "y", "w", "h").alias("box"))
    return found.where(F.col("x").isNotNull()).groupBy("image_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("boxes"))


def write_outputs(found: DataFrame, folder: str) -> None:
    """Masks as ``masks/<image>/<id>.png`` and each image's boxes as ``<image>.json`` below a shared folder."""
    files.write_each(found.where(F.col("png").isNotNull()).select(F.concat(F.lit("masks/"), "image_id", F.lit("/"), "id", F.lit(".png")).alias("path"), F.col("png").alias("content")), folder)
    files.write_each(boxes_json(found).select(F.concat("image_id", F.lit(".json")).alias("path"), F.encode("boxes", "utf-8").alias("content")), folder)
