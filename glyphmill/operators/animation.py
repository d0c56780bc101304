"""Animation schedules: what each frame shows of each element, in four styles.

Steps are rows (diagram, step, element and, for boxes, its corners); schedules
have a row for each frame and element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the styles.
DIMMED = 0.15
FRAMES_A_SLIDE = 4
SLIDE_FPS = 3


def _framed(steps: DataFrame, first: int, extra: int) -> DataFrame:
    """Every element at every frame from ``first`` to the last step and ``extra`` beyond."""
    last = F.max("step").over(Window.partitionBy("diagram"))
    return steps.withColumn("last", last).withColumn("frame", F.explode(F.sequence(F.lit(first).cast("long"), (F.col("last") + extra).cast("long"))))


def reveal(steps: DataFrame) -> DataFrame:
    """Elements appear at their step and stay."""
    return _framed(steps, 0, 0).select("diagram", "frame", "element", F.when(F.col("frame") >= F.col("step"), 1.0).otherwise(0.0).alias("opacity"))


def alpha(steps: DataFrame) -> DataFrame:
    """Elements are bright in their own steps (step to ``until``, if there is one) and in the final frame, else dimmed."""
    until = F.col("until") if "until" in steps.columns else F.col("step")
    bright = F.col("frame").between(F.col("step"), until) | (F.col("frame") == F.col("last") + 1)
    return _framed(steps, 0, 1).select("diagram", "frame", "element", F.when(bright, 1.0).otherwise(DIMMED).alias("opacity"))


def hop(steps: DataFrame) -> DataFrame:
    """A box stands on element k in frame k."""
    return steps.select("diagram", F.col("step").alias("frame"), "element", "x0", "y0", "x1", "y1")


def slide(steps: DataFrame) -> DataFrame:
    """A box moves from each element to the next in ``FRAMES_A_SLIDE`` frames, in straight lines, and rests on the last."""
    w = Window.partitionBy("diagram").orderBy("step")
    sides = ("x0", "y0", "x1", "y1")
    moved = steps.withColumns({f"to_{s}": F.lead(s).over(w) for s in sides} | {"k": F.row_number().over(w) - 1})
    n = F.when(F.col("to_x0").isNull(), F.lit(0)).otherwise(FRAMES_A_SLIDE - 1)
    at = moved.withColumn("j", F.explode(F.sequence(F.lit(0), n)))
    part = F.col("j") / FRAMES_A_SLIDE
    return at.select("diagram", (F.col("k") * FRAMES_A_SLIDE + F.col("j")).alias("frame"), *[(F.col(s) + (F.coalesce(f"to_{s}", s) - F.col(s)) * part).alias(s) for s in sides])
