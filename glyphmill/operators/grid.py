"""Joins of boxes and points of an image through a grid of cells.

An image of few boxes is one cell.  One of many has square cells of a size that
follows from its counted boxes: at least their mean width, height and root of
their mean area, so that all boxes together cover at most four times as many cells
as there are boxes, and at least the share of the image's extent that leaves about
a box to a cell where they lie evenly.  Sides meet on image and cell, so one
image's boxes are spread over tasks, and only neighbours are compared.

Boxes have their corners in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boxes of an image that one cell holds at most, and images that have a grid at most: their sizes are broadcast.
DENSE, MOST = 10_000, 100_000
CELL = ["image_id", "cell_x", "cell_y"]


@dataclass
class Grid:
    """Cells of the images of some tables; ``sizes`` is None where no image can be dense."""

    sizes: DataFrame | None

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.sizes), "image_id", "left")

    @staticmethod
    def _cell(value: Column, origin: str) -> Column:
        return F.coalesce(F.floor((value - F.col(origin)) / F.col("cell_side")), F.lit(0)).cast("int")

    def at(self, df: DataFrame, x: Column, y: Column) -> DataFrame:
        """Rows with the cell of a point."""
        if self.sizes is None:
            return df.withColumns({c: F.lit(0) for c in CELL[1:]})
        return self._placed(df).withColumns({"cell_x": self._cell(x, "cell_x0"), "cell_y": self._cell(y, "cell_y0")}).drop("cell_x0", "cell_y0", "cell_side")

    def over(self, df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
        """A row for each cell that a box covers."""
        if self.sizes is None:
            return df.withColumns({c: F.lit(0) for c in CELL[1:]})
        across = self._placed(df).withColumn("cell_x", F.explode(F.sequence(self._cell(x0, "cell_x0"), F.greatest(self._cell(x0, "cell_x0"), self._cell(x1, "cell_x0")))))
        down = across.withColumn("cell_y", F.explode(F.sequence(self._cell(y0, "cell_y0"), F.greatest(self._cell(y0, "cell_y0"), self._cell(y1, "cell_y0")))))
        return down.drop("cell_x0", "cell_y0", "cell_side")

    def owns(self, x: Column, y: Column) -> Column:
        """Whether a row's cell holds a point: of all cells where a pair meets, one holds the lower corner of what it shares.  For rows that kept their grid, as ``meeting`` gives them."""
        return F.lit(True) if self.sizes is None else (self._cell(x, "cell_x0") == F.col("cell_x")) & (self._cell(y, "cell_y0") == F.col("cell_y"))

    def meeting(self, df: DataFrame) -> DataFrame:
        """Pairs with their image's grid, for ``owns``."""
        return df if self.sizes is None else self._placed(df)


def grid(*boxes: DataFrame, dense: int | None = None, most: int = MOST) -> Grid:
    """The grid of tables (image_id, x0, y0, x1, y1) that are to meet.

    An image has cells if it holds more boxes than ``dense`` and than one in
    ``most`` of all, so ``most`` images have at most.
    """
    dense = DENSE if dense is None else dense
    total = sum(b.count() for b in boxes)
    if total <= dense:
        return Grid(None)
    all_ = boxes[0]
    for b in boxes[1:]:
        all_ = all_.unionAll(b)
    limit = max(dense, total // most)
    if all_.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= limit:
        # no image has cells, so images meet as they were dealt out, without a broadcast
        return Grid(None)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    by = all_.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x0").alias("cell_x0"), F.min("y0").alias("cell_y0"),
        F.greatest(F.avg(w), F.avg(h), F.sqrt(F.greatest(F.avg(w * h), F.lit(0.0))), F.sqrt((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0")) / F.count(F.lit(1)))).alias("cell_side"),
    )
    sizes = by.where((F.col("n") > limit) & (F.col("cell_side") > 0)).drop("n")
    return Grid(sizes)
