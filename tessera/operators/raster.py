"""Pixels to grid cells, crops and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..settings import Settings


def cell_of(v: Column, size: Column, grid: int) -> Column:
    """Grid cell of a coordinate: cells of ceil(size / grid), one at least."""
    return F.floor(v / F.greatest(F.lit(1), F.ceil(size / F.lit(float(grid))))).cast("int")


def grid_cells(pixel: DataFrame, settings: Settings, case: str = "case_id") -> DataFrame:
    """(case, gy, gx, n, tissue, pale, artifact) of pixels (case, gy, gx, r, g, b); inactive cells go.

    Partial sums are taken before the shuffle, so a case with many pixels is no hot spot.
    """
    rgb = [F.col(c) for c in "rgb"]
    cells = pixel.groupBy(case, "gy", "gx").agg(
        F.count("*").alias("n"),
        F.count_if(pixels.tissue(*rgb)).alias("__t"),
        pixels.share(pixels.tissue(*rgb)).alias("tissue"),
        pixels.share(pixels.pale(*rgb)).alias("pale"),
        pixels.share(pixels.artifact(*rgb)).alias("artifact"),
    )
    # the unrounded share decides
    return cells.filter(F.col("__t") * 10000 >= F.col("n") * settings.min_cell_tissue).drop("__t")


def crop_statistics(pixel: DataFrame, *keys: str) -> DataFrame:
    """Background, tissue and pale shares of each crop."""
    rgb = [F.col(c) for c in "rgb"]
    return pixel.groupBy(*keys).agg(
        pixels.share(pixels.background(*rgb)).alias("background"),
        pixels.share(pixels.tissue(*rgb)).alias("tissue"),
        pixels.share(pixels.pale(*rgb)).alias("pale"),
    )


#: Side of the tiles in which pixels and windows meet.
TILE = 512


def crop_window(pixel: DataFrame, steps: DataFrame, case: str = "case_id", tile: int = TILE) -> DataFrame:
    """Pixels of each step's window [x - half, x + half) x [y - half, y + half).

    A pixel lies in one tile, a window in a few: they meet by case and tile, and no pair comes twice.
    """
    half = F.floor(F.col("size") / 2)
    inside = ((F.col("px") >= F.col("x") - half) & (F.col("px") < F.col("x") + half)
              & (F.col("py") >= F.col("y") - half) & (F.col("py") < F.col("y") + half))
    at = lambda v: F.floor(v / tile).cast("int")
    span = lambda c: F.explode(F.sequence(at(F.col(c) - half), at(F.col(c) + half - 1)))
    windows = steps.filter(half > 0).withColumn("__tx", span("x")).withColumn("__ty", span("y"))
    placed = pixel.withColumn("__tx", at(F.col("px"))).withColumn("__ty", at(F.col("py")))
    return windows.join(placed, [case, "__tx", "__ty"]).filter(inside).drop("__tx", "__ty")


def tiles(boxes: DataFrame, size: int = 256, keep: int | None = None, keys: tuple[str, ...] = ("case_id",), order: tuple[str, ...] = ()) -> DataFrame:
    """Whole tiles (tx, ty) of each box (x1, y1, x2, y2), row by row; ``keep`` of each key at most."""
    steps = lambda a, b: F.when(F.col(b) - F.col(a) >= size, F.sequence(F.col(a), F.col(b) - size, F.lit(size)))
    out = boxes.withColumn("ty", F.explode(steps("y1", "y2"))).withColumn("tx", F.explode(steps("x1", "x2")))
    if keep is None:
        return out
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "ty", "tx"))
    return out.withColumn("tile", rank - 1).filter(F.col("tile") < keep)
