"""Rows that carry their error: a case with a fault is set aside, and the others go on."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stages of a run, in order.
STAGES = ("ingest", "trace", "navigate", "observe", "export")


def fault(rows: DataFrame, bad: Column, stage: str, message: Column, case: str = "case_id") -> DataFrame:
    """(case, stage, error) of each case with a bad row: the first of its messages in alphabetical order."""
    return rows.filter(bad).groupBy(case).agg(F.lit(stage).alias("stage"), F.min(message).alias("error"))


def together(found: Iterable[DataFrame], case: str = "case_id") -> DataFrame:
    """(case, stage, error) of the first stage in which each case failed."""
    each = reduce(DataFrame.unionByName, found)
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return each.groupBy(case).agg(F.min(F.struct(place.alias("place"), "stage", "error")).alias("f")).select(case, "f.stage", "f.error")


def set_aside(rows: DataFrame, found: DataFrame, case: str = "case_id") -> DataFrame:
    """Rows of cases without a fault."""
    return rows.join(found.select(case).distinct(), case, "left_anti")


def outcomes(cases: DataFrame, found: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, outcome, stage, error) of every case: completed, or failed with its first fault."""
    one = together([found], case)
    out = cases.select(case).distinct().join(one, case, "left")
    return out.select(case, F.when(F.col("stage").isNull(), "completed").otherwise("failed").alias("outcome"), "stage", "error")


def ingest_faults(cases: DataFrame, pixels: DataFrame, case: str = "case_id", sizes: tuple[str, str] = ("thumb_w", "thumb_h"), full: tuple[str, str] = ("full_w", "full_h")) -> DataFrame:
    """Faults of cases whose sizes are missing or not positive, that are named twice, or that have a pixel outside their image."""
    names = [*sizes, *full]
    size = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 1, F.lit(True)) for c in names])
    twice = cases.groupBy(case).agg(F.count("*").alias("n"))
    inside = lambda v, n: F.coalesce((F.col(v) >= 0) & (F.col(v) < F.col(n)), F.lit(False))
    placed = pixels.join(cases.select(case, *sizes), case)
    return reduce(DataFrame.unionByName, [
        fault(cases, size, "ingest", F.lit("no image size"), case), fault(twice, F.col("n") > 1, "ingest", F.lit("case is listed twice"), case),
        fault(placed.na.drop(subset=list(sizes)), ~(inside("x", sizes[0]) & inside("y", sizes[1])), "ingest", F.lit("pixel outside of the image"), case)])
