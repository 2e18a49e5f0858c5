"""Active cells to scored regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.pixels import ten_thousandths
from ..settings import Settings
from . import faults


def _flood(cells: pd.DataFrame, grid: int, case: str) -> pd.DataFrame:
    """Spread the least place of the neighbourhood, in all cases at once, until nothing moves; number the places that are left."""
    k, none = pd.factorize(cells[case])[0], grid * grid
    y, x = cells["gy"].to_numpy(), cells["gx"].to_numpy()
    root = np.full((k.max() + 1, grid + 2, grid + 2), none)
    root[k, y + 1, x + 1] = y * grid + x
    on = root < none
    while True:
        least = root.copy()
        least[:, 1:-1, 1:-1] = np.minimum.reduce([root[:, dy:dy + grid, dx:dx + grid] for dy in range(3) for dx in range(3)])
        least[~on] = none
        if (least == root).all():
            break
        root = least
    own = root[k, y + 1, x + 1]
    found, at = np.unique(k * none + own, return_inverse=True)
    first = np.searchsorted(found // none, np.arange(k.max() + 1))
    return cells.assign(root=own.astype("int32"), component=(at - first[k]).astype("int32"))


def connected(cells: DataFrame, settings: Settings, case: str = "case_id") -> DataFrame:
    """Active cells with root and component: eight neighbours, numbered by their first cell row by row.

    A case has grid x grid cells at most; a partition's cases come in order, batch by batch.
    """
    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            last = held[case] == held[case].iloc[-1]
            if not last.all():
                yield _flood(held[~last].reset_index(drop=True), settings.grid, case)
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield _flood(held, settings.grid, case)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields) + ", root int, component int"
    return cells.repartition(case).sortWithinPartitions(case).mapInPandas(run, schema)


def unknown_answers(proposals: DataFrame, answers: DataFrame, case: str = "case_id") -> DataFrame:
    """Faults of answers whose cluster_id is no proposal of their case."""
    left = answers.join(proposals.select(case, "cluster_id"), [case, "cluster_id"], "left_anti")
    return faults.fault(left, F.lit(True), "trace", F.concat(F.lit("no proposal "), F.coalesce("cluster_id", F.lit("None"))), case)


def annotated(proposals: DataFrame, answers: DataFrame, case: str = "case_id", strict: bool = True) -> DataFrame:
    """Answers of a provider (case, cluster_id, ...) with their proposal; a proposal without an answer goes.

    An unknown id is an error; without ``strict`` it is left out (:func:`unknown_answers` finds it).
    """
    known = proposals.select(case, "cluster_id", *geo.SIDES, "cell_count").withColumn("__known", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("no proposal "), F.col("cluster_id"))).cast("string")
    out = answers.join(known, [case, "cluster_id"], "left" if strict else "inner")
    return out.withColumn("cluster_id", F.when(F.col("__known"), F.col("cluster_id")).otherwise(unknown)).drop("__known")


def proposals(components: DataFrame, settings: Settings, width: int | str, height: int | str, case: str = "case_id") -> DataFrame:
    """A box and mean fractions of each component; ids are given before small ones go, so they may have gaps.

    ``width`` and ``height`` are numbers, or columns of ``components`` with the size of each case's image.
    """
    g = settings.grid
    w, h = (F.expr(f"max({v})") if isinstance(v, str) else F.lit(v) for v in (width, height))
    cell = lambda v: F.ceil(v / F.lit(float(g))).cast("int")
    mean = lambda c: ten_thousandths(F.sum(c), F.count("*") * 10000).alias(c)
    keep = [F.max(v).alias(v) for v in (width, height) if isinstance(v, str)]
    out = components.groupBy(case, "component").agg(
        (F.min("gx") * cell(w)).alias("x1"), (F.min("gy") * cell(h)).alias("y1"),
        F.least(w, (F.max("gx") + 1) * cell(w)).alias("x2"), F.least(h, (F.max("gy") + 1) * cell(h)).alias("y2"),
        F.count("*").alias("cell_count"), mean("tissue"), mean("pale"), mean("artifact"), *keep,
    )
    whole = (F.col(width) if isinstance(width, str) else F.lit(width)).cast("long") * (F.col(height) if isinstance(height, str) else F.lit(height))
    size = (F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))
    return (
        out.withColumn("cluster_id", F.format_string("cluster_%02d", F.col("component")))
        .withColumn("__area", size)
        .filter(F.col("__area") * 10000 >= whole * settings.min_area)
        .withColumn("area_fraction", ten_thousandths(F.col("__area"), whole))
        .drop("__area")
    )


def fallback(cases: DataFrame, found: DataFrame, width: int | str, height: int | str, case: str = "case_id") -> DataFrame:
    """``found`` with the middle of the image, all fractions zero, for cases that have no proposal.

    ``width`` and ``height`` are numbers, or columns of ``cases`` and ``found``.
    """
    zero = F.lit(0).cast("long")
    w, h = (F.col(v) if isinstance(v, str) else F.lit(v) for v in (width, height))
    part = lambda v, k: F.floor(v * k / 10)
    columns = {
        "component": F.lit(0), "x1": part(w, 2), "y1": part(h, 2), "x2": part(w, 8), "y2": part(h, 8),
        "cell_count": zero, "tissue": zero, "pale": zero, "artifact": zero, "cluster_id": F.lit("cluster_00"), "area_fraction": zero,
    } | {v: F.col(v) for v in (width, height) if isinstance(v, str)}
    sizes = [v for v in (width, height) if isinstance(v, str)]
    missing = cases.select(case, *sizes).distinct().join(found.select(case).distinct(), case, "left_anti")
    made = missing.select(case, *[v.cast(found.schema[k].dataType).alias(k) for k, v in columns.items()])
    return found.unionByName(made)


#: Side of the least tiles in which regions and hints meet.
HINT_TILE = 256


def _placed(hints: DataFrame, tile: int) -> DataFrame:
    """Hints with their level, at which a tile is no smaller than the box (null for an empty one), and the tile (tx, ty) of their first corner."""
    wide, high = (F.col(f"h{v}2").cast("long") - F.col(f"h{v}1") for v in "xy")
    q = F.floor((F.greatest(wide, high) - 1) / tile)
    level = F.when((wide > 0) & (high > 0), F.when(q < 1, 0).otherwise(F.length(F.bin(q))))  # digits of q: it is below 2 ** level
    side = F.lit(float(tile)) * F.pow(F.lit(2.0), F.col("level"))
    return hints.withColumn("level", level).withColumns({f"t{v}": F.floor(F.col(f"h{v}1") / side).cast("int") for v in "xy"})


def _reached(regions: DataFrame, tile: int) -> DataFrame:
    """A row for each level of the mask ``levels`` and each of its tiles (tx, ty) in which a box that meets the region may begin; an empty region has none."""
    side = F.lit(float(tile)) * F.pow(F.lit(2.0), F.col("level"))
    span = lambda v: F.explode(F.sequence((F.floor((F.col(f"{v}1") + 1) / side) - 1).cast("int"), F.floor((F.col(f"{v}2") - 1) / side).cast("int")))
    some = regions.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    each = some.withColumn("level", F.explode(F.expr("filter(sequence(0, 32), l -> shiftright(levels, l) % 2 = 1)"))).drop("levels")
    return each.withColumn("tx", span("x")).withColumn("ty", span("y"))


def with_hints(regions: DataFrame, hints: DataFrame, case: str = "case_id", tile: int = HINT_TILE) -> DataFrame:
    """Regions with their greatest overlap with a hint box (ten-thousandths) and the case's greatest score, 0 without hints.

    ``hints`` has (case, hx1, hy1, hx2, hy2, score). The score is the greatest of
    all boxes of the case, overlapping or not. Hints are far more than regions, so
    each moves once, to the tile of its first corner; regions go to all tiles in
    which a hint that reaches them may begin. Large boxes have larger tiles.
    """
    a = geo.box(*[F.col(c) for c in geo.SIDES])
    b = geo.box(*[F.col(f"h{c}") for c in geo.SIDES])
    ratio = ten_thousandths(geo.area(geo.intersection(a, b)), F.greatest(F.lit(1), F.least(geo.area(a), geo.area(b))))
    placed, at = _placed(hints, tile), [case, "level", "tx", "ty"]
    facts = placed.groupBy(case).agg(F.max("score").alias("hint_score"), F.bit_or(F.pow(F.lit(2.0), F.col("level")).cast("long")).alias("levels"))
    about = regions.join(facts, case, "left")
    ours = _reached(about.select(case, "cluster_id", *geo.SIDES, "levels"), tile)
    # kept by the corners, with keys that can't be null: a test of the keys themselves is pushed to the scan and works each out many times
    theirs = placed.filter("hx2 > hx1 AND hy2 > hy1").select(case, *[F.coalesce(k, F.lit(0)).alias(k) for k in at[1:]], *[f"h{c}" for c in geo.SIDES])
    best = ours.join(theirs, at).groupBy(case, "cluster_id").agg(F.max(ratio).alias("hint_overlap"))
    return (
        about.drop("levels").join(best, [case, "cluster_id"], "left")
        .withColumn("hint_overlap", F.coalesce("hint_overlap", F.lit(0)).cast("long"))
        .withColumn("hint_score", F.coalesce("hint_score", F.lit(0.0)))
    )


def scored(regions: DataFrame, settings: Settings) -> DataFrame:
    """Label l, priority s, review flag d, risk and description of each region."""
    s, c = settings, F.col
    background, artifact = c("tissue") < s.background_tissue, c("artifact") > s.artifact
    pale, hint = c("pale") > s.pale, c("hint_overlap") > s.hint_overlap
    sized = c("area_fraction").between(s.area_low, s.area_high)
    points = F.lit(1) + pale.cast("int") + hint.cast("int") + sized.cast("int")
    out = regions.withColumn("__p", F.when(background | artifact, F.lit(0)).otherwise(points))
    suspicious = c("__p") >= 2
    label = (F.when(background, "background").when(artifact, "artifact")
             .when(suspicious, "serrated_suspicious_mucosa").otherwise("non_serrated_mucosa"))
    risk = F.when(c("__p") > 0, F.least(F.lit(5), c("__p") + (c("pale") > s.pale_high).cast("int"))).otherwise(0)
    out = out.withColumn("l", label).withColumn("s", F.least(F.lit(5), c("__p"))).withColumn("risk", risk)
    out = out.withColumn("d", suspicious & (c("risk") >= 3))
    # The wording of the reasons.
    reasons = F.when(c("l") == "background", F.lit("low tissue fraction on overview screening")).when(
        c("l") == "artifact", F.lit("high artifact-like color fraction")).otherwise(F.concat_ws(
            "; ", F.lit("mucosal tissue retained after overview filtering"),
            F.when(pale, "surface pallor / mucus-rich pattern supports a serrated lesion impression"),
            F.when(hint, "region overlaps a route-C low-resolution hint"),
            F.when(sized, "region size is suitable for structured lesion review"),
            F.when(c("d"), "cluster should enter structural crypt review")))
    return out.withColumn("description", reasons).drop("__p")


def top_regions(regions: DataFrame, settings: Settings, case: str = "case_id") -> DataFrame:
    """The first regions of each case by priority, then area, then order of discovery."""
    area = (F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))
    rank = F.row_number().over(Window.partitionBy(case).orderBy(F.col("s").desc(), area.desc(), F.col("component")))
    return regions.withColumn("rank", rank).filter(F.col("rank") <= settings.max_clusters)
