"""A review path of each case: greedy steps over its regions without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..settings import Settings

# Goals and gates of the three magnifications, and what a step needs to see.
GOALS = (
    (1.0, "serrated_lesion_assessment", "level_1"),
    (2.5, "ssl_like_architecture_assessment", "level_2"),
    (5.0, "dysplasia_assessment", "level_3"),
)
NEEDS = {
    "level_1": "Confirm whether this mucosal lesion belongs to the serrated lesion pathway by reviewing surface contour, mucus-rich change, and lesion context.",
    "level_2": "Search for SSL-like crypt disorder, including basal dilatation, branching, horizontal growth, and serration extending toward the crypt base.",
    "level_3": "Perform routine high-magnification cytology review for dysplasia or atypia after structural crypt assessment.",
    "end": "Stop navigation and consolidate the layered serrated, SSL-like, and dysplasia evidence.",
}
NOTHING_TO_SEE = "Stop navigation because no reviewable lesion cluster was retained."
END_GOAL, END_GATE = "integrated_impression", "end"


def trajectory(regions: DataFrame, width: int | str, height: int | str, settings: Settings, case: str = "case_id") -> DataFrame:
    """Steps (case, step_id, x, y, m, review_goal, stage_gate, size, cluster_id, action, need_to_see, x and y in millionths) of each case.

    Regions (cluster_id, x1..y2 on the full image, l, s, d) are walked by
    descending priority and id. A step whose window overlaps a kept one of its
    magnification is passed over: its own window as planned against kept ones as
    moved inside the image. A stop step follows; it is all there is where no
    region can be reviewed. A case has few regions, so its fold is bounded.
    ``width`` and ``height`` are numbers, or columns of ``regions`` with the size of each case's image.
    """
    spans = dict(settings.regions)
    specs = [
        F.struct(F.lit(i).alias("k"), F.lit(m).alias("m"), F.lit(goal).alias("goal"), F.lit(gate).alias("gate"), F.lit(spans.get(m, settings.default_region)).alias("size"))
        for i, (m, goal, gate) in enumerate(GOALS)
    ]
    cx = F.bround((F.col("x1") + F.col("x2")) / 2.0).cast("int")
    cy = F.bround((F.col("y1") + F.col("y2")) / 2.0).cast("int")
    can = (F.col("s") > 0) & ~F.col("l").isin("background", "artifact")
    wanted = (
        regions.filter(can).withColumn("__cx", cx).withColumn("__cy", cy)
        .withColumn("__e", F.explode(F.when(F.col("d"), F.array(*specs)).otherwise(F.array(specs[0]))))
    )
    # sorted ascending and reversed, but the goals of a region keep their order
    entry = F.struct(F.col("s").cast("int").alias("s"), F.col("cluster_id"), (-F.col("__e.k")).alias("nk"), F.col("__cx").alias("cx"), F.col("__cy").alias("cy"),
                     F.col("__e.m").alias("m"), F.col("__e.goal").alias("goal"), F.col("__e.gate").alias("gate"), F.col("__e.size").alias("size"))
    lists = wanted.groupBy(case).agg(F.reverse(F.sort_array(F.collect_list(entry))).alias("__w"))
    sizes = [v for v in (width, height) if isinstance(v, str)]
    everyone = regions.select(case, *sizes).distinct().join(lists, case, "left")
    kept = "array<struct<x:int,y:int,m:double,goal:string,gate:string,size:int,cluster_id:string>>"
    t = settings.overlap_threshold
    half = "(e.size div 2)"
    wx = f"greatest(0, least(e.cx + {half}, p.x + p.size div 2) - greatest(e.cx - {half}, p.x - p.size div 2))"
    wy = f"greatest(0, least(e.cy + {half}, p.y + p.size div 2) - greatest(e.cy - {half}, p.y - p.size div 2))"
    side = "CAST(2 * ({0}.size div 2) AS BIGINT)"
    least = f"least({side.format('e')} * {side.format('e')}, {side.format('p')} * {side.format('p')})"
    clash = f"exists(acc, p -> abs(p.m - e.m) <= 1e-6 AND CAST({wx} AS BIGINT) * {wy} > {t} * greatest(1, {least}))"
    place = lambda v, n: f"CAST(greatest({half}, least(greatest({half}, {n} - {half}), e.{v})) AS INT)"
    new = (f"named_struct('x', {place('cx', width)}, 'y', {place('cy', height)}, 'm', CAST(e.m AS DOUBLE), 'goal', e.goal, 'gate', e.gate, "
           f"'size', e.size, 'cluster_id', e.cluster_id)")
    fold = f"aggregate(__w, CAST(array() AS {kept}), (acc, e) -> CASE WHEN size(acc) >= {settings.max_steps} OR {clash} THEN acc ELSE concat(acc, array({new})) END)"
    steps = everyone.withColumn("__k", F.coalesce(F.expr(fold), F.expr(f"CAST(array() AS {kept})")))
    stop = (f"named_struct('x', coalesce(try_element_at(__k, -1).x, 0), 'y', coalesce(try_element_at(__k, -1).y, 0), 'm', 1.0D, 'goal', '{END_GOAL}', "
            f"'gate', '{END_GATE}', 'size', 256, 'cluster_id', CAST(NULL AS STRING))")
    each = steps.select(case, *sizes, F.posexplode(F.expr(f"concat(__k, array({stop}))")).alias("ord", "e"))
    need = F.when((F.col("e.gate") == END_GATE) & (F.col("ord") == 0), NOTHING_TO_SEE)
    for gate, text in NEEDS.items():
        need = need.when(F.col("e.gate") == gate, text)
    return each.select(
        case, "ord", F.format_string("step_%02d", F.col("ord")).alias("step_id"), "e.x", "e.y", "e.m", F.col("e.goal").alias("review_goal"),
        F.col("e.gate").alias("stage_gate"), "e.size", "e.cluster_id",
        F.when(F.col("e.gate") == END_GATE, "stop").otherwise("inspect").alias("action"), need.alias("need_to_see"),
        geo.millionths(F.col("e.x"), F.expr(str(width))).alias("x_millionths"), geo.millionths(F.col("e.y"), F.expr(str(height))).alias("y_millionths"))
