"""Confusion metrics and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import ten_thousandths


def four(part: Column, whole: Column) -> Column:
    return ten_thousandths(part, whole) / 10000.0


def layer_metrics(pairs: DataFrame, layer: str = "layer") -> DataFrame:
    """Confusion counts, accuracy, recall and specificity of rows (layer, target, pred).

    A null target or prediction leaves the row out; a target that is neither 0
    nor 1 counts as a case only. Accuracy is null without cases, the other two
    are then 0.
    """
    both = F.col("target").isNotNull() & F.col("pred").isNotNull()
    is_ = lambda t, p: F.count_if((F.col("target") == t) & (F.col("pred") == p))
    n = pairs.groupBy(layer).agg(F.count_if(both).alias("cases"), is_(1, 1).alias("tp"), is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"))
    c = F.col
    return (
        n.withColumn("accuracy", F.when(c("cases") > 0, four(c("tp") + c("tn"), c("cases"))))
        .withColumn("recall", four(c("tp"), c("tp") + c("fn"))).withColumn("specificity", four(c("tn"), c("tn") + c("fp")))
    )


def unpivot_layers(rows: DataFrame, layers: dict[str, tuple[str, str]], *keys: str) -> DataFrame:
    """(keys, layer, target, pred) from a pair of columns for each layer."""
    each = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(t).alias("target"), F.col(p).alias("pred")) for k, (t, p) in layers.items()])
    return rows.select(*keys, F.explode(each).alias("e")).select(*keys, "e.layer", "e.target", "e.pred")


def run_summary(results: DataFrame, averages: list[str], status: str = "status") -> DataFrame:
    """One row: cases, warned and failed ones, and means over all cases to four places (missing counts 0).

    The averaged columns are whole numbers; without cases a mean is 0.
    """
    means = [four(F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)), F.count("*")).alias(f"avg_{c}") for c in averages]
    return results.agg(F.count("*").alias("case_count"), F.count_if(F.col(status) == "warn").alias("warn_cases"), F.count_if(F.col(status) == "fail").alias("fail_cases"), *means)


def cost_units(cases: DataFrame, clusters: DataFrame, steps: DataFrame, attempts: DataFrame | None, case: str = "case_id") -> DataFrame:
    """(case, estimated_case_cost_units, trace_attempts, observation_steps): clusters and steps, attempts, steps; 0 where there are none."""
    n = lambda rows, name: rows.groupBy(case).agg(F.count("*").alias(name))
    out = cases.select(case).distinct().join(n(clusters, "__c"), case, "left").join(n(steps, "observation_steps"), case, "left")
    out = out.join(n(attempts, "trace_attempts"), case, "left") if attempts is not None else out.withColumn("trace_attempts", F.lit(0).cast("long"))
    out = out.na.fill(0, ["__c", "trace_attempts", "observation_steps"])
    return out.select(case, (F.col("__c") + F.col("observation_steps")).alias("estimated_case_cost_units"), "trace_attempts", "observation_steps")


def event_metrics(events: DataFrame) -> DataFrame:
    """Extension: mean step latency, and shares of cache hits and of successful events, over a log
    (latency_ms, cache_hit, status)."""
    return events.agg(
        four(F.sum(F.coalesce("latency_ms", F.lit(0))), F.count("*")).alias("average_step_latency_ms"),
        four(F.count_if("cache_hit"), F.count("*")).alias("cache_hit_rate"), four(F.count_if(F.col("status") == "ok"), F.count("*")).alias("success_rate"))
