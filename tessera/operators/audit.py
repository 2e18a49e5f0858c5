"""Audit rules: a rule is a filter that names what it finds; a case's status rolls them up."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import TRACE_LABELS
from .evidence import drop_stops


def rule(rows: DataFrame, bad: Column, severity: str, name: str, ref: Column, case: str = "case_id") -> DataFrame:
    return rows.filter(bad).select(case, F.lit(severity).alias("severity"), F.lit(name).alias("rule"), ref.cast("string").alias("ref"))


def missing(cases: DataFrame, found: DataFrame, name: str, severity: str = "error", case: str = "case_id") -> DataFrame:
    """A violation of each case that has no row in ``found``."""
    return rule(cases.select(case).distinct().join(found.select(case).distinct(), case, "left_anti"), F.lit(True), severity, name, F.lit(""), case)


def early_gate(steps: DataFrame, case: str = "case_id", group: str = "cluster_id", gate: str = "stage_gate", late="level_3", first="level_2", order: str = "ord") -> DataFrame:
    """Steps of gate ``late`` with no earlier step of gate ``first`` in their group; no group, no check."""
    before = Window.partitionBy(case, group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.coalesce(F.max((F.col(gate) == first).cast("int")).over(before), F.lit(0))
    return steps.filter(F.col(group).isNotNull()).withColumn("__seen", seen).filter((F.col(gate) == late) & (F.col("__seen") == 0)).drop("__seen")


def step_violations(steps: DataFrame, width: int | str, height: int | str, case: str = "case_id") -> DataFrame:
    """``width`` and ``height`` are numbers, or columns of ``steps`` with the size of each case's image."""
    steps = drop_stops(steps)
    c, ref = F.col, F.col("step_id")
    outside = ~(c("x").between(0, F.expr(str(width))) & c("y").between(0, F.expr(str(height))))
    empty = lambda n: F.coalesce(c(n), F.lit("")) == ""
    rules = [
        rule(steps, outside, "error", "step_out_of_bounds", ref, case), rule(steps, ~c("m").between(1.0, 5.0), "error", "magnification_invalid", ref, case),
        *[rule(steps, empty(n), "error", f"missing_{n}", ref, case) for n in ("need_to_see", "review_goal", "stage_gate") if n in steps.columns],
        rule(early_gate(steps, case), F.lit(True), "error", "gate_order", ref, case),
    ]
    return union(rules)


def label_violations(regions: DataFrame, case: str = "case_id", labels=TRACE_LABELS) -> DataFrame:
    return rule(regions, F.coalesce(~F.col("l").isin(*labels), F.lit(True)), "error", "invalid_label", F.col("cluster_id"), case)


#: The artifacts that a finished case has, and the rule that names a missing one.
ARTIFACTS = {"observations": "no_observations", "report": "no_report", "prediction": "no_prediction",
             "serrated": "no_serrated_checklist", "ssl_like": "no_ssl_like_checklist", "dysplasia": "no_dysplasia_checklist"}


def artifact_violations(cases: DataFrame, observations: DataFrame, assessed: DataFrame, listed: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases without observations, report, prediction or one of the three checklists."""
    found = {"observations": observations, "report": assessed.filter(F.coalesce("report", F.lit("")) != ""), "prediction": assessed.filter(F.col("serrated_label").isNotNull()),
             **{layer: listed.filter(F.col("layer") == layer) for layer in ("serrated", "ssl_like", "dysplasia")}}
    return union([missing(cases, rows, ARTIFACTS[name], case=case) for name, rows in found.items()])


def typed_violations(rows: DataFrame, priority: str, flag: str, ref: str, case: str = "case_id") -> DataFrame:
    """Rows as text whose priority is no whole number, or whose flag is no boolean."""
    whole, truth = F.coalesce(F.col(priority).rlike("^-?[0-9]+$"), F.lit(False)), F.coalesce(F.col(flag).isin("true", "false"), F.lit(False))
    return union([rule(rows, ~whole, "error", "priority_not_integer", F.col(ref), case), rule(rows, ~truth, "error", "flag_not_boolean", F.col(ref), case)])


def open_records(rows: DataFrame, record: str, fields: dict[str, str], *keys: str) -> DataFrame:
    """(keys, fields, violation, n_keys, rest) of JSON texts whose further keys are not known.

    A field is null where it is missing or not of its type; ``violation`` names
    the first that is there but of another type, or "no_record" where the text is
    no JSON object. ``n_keys`` counts the keys, known or not (null for no
    record), and ``rest`` keeps the record whole, as VARIANT text.
    """
    parsed = rows.withColumn("__v", F.try_parse_json(record))
    as_map = F.try_variant_get("__v", "$", "map<string,variant>")
    got = {name: F.try_variant_get("__v", f"$.{name}", kind) for name, kind in fields.items()}
    there = lambda name: F.try_variant_get("__v", f"$.{name}", "variant")
    wrong = F.coalesce(*[F.when(there(name).isNotNull() & ~F.is_variant_null(there(name)) & (got[name].isNull() | ~F.schema_of_variant(there(name)).isin(*_KINDS[kind])), F.lit(f"{name}_not_{kind}")) for name, kind in fields.items()])
    return parsed.select(*keys, *[F.when(wrong.isNull(), v).alias(name) for name, v in got.items()],
                         F.when(as_map.isNull(), "no_record").otherwise(wrong).alias("violation"), F.when(as_map.isNotNull(), F.size(F.map_keys(as_map))).alias("n_keys"), F.to_json("__v").alias("rest"))


#: Types that a VARIANT may give for a field of a type: a number in quotes is text.
_KINDS = {"long": ("BIGINT",), "double": ("BIGINT", "DOUBLE"), "boolean": ("BOOLEAN",), "string": ("STRING",)}


def export_violations(exports: DataFrame, case: str = "case_id") -> DataFrame:
    """Exports whose return code is not zero; a missing one is bad."""
    return rule(exports, ~F.col("returncode").eqNullSafe(0), "error", "export_failed", F.lit(""), case)


def support_warnings(counts: DataFrame, case: str = "case_id") -> DataFrame:
    return rule(counts.filter("layer = 'serrated'"), F.col("supporting") == 0, "warning", "no_serrated_support", F.lit(""), case)


def union(rules: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def status(cases: DataFrame, violations: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, errors, warnings, status): fail with an error, else warn with a warning, else ok."""
    n = violations.groupBy(case).agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning")])
    out = cases.select(case).distinct().join(n, case, "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("ok"))
