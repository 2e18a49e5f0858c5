"""Ordered event logs rendered as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def now_iso() -> Column:
    """The session's local time, to seconds."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def event_line(timestamp: Column, state: Column, agent: Column, status: Column, source: Column, target: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit("- ["), shown(timestamp), F.lit("] "), shown(state), F.lit("/"), shown(agent), F.lit(" status="), shown(status),
                    F.lit(" input="), shown(source), F.lit(" output="), shown(target))


def timeline(lines: DataFrame, case: str, order: list[str], line: str = "line") -> DataFrame:
    """(case, events, timeline): the lines of each case in order. A case's log is short; it is one document."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("__l"))))
    text = F.array_join(F.transform(rows, lambda x: x["__l"]), "\n")
    return lines.groupBy(case).agg(F.count("*").alias("events"), text.alias("timeline"))


def replay(timelines: DataFrame, results: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, replay): header, timeline, result counts, layers and checklists, as one text.

    ``results`` has status, trace_clusters, trajectory_steps, the three targets,
    warnings, errors, the three labels, and per layer a sorted "name: status" text.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    item = lambda name, c: F.concat(F.lit(f"- {name}: "), shown(c))
    head = lambda s: F.lit(s)
    gap = F.lit("")
    parts = [
        F.concat(F.lit("# Replay for "), F.col(case).cast("string")), gap, head("## Timeline"), gap, F.col("timeline"), gap, head("## Result"), gap,
        item("status", "status"), item("trace_clusters", "trace_clusters"), item("trajectory_steps", "trajectory_steps"), item("serrated_target", "serrated_target"),
        item("ssl_like_target", "ssl_like_target"), item("dysplasia_proxy_target", "dysplasia_proxy_target"), item("warning_count", "warnings"), item("error_count", "errors"),
        gap, head("## Hierarchy"), gap, item("serrated lesion", "serrated_label"), item("SSL-like architecture", "ssl_like_label"), item("dysplasia", "dysplasia_label"),
        gap, head("## Checklists"), gap, head("### Serrated"), F.col("serrated_list"), gap, head("### SSL-like"), F.col("ssl_like_list"), gap, head("### Dysplasia"), F.col("dysplasia_list"),
    ]
    return timelines.join(results, case).select(case, F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("replay"))
