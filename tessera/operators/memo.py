"""Content-addressed memo, provider fallback and retries as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import attach, group_facts, salt_of


def content_key(*inputs: str | Column) -> Column:
    """SHA-1 of all inputs as canonical JSON: equal inputs, nulls included, give equal keys."""
    return F.sha1(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}))


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests answered from the cache, and those that miss."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def remember(cache: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The cache with new entries; a new entry replaces an old one of its key."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the first row's order of its key, and whether it would hit a cache filled in order."""
    salted = rows.withColumn("__salt", salt_of(order))
    first = group_facts(salted, key, "__salt", [F.min(order).alias("first_seen")])
    return attach(salted, first, key, "__salt").drop("__salt").withColumn("hit", F.col(order) > F.col("first_seen"))


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one's wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def latency(attempts: DataFrame, *keys: str, column: str = "latency_ms") -> DataFrame:
    """(keys, latency_ms): the sum over attempts; a missing one counts as 0."""
    return attempts.groupBy(*keys).agg(F.sum(F.coalesce(column, F.lit(0))).cast("long").alias("latency_ms"))


def first_success(attempts: DataFrame, *keys: str, priority: str = "priority", output: str = "output", strict: bool = False) -> DataFrame:
    """Per request the output of the first provider that is ok, who it was, and how the earlier ones failed.

    ``attempts`` has (keys, priority, provider, status, output) of all providers
    that could be asked; the attempts after a success do not count. With
    ``strict`` a request that all providers failed is an error; else its output is null.
    """
    ok = F.col("status") == "ok"
    best = F.min(F.when(ok, F.struct(priority, "provider", output)))
    tried = F.sort_array(F.collect_list(F.struct(priority, F.concat_ws(":", "provider", "status").alias("t"))))
    out = attempts.groupBy(*keys).agg(best.alias("__b"), tried.alias("__t"))
    counted = F.filter("__t", lambda x: F.col("__b").isNull() | (x[priority] <= F.col(f"__b.{priority}")))
    provider = F.col("__b.provider")
    if strict:
        provider = F.when(provider.isNotNull(), provider).otherwise(F.raise_error(F.concat(F.lit("all providers failed: "), F.array_join(F.transform("__t", lambda x: x["t"]), ","))).cast("string"))
    return out.select(*keys, provider.alias("provider"), F.col(f"__b.{output}").alias(output), F.array_join(F.transform(counted, lambda x: x["t"]), ",").alias("attempts"))


def retries(tries: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` attempts of each key, numbered from 1, up to the first that succeeds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = tries.withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= limit)
    before = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col("status") == "ok").cast("int")).over(before), F.lit(0))
    return numbered.withColumn("__done", done).filter("__done = 0").drop("__done")


def mode_plan(manual: Column, mode: Column, auto=("model", "heuristic")) -> Column:
    """Selector modes to try in order: manual boxes alone, "auto" as the ``auto`` list, else the mode."""
    return F.when(F.coalesce(manual, F.lit("")) != "", F.array(F.lit("manual"))).when(mode == "auto", F.array(*[F.lit(m) for m in auto])).otherwise(F.array(mode))


def parse_boxes(spec: Column) -> Column:
    """Boxes of "x1,y1,x2,y2;..." as an array of structs; what is no number is null."""
    part = lambda b, i: F.try_element_at(F.split(b, ","), F.lit(i + 1)).try_cast("int")
    whole = F.filter(F.split(spec, ";"), lambda b: F.trim(b) != "")
    return F.transform(whole, lambda b: F.struct(*[part(b, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))
