"""Joining a group's facts back to its rows when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hot key is dealt over this many salts before a join.
SALTS = 32


def salt_of(col: str) -> Column:
    """A salt from a column that tells a group's rows apart; the same in every run."""
    return F.pmod(F.xxhash64(col), F.lit(SALTS)).cast("int")


def group_facts(rows: DataFrame, key: str, salt: str, aggs: list[Column]) -> DataFrame:
    """Aggregates of each key, with the salts its rows use: (key, *aggs, __salts)."""
    return rows.groupBy(key).agg(*aggs, F.collect_set(salt).alias("__salts"))


def attach(rows: DataFrame, facts: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` of :func:`group_facts` back to ``rows``; a hot key is dealt over its salts.

    A small group has few salts, so the facts are repeated no oftener than there are rows.
    """
    spread = facts.withColumn(salt, F.explode("__salts")).drop("__salts")
    return rows.join(spread, [key, salt], how)
