"""Cases and their targets: last-row-wins left join, membership, and head-n samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member(value: Column, of: Sequence) -> Column:
    """Null for null, else 1 where value is one of ``of`` (an empty string is a value)."""
    return F.when(value.isNotNull(), value.isin(*of).cast("int") if of else F.lit(0))


def last_row(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Of rows with one key the one of greatest order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in others])


def with_labels(cases: DataFrame, labels: DataFrame, key: str, order: Column) -> DataFrame:
    """Each case with the last label row of its key; nulls where there is none."""
    return cases.join(last_row(labels, key, order), key, "left")


def case_by_id(cases: DataFrame, key: str, value, order: str) -> DataFrame:
    """The first case with this id; an error where there is none."""
    found = cases.filter(F.col(key) == F.lit(value)).orderBy(order).limit(1)
    if found.isEmpty():
        raise KeyError(value)
    return found


# The constants of a pilot row.
PILOT_SPLIT, PILOT_REASON = "pilot_eval", "aligned_manifest_and_labels_csv"


def pilot(cases: DataFrame, target: str, order: str, positives: int, negatives: int) -> DataFrame:
    """The first cases of each class in order; null targets are in neither. Each class is one top-n."""
    some = [cases.filter(F.col(target) == t).orderBy(order).limit(n) for t, n in ((1, positives), (0, negatives))]
    return some[0].unionByName(some[1]).withColumn("pilot_split", F.lit(PILOT_SPLIT)).withColumn("selection_reason", F.lit(PILOT_REASON))
