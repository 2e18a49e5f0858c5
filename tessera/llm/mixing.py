"""Mixing sources to target weights.

One aggregation gives the words of each source; water-filling in window sums
over the sources gives their targets; each document is then emitted
floor(rate) times plus one hash-seeded Bernoulli copy for the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, salt_of, SALTS

WEIGHTS = (5, 2, 1)
#: Sources are broadcast up to this many rows (about 100 bytes each), else joined by salted keys.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` of all words; a target stops at ``cap`` times its source's words
    and the rest is shared anew by weight. Sorted by words per weight, the
    sources that stop are a prefix, so sums over that order settle it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = Window.orderBy(F.col("source").isNull(), F.col("source").asc())
    k = F.row_number().over(turn) - 1
    table = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("__k", k).withColumn("__w", F.element_at(table, F.col("__k") % len(weights) + 1).cast("long"))
    per = per.withColumn("__r", F.col("source_size") / F.col("__w"))
    w = Window.orderBy("__r", "__k")  # one row per source
    every = Window.partitionBy()
    first_open = F.min(F.when(~F.col("__stops"), F.struct("__r", "__k", "__level"))).over(every)["__level"]
    return (
        per.withColumn("__all", F.sum("source_size").over(every))
        .withColumn("__stopped", F.coalesce(F.sum(F.col("source_size") * cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        # level of the fill if all before this source stop and this one is the first that doesn't
        .withColumn("__level", (F.col("__all") * F.lit(float(share)) - F.col("__stopped")) / F.col("__left"))
        .withColumn("__stops", F.col("source_size") * cap <= F.col("__w") * F.col("__level"))
        .withColumn("target", F.when(F.col("__stops"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("__w") * first_open))
        .select("source", "source_size", "target")
    )


def _text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _ranked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__rank``, 0 but for rows that repeat both doc_id and text: these count up.

    Repeats are looked for in keys of two numbers; only they are sorted, by groups, in the JVM.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    again = docs.groupBy(key.alias("__key")).count().filter("count > 1").select("__key")
    if again.isEmpty():
        return docs.withColumn("__rank", F.lit(0))
    keyed = docs.withColumn("__key", key)
    same = F.col("__key").eqNullSafe(F.col("__again"))
    again = again.withColumnRenamed("__key", "__again")
    order = Window.partitionBy("__key").orderBy(F.col("source").asc_nulls_first())
    repeated = keyed.join(again, same, "left_semi").withColumn("__rank", F.row_number().over(order) - 1)
    return keyed.join(again, same, "left_anti").withColumn("__rank", F.lit(0)).unionByName(repeated).drop("__key")


def plan_copies(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """``docs`` with size (words), source_size, target and copies.

    The coin of a document is the MD5 of seed, doc_id, text and, among rows
    equal in both, its rank, so reruns agree and no two rows share a coin. A
    null doc_id counts as the text "null", a null text as the empty one (with
    size 0). A source without words has rate 0; a null source is one of its own.
    An empty table gives no rows.
    """
    docs = _ranked(docs.drop("size", "source_size", "target", "copies", "__rank"))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    targets = source_targets(sized.select("source", "size"), **how).withColumnRenamed("source", "__source")
    key = F.col("source").eqNullSafe(F.col("__source"))
    if targets.select("__source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), key)
    else:
        spread = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("__s", salt_of("doc_id")).join(spread, key & (F.col("__s") == F.col("__salt"))).drop("__s", "__salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), _text_key(), F.lit(":"), F.col("__rank").cast("string")).cast("binary"))
    coin = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    return joined.withColumn("copies", whole + F.when(coin < rate - whole, 1).otherwise(0)).drop("__source", "__rank")


def mix(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; ``copy`` counts from 0. All columns pass; rows as in :func:`plan_copies`."""
    planned = plan_copies(docs.drop("copy"), seed, **how)
    emitted = planned.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies").cast("int") - 1))))
    return emitted.drop("size", "source_size", "target", "copies")


def op8_mix_to_weights(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_OP8 = r"""
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY source NULLS FIRST) - 1 AS rank, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM s),
w AS (SELECT *, [5, 2, 1][k % 3 + 1]::BIGINT AS w FROM k),
l AS (SELECT *, source_size / w AS r FROM w),
f AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(source_size * 2) OVER (ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(w) OVER (ORDER BY r, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM l),
g AS (SELECT *, source_size * 2 <= w * level AS stops FROM f),
t AS (
  SELECT source, source_size, CASE WHEN stops THEN (source_size * 2)::DOUBLE
         ELSE w * (SELECT arg_min(level, (r, k)) FROM g WHERE NOT stops) END AS target FROM g),
c AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || rank), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
"""
OP8_SQL = _OP8.format(docs="documents") + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM m"
