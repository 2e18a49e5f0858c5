"""Helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import shared_folder
from ..operators.skew import SALTS, attach, group_facts, salt_of  # noqa: F401

#: One run of the six ASCII white-space characters, and one word between them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one where none is set and all runs in one process."""
    return shared_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, rows: int = 1_000):
    """Arrow batches in parts of ``rows`` at most: texts as Python objects take more room than as columns."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def words_of(text: str | None) -> list[bytes]:
    """Words between runs of ASCII white space: bytes.split() knows just those six."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


class Memo:
    """Values of keys, made in lists when missing; keys of the last two generations are held."""

    def __init__(self, make, size: int):
        self.make, self.size, self.now, self.old = make, size, {}, {}

    def hold(self, keys: set) -> dict:
        """A dict that has all ``keys``; valid until the next call."""
        if len(self.now) > self.size:
            self.old, self.now = self.now, {}
        missing, now, old = [], self.now, self.old
        for k in keys.difference(now):
            if (v := old.get(k)) is None:
                missing.append(k)
            else:
                now[k] = v
        if missing:
            now.update(zip(missing, self.make(missing)))
        return now

    def values(self, lists: list[list]) -> list[list]:
        """The values of lists of keys."""
        get = self.now.get
        found = [list(map(get, keys)) for keys in lists]
        holes = [[i for i, v in enumerate(f) if v is None] for f in found]
        now = self.hold({keys[i] for keys, at in zip(lists, holes) for i in at})
        for keys, f, at in zip(lists, found, holes):
            for i in at:
                f[i] = now[keys[i]]
        return found


def prefix(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Add ``__rank`` (0-based) and ``__before`` (sum of ``amount`` of earlier rows).

    Range partitions carry the order; only one row per partition meets in one
    place, for the offsets. ``df`` should be narrow: it is staged once.
    """
    spark = df.sparkSession
    ranged = (
        df.repartitionByRange(partitions(spark), *[F.col(c).asc_nulls_first() for c in order])
        .withColumn("__pid", F.spark_partition_id())
    )
    ranged = staged(ranged, name)
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__pid").agg(F.count("*").alias("__n"), F.sum(amount).alias("__s"))
    offsets = totals.select(
        "__pid",
        F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__s0"),
    )
    inside = Window.partitionBy("__pid").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so the broadcast is bounded by their number
    return (
        ranged.withColumn("__i", F.row_number().over(inside) - 1)
        .withColumn("__b", F.coalesce(F.sum(amount).over(before), F.lit(0)))
        .join(F.broadcast(offsets), "__pid")
        .withColumn("__rank", (F.col("__n0") + F.col("__i")).cast("long"))
        .withColumn("__before", (F.col("__s0") + F.col("__b")).cast("long"))
        .drop("__pid", "__i", "__b", "__n0", "__s0")
    )


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`staged`, with the path, for tables that :func:`discard` removes later."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, str]:
    """``df`` written in buckets of ``key`` and read back, with the path: joins on ``key`` move the other side alone."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    n, table = partitions(spark), f"tessera_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    return spark.table(table), path


class Scratch:
    """Staged tables that an operator needs only until its result is written."""

    def __init__(self):
        self.paths = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        held, path = staged_at(df, name)
        self.paths.append((df.sparkSession, path))
        return held

    def clear(self) -> None:
        for spark, path in self.paths:
            discard(spark, path)
        self.paths = []


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
