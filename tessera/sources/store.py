"""A store of answers across runs: entries by key, dealt by the key's beginning.

Files under the store's path::

    data/<commit>/prefix=ab/   key, stage, output, stamp
    log/<commit>.json          {"commit": ..., "replaces": [...]}

A commit counts once its file stands in ``log``; it is written beside it and
renamed, so readers see all of it or nothing. Commits have names of their own and
only ever add, so writers at the same time lose nothing; of a key's entries the
one of the latest stamp holds. Compaction adds a commit that replaces those it
has read; entries that others add meanwhile stand beside it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, stage string, output string, stamp string"
#: Digits of the key that an entry is dealt by.
DIGITS = 2


class Store:
    """Entries (key: hexadecimal digits, stage, output). Nulls in ``key`` are no entries; of equal keys in one ``add`` the greatest output holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """Names of the commits that hold, in order of time."""
        log = self._paths(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(log)]
        found = [n[:-5] for n in names if n.endswith(".json")]
        if not found:
            return []
        rows = self.spark.read.schema("commit string, replaces array<string>").json([f"{self.path}/log/{n}.json" for n in found])
        gone = {r.old for r in rows.select(F.explode("replaces").alias("old")).collect()}  # names of commits, not entries
        return sorted(set(found) - gone)

    def entries(self, prefixes: list[str] | None = None, commits: list[str] | None = None) -> DataFrame:
        """(key, stage, output, stamp), one row a key; of ``prefixes`` alone where they are given: others' files are not read."""
        commits = self.commits() if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(f"{ENTRY}, prefix string").parquet(*[f"{self.path}/data/commit={c}" for c in commits])
        if prefixes is not None:
            rows = rows.filter(F.col("prefix").isin(prefixes))
        last = F.max(F.struct("stamp", "output", "stage")).alias("e")
        return rows.groupBy("key").agg(last).select("key", "e.stage", "e.output", "e.stamp")

    def lookup(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(requests with their ``output``, requests that miss). Only the parts that the keys begin with are read."""
        prefixes = [r.p for r in requests.select(F.left("key", F.lit(DIGITS)).alias("p")).distinct().collect() if r.p]  # 16 ** DIGITS at most
        known = self.entries(prefixes).select("key", "output")
        return requests.join(known, "key"), requests.join(known.select("key"), "key", "left_anti")

    def add(self, rows: DataFrame, replaces: tuple[str, ...] = ()) -> str | None:
        """A commit with ``rows`` (key, stage, output, and their stamp if they have one); its name, or None without rows."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        rows = rows.filter("key IS NOT NULL")
        rows = rows if "stamp" in rows.columns else rows.withColumn("stamp", F.lit(name))
        made = rows.select("key", "stage", "output", "stamp").withColumn("prefix", F.left("key", F.lit(DIGITS)))
        made.repartition("prefix").write.partitionBy("prefix").parquet(f"{self.path}/data/commit={name}")
        if not any(f.isDirectory() for f in self._fs.listStatus(self._paths(f"{self.path}/data/commit={name}"))) and not replaces:
            return None
        beside = self._paths(f"{self.path}/log/.{name}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps({"commit": name, "replaces": list(replaces)}).encode()))
        out.close()
        if not self._fs.rename(beside, self._paths(f"{self.path}/log/{name}.json")):
            raise OSError(f"commit {name} was not written")
        return name

    def compact(self) -> str | None:
        """Puts all entries in one commit, one row a key."""
        old = self.commits()
        return self.add(self.entries(commits=old), tuple(old)) if len(old) > 1 else None

    def vacuum(self) -> int:
        """Removes what replaced commits hold; call it when no reader uses them any more. The number of commits removed."""
        now, n = set(self.commits()), 0
        data = self._paths(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else ():
            name = f.getPath().getName().removeprefix("commit=")
            if name not in now and self._fs.exists(self._paths(f"{self.path}/log/{name}.json")):
                self._fs.delete(f.getPath(), True)
                n += 1
        return n
