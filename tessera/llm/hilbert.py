"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``BITS`` bits by its own quantiles, the cells
are ordered by their Hilbert index, and the ordered rows are cut into runs of
equal count. A run covers a compact box of cells, so the ranges kept in the
manifest prune files on every dimension at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix, read_table, staged

BITS = 5
#: Relative error of the quantiles is 1 / ACCURACY.
ACCURACY = 10_000
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (n x dimensions, ``bits`` bits each) on the curve.

    From the top bit down, a dimension whose bit is set flips the lower bits of
    the first dimension and one whose bit is clear swaps them with it; the Gray
    code of what results, read across the dimensions, is the index.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            up = (x[i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _value_cuts(docs: DataFrame, name: str, cells: int) -> list[str]:
    """Where a string column is cut: the distinct values, whole, in equal numbers a cell. At most ``cells`` - 1 leave Spark."""
    values = docs.select(F.col(name).alias("v")).filter("v IS NOT NULL").distinct().withColumn("one", F.lit(1))
    ranked = prefix(values, ["v"], "one", "values")
    n = ranked.count()
    first = ranked.withColumn("cell", F.floor(F.col("__rank") * cells / F.lit(float(max(1, n))))).groupBy("cell").agg(F.min("v").alias("v"))
    return sorted((r.v for r in first.filter("cell > 0").collect()), key=str.encode)


def hilbert_order(docs: DataFrame, dimensions=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``docs`` with ``curve``, the Hilbert index of its cell (a null lies in cell 0).

    Numbers are cut at their quantiles, strings by their rank among the column's distinct values.
    """
    docs = docs.drop("curve")
    kinds, cells = dict(docs.dtypes), 1 << bits
    numbers = [d for d in dimensions if kinds[d] != "string"]
    steps = [i / cells for i in range(1, cells)]
    cuts = docs.select(*[F.percentile_approx(F.col(d).cast("double"), steps, ACCURACY).alias(d) for d in numbers]).first() if numbers else ()

    def cell(d: str) -> Column:
        if kinds[d] == "string":
            edges, value = [F.lit(v) for v in _value_cuts(docs, d, cells)], F.col(d)
        else:
            edges, value = [F.lit(float(v)) for v in np.unique(np.array(cuts[numbers.index(d)] or [], dtype=float))], F.col(d).cast("double")
        if not edges:
            return F.lit(0)
        return F.coalesce(F.size(F.filter(F.array(*edges), lambda e: e <= value)), F.lit(0))

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in columns], axis=1), bits))

    return docs.withColumn("curve", curve(*[cell(d) for d in dimensions]))


def shard(docs: DataFrame, shards: int = 8, dimensions=DIMENSIONS, also=()) -> DataFrame:
    """Where each row of ``docs`` goes: its dimensions, size, text_crc32, curve, shard and slot, and the columns ``also``.

    Law "rows": shard counts differ by one at most. ``size`` is the UTF-8 bytes
    of the text plus one (null: one). Ties on the curve go by doc_id, then by
    text; rows equal in these are interchangeable, and each has its own place.
    Null dimensions lie in cell 0, null ids come first. An empty table gives no
    rows. Other columns are left out.
    """
    keep = [c for c in dict.fromkeys(("doc_id", *dimensions, *also))]
    narrow = docs.select(
        *keep,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    n = docs.count()
    ranked = prefix(hilbert_order(narrow, dimensions), ["curve", "doc_id", "text_crc32", "size"], "size", "curve")
    # shard k starts at the first rank r with r * shards >= k * n
    k = F.floor(F.col("__rank") * shards / F.lit(max(1, n))) if n * shards >= 1 << 53 else F.expr(f"__rank * {shards} div {max(1, n)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", k.cast("int"))
        .withColumn("slot", (F.col("__rank") - start).cast("long"))
        .drop("__rank", "__before")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, dimensions=DIMENSIONS) -> DataFrame:
    """Write whole rows, one folder per shard in slot order, and return the manifest.

    Rows are numbered once and meet their place by number, so null and repeated ids lose nothing.
    """
    numbered = staged(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered")
    place = shard(numbered, shards, dimensions, ("__rid",))
    rows = numbered.join(place.select("__rid", "shard", "slot", "text_crc32"), "__rid").drop("__rid")
    rows.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return manifest(place, dimensions)


def manifest(place: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """Per shard: rows, bytes, and the least and greatest value of each dimension."""
    spans = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return place.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *spans)


def shards_for(manifest: DataFrame, **ranges) -> DataFrame:
    """Shards that may hold rows with every dimension in its (low, high) range."""
    for d, (low, high) in ranges.items():
        manifest = manifest.filter((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return manifest.select("shard")


def op1_hilbert_shards(spark, sf_dir):
    place = shard(read_table(spark, sf_dir, "documents"))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
