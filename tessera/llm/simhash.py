"""SimHash near-dedup: a grid range-join over segment popcounts.

A fingerprint of 64 bits has 32 segments of two bits. The bit counts of the
segments embed it in a grid, where the Manhattan distance of two points never
exceeds the Hamming distance of the fingerprints. The segments form seven
groups or more; at a Manhattan distance of four or less all but four groups agree
in all their counts, so a join on those sets of groups (35 for seven) has every
pair within that range; the distance of the counts drops the pairs beyond it, and
the exact distance of the fingerprints settles the rest. More groups make
narrower cells, at more rows a fingerprint; their number follows from that of
the fingerprints, and every number finds the same pairs.

A cell with very many different fingerprints would cost the square of its
size. Its fingerprints meet at midpoints instead: two lie within four bits
exactly when each is within two bits of a common value, so every fingerprint
links to all values within two bits, and those that share a value are checked
through it. That is linear in the cell.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, group_facts, lower_words_of, read_table, salt_of, slices, staged
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Groups of segments for up to so many fingerprints: at random ones an equal share of pairs meets.
GROUPS = ((2_000_000, 7), (100_000_000, 8), (1 << 62, 9))
#: Pairs are compared in cells of up to this many fingerprints; larger cells go by midpoints.
CELL = 1_000
_PAIRS = 0x5555555555555555


def fingerprint(words: list[bytes], k: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64, as a signed 64-bit number; zero without words."""
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    h = xxhash.xxh64_intdigest
    values = np.array([h(b" ".join(words[i:i + k]), SEED) for i in range(n)], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for a in range(0, n, 4096):
        votes += np.unpackbits(values[a:a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(columns: list[str]):
    def run(batches):
        for b in slices(batches):
            fp = [fingerprint(lower_words_of(t)) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array(fp, pa.int64())], columns + ["fp"])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row."""
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(_fingerprints(["doc_id"]), f"doc_id {kind}, fp long")


def _group_masks(groups: int) -> list[int]:
    """Per group the bits of its segments' counts; segments go round the groups."""
    masks = [0] * groups
    for s in range(32):
        masks[s % groups] |= 3 << (2 * s)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def popcounts(fp: str) -> Column:
    """The bit counts of a fingerprint's segments, as a point of the grid: of a segment's two bits the low one says one or more, the high one two."""
    low, high = F.col(fp).bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def manhattan(a: str, b: str) -> Column:
    """The Manhattan distance of two fingerprints' points, never above their Hamming distance: in this form of the counts, the bits that differ."""
    return F.bit_count(popcounts(a).bitwiseXOR(popcounts(b)))


def bounded(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a cell and lie within DISTANCE by the lower bound, each as often as they share cells."""
    left, right = placed.withColumnRenamed("fp", "a"), placed.withColumnRenamed("fp", "b")
    return left.join(right, ["i", "v"]).filter((F.col("a") < F.col("b")) & (manhattan("a", "b") <= DISTANCE)).select("a", "b")


def cells(distinct: DataFrame, groups: int) -> DataFrame:
    """(fp, cell) for each set of groups that may agree."""
    counts = popcounts("fp")
    masks = [_signed(reduce(or_, some)) for some in combinations(_group_masks(groups), groups - DISTANCE)]
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("i"), F.col("__counts").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    return distinct.withColumn("__counts", counts).select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.i").alias("i"), F.col("k.v").alias("v"))


def _midpoints(batches):
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = np.array([one[i] | one[j] for i, j in combinations(range(64), 2)], dtype=np.uint64)
    flips = np.concatenate([np.zeros(1, np.uint64), one, two])
    for b in batches:
        fp = np.array(b.column(0), dtype=np.int64)
        for a in range(0, len(fp), 64):
            part = fp[a:a + 64]
            mid = (part.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flips))), pa.array(mid.ravel())], ["fp", "mid"])


def links(distinct: DataFrame, groups: int | None = None, keep=staged) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all that lie within DISTANCE bits.

    Ordinary cells give all their pairs. Of those that share a midpoint, and so
    lie within DISTANCE bits of each other, each links to the least: a star
    connects what the pairs would. ``keep`` writes the cells and reads them back.
    """
    if groups is None:
        n = distinct.count()
        groups = next(g for most, g in GROUPS if n <= most)
    placed = keep(cells(distinct, groups), "cells")
    crowded = placed.groupBy("i", "v").count().filter(F.col("count") > CELL).drop("count")
    crowded = keep(crowded, "crowded")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    if crowded.isEmpty():
        return bounded(placed).filter(near)
    sparse = placed.join(crowded, ["i", "v"], "left_anti")
    pairs = bounded(sparse).filter(near)
    dense = placed.join(crowded, ["i", "v"], "left_semi").select("fp").distinct()
    mids = dense.mapInArrow(_midpoints, "fp long, mid long").withColumn("__salt", salt_of("fp"))
    hubs = group_facts(mids, "mid", "__salt", [F.min("fp").alias("a"), F.max("fp").alias("z")]).filter("a < z").drop("z")
    met = attach(mids.withColumnRenamed("fp", "b"), hubs, "mid", "__salt")
    return pairs.unionByName(met.filter("a < b").select("a", "b").distinct())


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row.

    component_id is the smallest doc_id of the rows whose fingerprints are
    reachable by links of DISTANCE bits; null where none of them has a doc_id.
    Texts without words (null, empty, blank) have fingerprint zero and link like
    any other. Texts are read whole, however long; each row is answered, also
    where rows repeat a doc_id or a text. Other columns are left out. An empty
    table gives no rows.
    """
    fps = staged(fingerprints(docs), "fingerprints").withColumn("__salt", salt_of("doc_id"))
    facts = staged(group_facts(fps, "fp", "__salt", [F.min("doc_id").alias("__first")]), "distinct")
    labels = components(links(facts.select("fp")))  # (node, label) of the linked ones only
    named = facts.join(labels, facts.fp == labels.node, "left").withColumn("__c", F.coalesce("label", "fp")).drop("node", "label")
    named = named.withColumn("__csalt", salt_of("fp"))
    least = group_facts(named, "__c", "__csalt", [F.min("__first").alias("component_id")])
    named = attach(named.withColumnRenamed("__salts", "__mine"), least, "__c", "__csalt")
    named = named.select("fp", F.col("__mine").alias("__salts"), "component_id")
    return attach(fps, named, "fp", "__salt").drop("__salt")


def hex_of(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark, sf_dir):
    found = near_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
