"""Exact dedup behind a two-pass Bloom filter.

Pass one counts every text's hash in a filter whose slots tell "once" from
"twice or more". Pass two lets a row through where one of its slots was used
once only: its text can't have a copy. Only the other rows shuffle and are
settled by their SHA-256.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, attach, group_facts, partitions, read_table, salt_of, staged

HASHES = 4
SLOTS_PER_ROW = 16
#: 64 MB of bits at most, whatever the input; beyond some 34 million rows more
#: rows pass as "possibly repeated", which costs shuffle and changes no result.
MAX_SLOTS = 1 << 29
BLOCK = 1 << 16
_FLUSH = 500_000


def _slots(keys: np.ndarray, m: int) -> np.ndarray:
    h = keys.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([((h + np.uint64(i) * step) & np.uint64(m - 1)) for i in range(HASHES)])


def _count_slots(m: int):
    def run(batches):
        held, size = [], 0

        def flush():
            slots, n = np.unique(np.concatenate(held), return_counts=True)
            block = (slots // BLOCK).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block)) + 1
            offset = (slots % BLOCK).astype(np.uint16)
            rows = [(int(block[a]), offset[a:b].tobytes(), offset[a:b][n[a:b] > 1].tobytes())
                    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(slots)])]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                ["block", "once", "more"])

        for b in batches:
            s = _slots(np.array(b.column(0), dtype=np.int64), m)
            held.append(s)
            size += len(s)
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _merge_slots(batches):
    """Streams the tasks' updates into the blocks of this partition."""
    seen: dict[int, np.ndarray] = {}
    for b in batches:
        for block, once, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            n = seen.setdefault(block, np.zeros(BLOCK, np.uint8))
            i = np.frombuffer(once, np.uint16)
            n[i] = np.minimum(n[i] + 1, 2)
            n[np.frombuffer(more, np.uint16)] = 2
    for block, n in seen.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([np.packbits(n > 1).tobytes()], pa.binary())], ["block", "bits"])


def repeated_filter(keys: DataFrame, rows: int) -> np.ndarray:
    """Bits of the slots that two or more of the long ``keys`` share."""
    m = 1 << min(MAX_SLOTS.bit_length() - 1, max(16, (rows * SLOTS_PER_ROW - 1).bit_length()))
    blocks = (
        keys.mapInArrow(_count_slots(m), "block long, once binary, more binary")
        .repartition(partitions(keys.sparkSession), "block")
        .mapInArrow(_merge_slots, "block long, bits binary")
    )
    bits = np.zeros(m // 8, np.uint8)
    for r in blocks.toLocalIterator():  # MAX_SLOTS / 8 bytes at most
        bits[r.block * (BLOCK // 8):(r.block + 1) * (BLOCK // 8)] = np.frombuffer(r.bits, np.uint8)
    return bits


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the long ``keys`` may be repeated, by the bits of :func:`repeated_filter`: all that are, and a few more."""
    s = _slots(keys, len(bits) * 8)
    hit = (bits[(s >> np.uint64(3)).astype(np.int64)] >> (7 - (s & np.uint64(7))).astype(np.uint8)) & 1
    return hit.reshape(HASHES, -1).all(axis=0)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with text_sha256 of the text, each run of ASCII white space one space; null is the empty text."""
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    return docs.drop("keep_id", "group_size", "kept", "text_sha256").withColumn("text_sha256", F.sha2(norm.cast("binary"), 256))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of ASCII white space became
    one space; null is the empty text. Of a group one row stays: that of the
    smallest doc_id; of rows that repeat it, and of a group whose doc_ids are all
    null, any one. Columns named as the new ones are replaced, all others pass.
    An empty table gives no rows.
    """
    return settle(keyed(docs))


def settle(rows: DataFrame) -> DataFrame:
    """Rows of :func:`keyed` (doc_id, text_sha256 and any others) with keep_id, group_size and kept."""
    spark, names = rows.sparkSession, rows.columns
    rows = rows.withColumn("__key", F.xxhash64("text_sha256"))
    bits = repeated_filter(rows.select("__key"), rows.count())
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe_repeated(key: pd.Series) -> pd.Series:
        b = shared.value
        s = _slots(key.to_numpy(np.int64), len(b) * 8)
        hit = (b[(s >> np.uint64(3)).astype(np.int64)] >> (7 - (s & np.uint64(7))).astype(np.uint8)) & 1
        return pd.Series(hit.reshape(HASHES, -1).all(axis=0))

    flagged = rows.withColumn("__again", maybe_repeated("__key"))
    through = (
        flagged.filter("NOT __again")
        .withColumn("keep_id", F.col("doc_id"))
        .withColumn("group_size", F.lit(1).cast("long"))
        .withColumn("kept", F.lit(True))
    )
    again = flagged.filter("__again").withColumn("__salt", salt_of("doc_id"))
    # by id first, so that a group's facts also tell how many rows bear its least id
    each = again.groupBy("text_sha256", "doc_id", "__salt").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    facts = staged(group_facts(each, "text_sha256", "__salt", [first.alias("__first"), F.sum("n").alias("group_size")]), "facts")
    settled = attach(again, facts, "text_sha256", "__salt").withColumn("keep_id", F.col("__first.doc_id"))
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    tied = mine & (F.col("__first.n") > 1)
    names = [*names, "keep_id", "group_size", "kept"]
    out = through.select(names)
    if facts.filter("__first.n > 1").isEmpty():
        return out.unionByName(settled.withColumn("kept", mine).select(names))
    # rows that repeat both the text and its least id: the first of them stays
    place = F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id"))
    out = out.unionByName(settled.filter(~tied).withColumn("kept", mine).select(names))
    return out.unionByName(settled.filter(tied).withColumn("kept", place == 1).select(names))


def op2_exact_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return settle(staged(keyed(docs).drop("text"), "keyed")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
