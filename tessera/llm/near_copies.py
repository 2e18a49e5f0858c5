"""SimHash near-dedup at a similarity: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Close copies come from the grid join of :mod:`simhash` over fingerprints of 64 bits:
the texts that its links connect are one cell. At 0.8 fingerprints differ in some ten
bits, where the grid would compare nearly all texts. So besides, candidates share one
of 20 bands of five MinHash values (all but 0.04 % of pairs at 0.8 do). Of both kinds,
SimHash fingerprints of 256 bits pass those that can be that similar, and the shingles
themselves decide.

Of a cell's texts each meets the most central one first, that which shares most
cells with others: of many copies of one text, that text. Where this leaves a cell
in several components, its texts meet once more by an exact prefix filter: similar
texts share one of their rarest shingles, so that texts which have a common passage
and much of their own never meet. Every pair of a cell is linked, connected or
compared, or can't be similar. Tables by cell hold eight bytes a text; fingerprints,
then shingles, join pairs alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, bucketed, discard, group_facts, lower_words_of, salt_of, staged, staged_at
from .components import components
from .exact_dedup import in_filter, repeated_filter
from .simhash import links as grid_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Fingerprint bits that may differ. At 0.8 some 39 of 256 do, six more or less: 72 are five and a half times that off.
PRINTS, MAY_DIFFER = 4, 72
#: Buckets in which the shingles of texts that meet again are counted; the counts order them.
BUCKETS = 1 << 16
_RND = np.random.default_rng(42)
_ODD = lambda n: _RND.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES, _FACTORS, _PRINTS = _ODD(SHINGLE), _ODD(BANDS * ROWS), _ODD(PRINTS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle."""
    h = xxhash.xxh64_intdigest
    each = np.fromiter(map(h, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        each = np.array([h(b" ".join(words), SHINGLE)], np.uint64)
        return _mixed(each)
    n = len(each) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += _mixed(each[i:i + n] * _PLACES[i])
    return np.unique(_mixed(total * _PLACES[0]))


def bands(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 1024):
        least = np.minimum(least, (found[a:a + 1024, None] * _FACTORS[None, :]).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(k.tobytes(), i) for i, k in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def prints(found: np.ndarray) -> np.ndarray:
    """Majority bits over the shingles, PRINTS numbers."""
    votes = np.zeros(64 * PRINTS, np.int64)
    for a in range(0, len(found), 4096):
        bits = np.ascontiguousarray(_mixed(found[a:a + 4096, None] * _PRINTS[None, :]))
        votes += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(found), bitorder="little").view("<u8")


def _marks(names: list[str], at: int):
    """The rows as they are, with the text's node (its words), number of shingles, fingerprint and cells."""
    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                nodes, n, marks, cells = [], [], [], []
                for t in part.column(at).to_pylist():
                    words = lower_words_of(t)
                    found = shingles(words)
                    nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                    n.append(len(found))
                    marks.append(prints(found).view(np.int64))
                    cells.append(bands(found).view(np.int64))
                wide = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(x[0])), pa.array(np.concatenate(x))) for x in (marks, cells)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(n, pa.int64()), *wide], [*names, "__node", "__n", "__print", "__cells"])

    return run


def _sets(batches):
    for b in batches:
        for start in range(0, b.num_rows, 500):
            part = b.slice(start, 500)
            sets = [(shingles(lower_words_of(t)) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], ["node", "set"])


def _grid_cells(nodes: DataFrame) -> DataFrame:
    """(cell, node): nodes whose first 64 bits of fingerprint the grid join connects share a cell; their Hamming distance is bounded by their popcounts'."""
    prints_, scratch = nodes.select(F.col("p")[0].alias("fp"), "node").withColumn("__salt", salt_of("node")), Scratch()
    facts = scratch.keep(group_facts(prints_, "fp", "__salt", []), "prints")
    labels = components(grid_links(facts.select("fp"), keep=scratch.keep)).withColumnRenamed("node", "fp")
    near = facts.join(labels, "fp", "left").withColumn("cell", F.xxhash64(F.lit(BANDS), F.coalesce("label", "fp"))).drop("label")
    found = staged(attach(prints_, near, "fp", "__salt").select("cell", "node"), "grid")
    scratch.clear()
    return found


def _alike(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that can be similar enough, by their sizes and fingerprints."""
    about = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("p").alias(f"p_{c}"))
    salted = pairs.withColumn("__salt", salt_of("b"))
    # a central text is in many pairs
    one = group_facts(salted, "a", "__salt", []).join(about("a"), "a")
    both = attach(salted, one, "a", "__salt").join(about("b"), "b")
    differ = sum((F.bit_count(F.col("p_a")[i].bitwiseXOR(F.col("p_b")[i])) for i in range(PRINTS)), F.lit(0))
    a, b = F.col("n_a"), F.col("n_b")
    return both.filter((F.least(a, b) >= SIMILARITY * F.greatest(a, b)) & (differ <= MAY_DIFFER)).select("a", "b")


def _shingle_sets(marked: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): 32 bits of each shingle's hash of the wanted nodes."""
    rows = nodes.join(wanted, "node", "left_semi").select(F.col("first.__rid").alias("__rid"))
    return marked.join(rows, "__rid", "left_semi").select("__node", "text").mapInArrow(_sets, "node long, set array<int>")


def _verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b): the pairs of nodes whose shingles are similar enough."""
    salted = pairs.withColumn("__salt", salt_of("b"))
    one = group_facts(salted, "a", "__salt", []).join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = attach(salted, one, "a", "__salt").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return scratch.keep(both.filter(common * 1.0 >= SIMILARITY * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def _counts(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle in each of BUCKETS buckets of shingles: what comes to the driver is bounded by them."""
    found = sets.select(F.explode("set").alias("s")).groupBy(F.pmod("s", F.lit(BUCKETS)).alias("at")).agg(F.count("*").alias("n"))
    found, n = found.toArrow(), np.zeros(BUCKETS, np.int64)
    n[found["at"].to_numpy()] = found["n"].to_numpy()
    return n


def _keys(shingles_: np.ndarray) -> np.ndarray:
    """Long keys of 32-bit shingles, for the filter of those that several sets have."""
    return _mixed(shingles_.view(np.uint32).astype(np.uint64) * _PLACES[1]).view(np.int64)


def _all_keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_keys(b.column(0).flatten().to_numpy(zero_copy_only=False)))], ["key"])


def _beginnings(counts, repeated):
    """(s, node, n, reach) of the rarest shingles of each set, the rarest first.

    In one order of all shingles, two sets that are similar enough and first meet at the i-th of n and the j-th of m
    share n - i and m - j at most. So m is 2.25 (n - i) - n at most, the reach, and of two sets the smaller one reaches
    the larger. A shingle that the filter knows once is in no other set: such ones come first, and none is returned.
    """
    def run(batches):
        n_of, bits = counts.value, repeated.value
        for b in batches:
            out = []
            for node, found in zip(*(c.to_pylist() for c in b.columns)):
                s = np.array(found, np.int32)
                rare = np.where(in_filter(bits, _keys(s)), n_of[s.astype(np.int64) % BUCKETS], 0)
                order = np.lexsort((s, rare))[:int((1 - SIMILARITY) * len(s) + 1e-9) + 1]
                i = np.flatnonzero(rare[order])
                reach = ((1 + 1 / SIMILARITY) * (len(s) - i) - len(s) + 1e-9).astype(np.int64)
                out.append((s[order[i]], np.full(len(i), node), np.full(len(i), len(s)), reach))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int32(), *[pa.int64()] * 3))], ["s", "node", "n", "reach"])

    return run


def _meetings(scratch: Scratch, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different labels that can be similar enough: they share one of their rarest shingles.

    Of a shingle's nodes those outside the label that most of them have meet the others.
    """
    send, total = sets.sparkSession.sparkContext.broadcast, sets.agg(F.coalesce(F.sum(F.size("set")), F.lit(0)).alias("n")).first().n
    repeated = send(repeated_filter(sets.select("set").mapInArrow(_all_keys, "key long"), total))  # 64 MB at most
    begun = sets.mapInArrow(_beginnings(send(_counts(sets)), repeated), "s int, node long, n long, reach long").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    begun = scratch.keep(begun.withColumn("__salt", salt_of("node")), "beginnings")
    parts = begun.groupBy("s", "label").agg(F.count("*").alias("k"), F.max((F.col("reach") >= F.col("n")).cast("int")).alias("i"), F.collect_set("__salt").alias("t"))
    open_ = parts.groupBy("s").agg(F.count("*").alias("labels"), F.max("i").alias("i"), F.max_by("label", F.struct("k", "label")).alias("main"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("__salts"))
    open_ = scratch.keep(open_.filter("labels > 1 AND i = 1").select("s", "main", "__salts"), "open")
    some = scratch.keep(attach(begun, open_, "s", "__salt"), "some")
    rest = some.filter("label <> main").join(open_.select("s", "__salts"), "s")
    rest = rest.select("s", F.struct("node", "n", "reach", "label").alias("r"), F.explode("__salts").alias("__salt"))
    # the smaller set reaches the larger, and is reached by it
    met = some.select("s", "__salt", "node", "n", "reach", "label").join(rest, ["s", "__salt"]).filter("label <> r.label AND n <= r.reach AND r.n <= reach")
    return met.select(F.least("node", "r.node").alias("a"), F.greatest("node", "r.node").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__rid``, a number of the row, and ``__kept`` (true or null), see :func:`drop_near_copies`."""
    names, scratch, spark = docs.columns, Scratch(), docs.sparkSession
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "__node long, __n long, __print array<long>, __cells array<long>"])
    marked, unnumbered = staged_at(docs.mapInArrow(_marks(names, names.index("text")), kinds), "marked")
    # from here on row numbers stand; texts lie in buckets of them, so that they move once, whatever is joined to them
    marked, _ = bucketed(marked.withColumn("__rid", F.monotonically_increasing_id()), "__rid", "numbered")
    discard(spark, unnumbered)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__rid")).alias("first")
    nodes = marked.groupBy(F.col("__node").alias("node")).agg(first, F.min("__n").alias("n"), F.first("__print").alias("p"), F.first("__cells").alias("cells"))
    nodes = scratch.keep(nodes, "nodes")

    placed = nodes.select(F.explode("cells").alias("cell"), "node").unionByName(_grid_cells(nodes)).withColumn("__salt", salt_of("node"))
    facts = scratch.keep(group_facts(placed, "cell", "__salt", [F.count("*").alias("m")]).filter("m > 1"), "shared")
    members = scratch.keep(attach(placed, facts, "cell", "__salt"), "members")
    weights = members.groupBy("node").agg(F.sum("m").alias("w"))
    centres = members.join(weights, "node").groupBy("cell").agg(F.max(F.struct("w", "node")).alias("centre")).select("cell", F.col("centre.node").alias("a"))
    centres = centres.join(facts.select("cell", "__salts"), "cell")
    stars = attach(members, centres, "cell", "__salt").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    stars = scratch.keep(stars, "stars")
    pairs = scratch.keep(_alike(nodes, stars), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = _verified(scratch, pairs, scratch.keep(_shingle_sets(marked, nodes, wanted), "sets"))
    labels = components(links)

    # texts of cells that lie in several components meet once more, at their rarest shingles
    at = members.select("cell", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    at = scratch.keep(at.withColumn("__salt", salt_of("node")), "labelled")
    cells = group_facts(at, "cell", "__salt", [F.min("label").alias("one"), F.max("label").alias("last")]).filter("one <> last").select("cell", "__salts")
    wanted = attach(at, cells, "cell", "__salt").select("node").distinct()
    sets = scratch.keep(_shingle_sets(marked, nodes, wanted), "sets")
    more = _meetings(scratch, sets, labels)
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(_verified(scratch, scratch.keep(_alike(nodes, more.join(tested, ["a", "b"], "left_anti")), "candidates"), sets))

    labels = components(links)
    firsts = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = firsts.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.__rid").alias("__rid"), F.lit(True).alias("__kept"))
    kept = staged(kept, "kept")
    scratch.clear()
    return marked.drop("__node", "__n", "__print", "__cells").join(kept, "__rid", "left")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of rows whose texts links of similarity 0.8 or more connect, the one of least doc_id; null ids come last.

    Decided row by row, so rows that repeat a doc_id with another text stay, and
    of rows with equal text one stays, whatever their ids. Words are compared
    lower-cased. Null, empty and blank texts are equal: they have no words. A
    text under five words is one shingle. All columns pass, but for names
    beginning with ``__``. An empty table gives none.
    """
    return near_copies(docs).filter("__kept").select(docs.columns)
