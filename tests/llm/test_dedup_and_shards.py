"""Sharding, exact and near dedup, and mixing, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from compare import same
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, hilbert, mixing, registry, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
EDGE = [
    (1, "a b  c", "en", "s", 6), (2, "a b\tc", "en", "s", 5), (3, None, None, None, None), (4, "", "en", None, 0), (5, " \n ", None, "s", 3),
    (6, "a b c", "en", "t", 5), (6, "a b c", "en", "t", 5), (None, "a b c", "en", "t", 5), (7, "word " * 30_000, "en", "t", 150_000), (8, "Ünïcode text", "de", "", 12),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in EDGE], SCHEMA + ", keep_id int, extra string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sql(spark, small):
    for name, sql in registry.oracle_sql().items():
        same(registry.queries()[name](spark, small), sql, small)


def test_hilbert_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = cells[np.argsort(hilbert.hilbert_index(cells, bits))]
        assert sorted(hilbert.hilbert_index(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, docs, shards=8):
    assert len(rows) == docs
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards))
    n = [len(slots[k]) for k in range(shards)]
    assert max(n) - min(n) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(spark, small, edge, nothing):
    rows = registry.queries()["op1_hilbert_shards"](spark, small).collect()
    check_shards(rows, 200)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    place = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in place] == sorted(r.curve for r in rows)
    check_shards(hilbert.shard(edge).collect(), len(EDGE))
    assert hilbert.shard(nothing).collect() == []


def test_manifest_prunes_nothing_that_matches(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    table = hilbert.write_shards(docs, str(tmp_path / "shards"), 32, ("lang", "n_chars")).cache()
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count()
    where = (F.col("lang") == "fr") & F.col("n_chars").between(500, 2000)
    want = {r.shard for r in back.filter(where).select("shard").distinct().collect()}
    got = {r.shard for r in hilbert.shards_for(table, lang=("fr", "fr"), n_chars=(500, 2000)).collect()}
    assert want <= got and len(got) <= 16


def test_written_shards_hold_every_row(spark, edge, tmp_path):
    """Null and repeated ids, equal rows: what is written is what came, each row at a place of its own."""
    hilbert.write_shards(edge, str(tmp_path / "s"), 3, ("lang", "n_chars"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter((r.doc_id, r.text, r.source) for r in edge.collect())
    assert back.select("shard", "slot").distinct().count() == len(EDGE)


def test_whole_strings_are_cut(spark):
    names = [f"https://example.org/wiki/{x}" for x in ("de", "en", "fr")]
    docs = spark.createDataFrame([(i, "x", names[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    cells = {r.source: r.curve for r in hilbert.hilbert_order(docs, ("source", "source")).collect()}
    assert len(set(cells.values())) == 3


def test_rows_without_ids_have_coins_of_their_own(spark):
    rows = [(None, f"one two three {i // 2}", "s") for i in range(1000)] + [(7, "one two three four", "s")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.plan_copies(docs).selectExpr("sum(copies * size) taken", "max(target) target", "max(copies) most").first()
    assert taken.taken == pytest.approx(taken.target, rel=0.05) and taken.most <= 2


def test_exact_dedup_edges(spark, edge, nothing):
    got = exact_dedup.exact_dedup(edge).collect()
    assert len(got) == len(EDGE) and set(edge.columns) <= set(got[0].asDict())
    keep = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert keep == Counter([(1, 1, 5, True), (2, 1, 5, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 1, 5, False), (6, 1, 5, False), (None, 1, 5, False), (7, 7, 1, True), (8, 8, 1, True)])
    assert {r.text_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"a b c").hexdigest()}
    assert exact_dedup.exact_dedup(nothing).collect() == []
    again = spark.createDataFrame([(6, "a"), (6, "a"), (None, "b"), (None, "b")], "doc_id int, text string")
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(again).collect()) == Counter(
        [(6, 6, 2, True), (6, 6, 2, False), (None, None, 2, True), (None, None, 2, False)])


def test_filter_flags_every_repeat_and_few_others(spark):
    keys = spark.range(6000).select(F.xxhash64(F.when(F.col("id") < 500, F.col("id") % 100).otherwise(F.col("id"))).alias("k"))
    bits = exact_dedup.repeated_filter(keys, 6000)
    k = np.array([r.k for r in keys.collect()])
    s = exact_dedup._slots(k, len(bits) * 8)
    hit = ((bits[(s >> np.uint64(3)).astype(int)] >> (7 - (s & np.uint64(7))).astype(np.uint8)) & 1).reshape(exact_dedup.HASHES, -1).all(axis=0)
    often = np.array([v > 1 for v in (Counter(k.tolist())[x] for x in k.tolist())])
    assert hit[often].all() and hit[~often].mean() < 0.05


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= distance:
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


@pytest.mark.parametrize("cell", [1000, 1])
def test_simhash_against_all_pairs(spark, small, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows]
    want = brute_components(ids, fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op5_simhash"](spark, small).collect()}
    assert got == {ids[i]: (f"{fps[i]:016x}", want[i]) for i in range(len(ids))}


@pytest.mark.parametrize("groups", [7, 8, 9])
def test_simhash_links_of_planted_fingerprints(spark, monkeypatch, groups):
    """A chain of fingerprints four bits apart is one component, whatever cell it lies in."""
    monkeypatch.setattr(simhash, "CELL", 5 if groups == 7 else 1000)
    rng = np.random.default_rng(3)
    fps = []
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63)) | 1 << 63
        for _ in range(12):
            fps.append(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
    df = spark.createDataFrame([(simhash._signed(x),) for x in set(fps)], "fp long")
    labels = {r.node & (2**64 - 1): r.label for r in components.components(simhash.links(df, groups)).collect()}
    every = sorted(set(fps))
    want = brute_components(list(range(len(every))), every)
    groups = defaultdict(set)
    for i, x in enumerate(every):
        groups[want[i]].add(labels.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_popcount_bound_drops_pairs_and_loses_none(spark):
    """The distance is that of the counts, by hand; of pairs that share a cell it drops many, and none within four bits."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 400:  # bits within a few segments, and their two bits exchanged
        x = base
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
        fps.add((x & ~3) | (x & 1) << 1 | (x & 2) >> 1)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    placed = simhash.cells(df, 7)
    left, right = placed.withColumnRenamed("fp", "a"), placed.withColumnRenamed("fp", "b")
    met = left.join(right, ["i", "v"]).filter("a < b").select("a", "b", simhash.manhattan("a", "b").alias("m")).distinct().collect()

    def by_hand(a, b):
        return sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))

    unsigned = [(r.a & (2**64 - 1), r.b & (2**64 - 1), r.m) for r in met]
    assert all(m == by_hand(a, b) <= (a ^ b).bit_count() for a, b, m in unsigned)
    kept = {(r.a, r.b) for r in simhash.bounded(placed).distinct().collect()}
    assert kept == {(r.a, r.b) for r in met if r.m <= 4} and len(kept) < len(met)
    signed = sorted(map(simhash._signed, fps))
    near = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert near < kept


def test_simhash_edges(edge, nothing):
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_dedup(edge).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 1), (6, 1), (None, 1), (7, 7), (8, 8)])
    assert simhash.near_dedup(nothing).collect() == []


def test_components_of_a_long_chain(spark):
    n = 300
    got = {r.node: r.label for r in components.components(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()}
    assert got == {i: 0 for i in range(n)}


def test_components_of_stars_take_no_step(spark, monkeypatch):
    kept, keep = [], components.Scratch.keep
    monkeypatch.setattr(components.Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    stars = [(1, 5), (9, 1), (2, 7), (5, 1)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2} and kept == ["links"]
    del kept[:]
    path = [(1, 5), (5, 9), (2, 7)]  # one pair of steps, and none to see that nothing moves
    got = {r.node: r.label for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2} and kept == ["links", "large", "small"]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_mixing(spark, edge, nothing, small):
    rows = mixing.plan_copies(edge).collect()
    assert len(rows) == len(EDGE) and all(r.copies * r.size <= 2 * r.size for r in rows)
    assert mixing.plan_copies(nothing).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = {r.doc_id: r for r in mixing.plan_copies(docs).collect()}
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == Counter({k: r.copies for k, r in plan.items() if r.copies})
    targets = {r.source: r.target for r in plan.values()}
    total = sum(r.size for r in plan.values())
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total


def test_water_filling(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 200), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    weights, size = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 10, "b": 1000, "c": 200, None: 50}
    want, left, pool = {}, set(size), 1.5 * 1260
    while True:
        level = pool / sum(weights[k] for k in left)
        over = {k for k in left if weights[k] * level > 2 * size[k]}
        if not over:
            break
        for k in over:
            want[k] = 2 * size[k]
            pool -= want[k]
        left -= over
    want |= {k: weights[k] * level for k in left}
    assert got == pytest.approx(want)
