"""The pipeline's near-duplicate stage against brute force."""

from collections import defaultdict
from itertools import combinations

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_brute_force(rows):
    """Row numbers that stay of (doc_id, text)."""
    grams = []
    for _, t in rows:
        w = (t or "").lower().split()
        grams.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = grams[i], grams[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sorted(min(((rows[i][0] is None, rows[i][0] or 0), rows[i][1] or "") for i in g) for g in groups.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)
    return sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_pairs_of_similarity_08_go_and_others_stay(spark):
    """Of 200 words one to four runs of ten change: five-word Jaccard from 0.87 down to 0.55."""
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in rnd.integers(0, 5_000, 200)]
        rows.append((2 * i, " ".join(words)))
        for r in range(i % 4 + 1):
            words[20 + 45 * r:30 + 45 * r] = [f"x{k}" for k in rnd.integers(0, 5_000, 10)]
        rows.append((2 * i + 1, " ".join(words)))
    want = kept_by_brute_force(rows)
    assert 70 < len(want) < 110
    assert kept(spark, rows) == want


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    """200 variants of one text, many under 0.8 to each other but linked through others; 100 texts around one passage."""
    rnd = np.random.default_rng(6)
    base = [f"w{k}" for k in rnd.integers(0, 5_000, 300)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(int(rnd.integers(1, 4))):
            at = int(rnd.integers(0, 290))
            words[at:at + 6] = [f"y{k}" for k in rnd.integers(0, 5_000, 6)]
        rows.append((i, " ".join(words)))
    for i in range(100):
        rows.append((1000 + i, " ".join([*passage, *(f"z{k}" for k in rnd.integers(0, 5_000, int(rnd.integers(8, 80))))])))
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_rows_not_ids_decide(spark):
    """Repeated and null ids, null and short texts, clashing names."""
    text = " ".join(f"w{k}" for k in range(100))
    near = text.replace("w50", "other")
    rows = [(5, text), (9, near), (9, "an unrelated text of more than five words"), (None, text + " end"), (None, "alone " * 9), (7, None), (8, ""), (3, " \t"), (4, "short"), (4, "Short"), (4, "long " * 40_000)]
    want = kept_by_brute_force(rows)
    got = kept(spark, rows)
    assert [k for k, _ in got] == [k for k, _ in want] and len(got) == 6
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "doc_id int, text string, a int").withColumn("node", near_copies.F.lit("x"))
    assert near_copies.drop_near_copies(docs).columns == docs.columns and near_copies.drop_near_copies(docs).count() == 2
    assert near_copies.drop_near_copies(docs.limit(0)).collect() == []


def test_the_grid_join_finds_close_copies_without_a_common_band(spark, monkeypatch):
    """No two texts share a band: copies whose fingerprints lie within four bits still meet, in the grid."""
    def apart(found):
        return np.array([near_copies.xxhash.xxh64_intdigest(found.tobytes(), i) for i in range(20)], np.uint64)

    monkeypatch.setattr(near_copies, "bands", apart)
    rnd = np.random.default_rng(7)
    rows = []
    for i in range(20):
        words = [f"w{k}" for k in rnd.integers(0, 5_000, 3_000)]
        for r in range(3):
            words[40 * r] = f"x{i}"
            rows.append((10 * i + r, " ".join(words)))
    marks = [near_copies.prints(near_copies.shingles(t.encode().split()))[0] for _, t in rows]
    assert all(int(marks[3 * i] ^ marks[3 * i + r]).bit_count() <= 4 for i in range(20) for r in (1, 2))
    assert kept(spark, rows) == kept_by_brute_force(rows) and len(kept(spark, rows)) == 20
