"""The sampler against a plain one that moves customers one by one, and the model as a whole."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import pitman_yor as py

SCHEMA = "doc_id long, text string"
TRAIN = [i for i in range(10_000) if not py.is_held_out(i)]
HELD_OUT = [i for i in range(10_000, 99_999) if py.is_held_out(i)]


def plain_sampler(pairs, firsts, d0, d1, sweeps, burn, rng):
    """Mean predictive probabilities p[ctx][word] by Gibbs moves of one customer at a time, tables and all.

    ``pairs``: Counter of (ctx, word); ``firsts``: Counter of words that sit in the parent directly.
    """
    vocab = sorted({w for _, w in pairs} | set(firsts))
    base = 1 / (len(vocab) + 1)
    root, inner = {w: [] for w in vocab}, defaultdict(list)
    totals = {"c": 0, "t": 0}
    ctx_c, ctx_t = Counter(), Counter()

    def p_root(w):
        return (sum(root[w]) - d0 * len(root[w]) + (1 + d0 * totals["t"]) * base) / (1 + totals["c"])

    def sit(tables, d, opens):
        weigh = [*(n - d for n in tables), opens]
        k = int(np.searchsorted(np.cumsum(weigh), rng.random() * sum(weigh)))
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = int(np.searchsorted(np.cumsum(tables), rng.integers(sum(tables)), side="right"))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def add_root(w):
        totals["t"] += sit(root[w], d0, (1 + d0 * totals["t"]) * base)
        totals["c"] += 1

    def drop_root(w):
        totals["t"] -= leave(root[w])
        totals["c"] -= 1

    def add(u, w):
        if sit(inner[u, w], d1, (1 + d1 * ctx_t[u]) * p_root(w)):
            ctx_t[u] += 1
            add_root(w)
        ctx_c[u] += 1

    def drop(u, w):
        if leave(inner[u, w]):
            ctx_t[u] -= 1
            drop_root(w)
        ctx_c[u] -= 1

    tokens = [k for k, n in pairs.items() for _ in range(n)]
    first = [w for w, n in firsts.items() for _ in range(n)]
    for w in first:
        add_root(w)
    for u, w in tokens:
        add(u, w)
    mean = defaultdict(lambda: np.zeros(len(vocab) + 1))
    tables = Counter()
    for s in range(sweeps):
        for w in first:
            drop_root(w)
            add_root(w)
        for u, w in tokens:
            drop(u, w)
            add(u, w)
        if s >= burn:
            p0 = np.array([*(p_root(w) for w in vocab), (1 + d0 * totals["t"]) * base / (1 + totals["c"])])
            mean[None] += p0
            for u in ctx_c:
                own = np.array([*(max(0, sum(inner[u, w]) - d1 * len(inner[u, w])) if (u, w) in inner else 0 for w in vocab), 0])
                mean[u] += (own + (1 + d1 * ctx_t[u]) * p0) / (1 + ctx_c[u])
            tables.update({k: len(v) for k, v in inner.items()})
    n = sweeps - burn
    return vocab, {u: m / n for u, m in mean.items()}, {k: v / n for k, v in tables.items()}


def own_sampler(pairs, firsts, d0, d1, sweeps, burn):
    """The same by the sweeps of the operator, all words in one bucket."""
    vocab = sorted({w for _, w in pairs} | set(firsts))
    number = {w: np.uint64(1000 + i) << np.uint64(20) for i, w in enumerate(vocab)}
    items = [(number[w], py._context_of(np.array([number[u]]))[0], n) for (u, w), n in pairs.items()] + [(number[w], np.uint64(0), n) for w, n in firsts.items()]
    word, ctx, n = py._collect(*(np.array(x) for x in zip(*items)))
    words, rows = np.unique(word, return_counts=True)
    s = py.Seating.first(py.Plan(1, np.zeros(0, np.uint64), np.zeros(0, np.int64)), words, rows, ctx, n)
    s.once = np.array([((ctx == u) & (n == 1)).sum() for u in s.contexts])

    def law():
        rows = [tuple(r.values()) for b in py._sums([_batch(s)]) for r in b.to_pylist()]
        got = py.law_of(rows, 0, (sum(pairs.values()), 0, 0), None)
        return py.Law(got.customers, got.hot_customers, got.tokens, got.words, d0, d1).settled({a: k for x, a, k in rows if x == 0 and a}, (0, 0))

    mean, tables = defaultdict(lambda: np.zeros(len(vocab) + 1)), np.zeros(len(s.c))
    every = {u: py._context_of(np.array([number[u]]))[0] for u, _ in pairs}
    for i in range(sweeps):
        s.sweep(law(), s.once + np.bincount(s.of, s.t, len(s.contexts)).astype(int), 7, i)
        if i < burn:
            continue
        now = law()  # of the tables as they are now
        p0 = np.r_[now.mass(s.customers(s.t)), now.mass(np.array([0]))] / now.total
        assert p0.sum() == pytest.approx(1)
        mean[None] += p0
        tables += s.t
        for u, h in every.items():
            c, t = np.zeros(len(vocab)), np.zeros(len(vocab))
            for w, x, k in zip(word, ctx, n):
                if x == h:
                    c[np.searchsorted(words, w)], t[np.searchsorted(words, w)] = k, min(k, 1)
            word_of = np.repeat(np.arange(len(words)), s.rows)
            for j in np.flatnonzero(s.contexts[s.of] == h):
                t[word_of[j]] = s.t[j]
            mean[u] += (np.r_[np.maximum(c - d1 * t, 0), 0] + (1 + d1 * t.sum()) * p0) / (1 + c.sum())
    return vocab, {u: m / (sweeps - burn) for u, m in mean.items()}, tables / (sweeps - burn)


def _batch(s):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([s.packed()])], ["body"])


def test_sweeps_agree_with_moves_of_single_customers(monkeypatch):
    monkeypatch.setattr(py, "ROOT_CUSTOMERS", 128)
    monkeypatch.setattr(py, "ROOT_TABLES", 40)
    rng = np.random.default_rng(3)
    pairs, firsts = Counter(), Counter()
    for u in "abcdef":
        for w in rng.choice(list("abcdefghij"), 40, p=np.r_[[0.3, 0.2], np.full(8, 0.0625)]):
            pairs[u, str(w)] += 1
    pairs["a", "z"] = 12  # a word of one context alone
    for w in "aab":
        firsts[w] += 1
    d0, d1 = 0.4, 0.7
    vocab, want, seats = plain_sampler(pairs, firsts, d0, d1, 400, 50, rng)
    own_vocab, got, mine = own_sampler(pairs, firsts, d0, d1, 300, 20)
    assert vocab == own_vocab
    for u in want:
        assert got[u] == pytest.approx(want[u], abs=0.01), u
    assert mine.sum() == pytest.approx(sum(v for k, v in seats.items() if pairs[k] > 1), rel=0.03)


def test_weights_beyond_the_table():
    """At 3,000 customers the saddle point gives what the recursion gives: the ratio of neighbours within 2.5 %."""
    for d in (0.1, 0.5, 0.8, 0.95):
        w, t = py.Weights(d), np.arange(3001)
        row = np.r_[w.table[py.TABLED], np.full(3000 - py.TABLED, -np.inf)]
        for c in range(py.TABLED, 3000):
            row = np.logaddexp(np.r_[-np.inf, row[:-1]], np.log(np.maximum(c - t * d, 1e-300)) + row)
        off = w.log(np.full(2500, 3000), np.arange(1, 2501)) - row[1:2501]
        assert np.abs(np.diff(off)).max() < 0.025 and np.abs(off).max() < 0.1, d


def _law(d=0.6, customers=100_000):
    return py.Law(customers, np.zeros(0, np.int64), customers, 5_000, 0.5, d).settled({1: 3_000, 40: 2_000}, (0, 0))


@pytest.mark.parametrize("c", [2, 7, 256, 300])
def test_tables_are_drawn_from_their_conditional(c):
    """Small pairs and large ones alike: against the distribution by recursion."""
    law, k = _law(), 20_000
    others, n, own = 500, 80, 1
    u = (np.arange(k) + 0.5) / k
    got = np.bincount(law.draw(np.full(k, c), np.full(k, others), np.full(k, n), np.full(k, own), u), minlength=c + 1)[1:] / k
    s = np.full(c + 2, -np.inf)
    s[1] = 0
    for m in range(1, c):
        s = np.logaddexp(np.r_[-np.inf, s[:-1]], np.log(np.maximum(m - np.arange(c + 2) * 0.6, 1e-300)) + s)
    i = np.arange(c)
    p = s[1:c + 1] + np.cumsum(np.log(law.mass(n + i) * (1 + 0.6 * (others + i)) / (law.total - own + i)))
    p = np.exp(p - p.max())
    assert got == pytest.approx(p / p.sum(), abs=0.004)


def test_tables_of_millions_of_customers():
    law = _law(0.5, 10**9)
    c = np.array([10**4, 10**6, 10**8])
    t = law.draw(np.repeat(c, 500), np.full(1500, 10**6), np.full(1500, 10**6), np.ones(1500, int), np.tile((np.arange(500) + 0.5) / 500, 3)).reshape(3, 500)
    assert (1 <= t).all() and (t < c[:, None]).all() and (np.diff(t.mean(axis=1)) > 0).all() and (np.diff(t, axis=1) >= 0).all()


def ask(spark, train, texts, **how):
    """Probabilities of held-out texts after training on others."""
    key = dict(zip(HELD_OUT, texts))
    rows = spark.createDataFrame([*zip(TRAIN, train), *key.items()], SCHEMA)
    return {key[r.doc_id]: 10**r.score for r in py.language_model_scores(rows, **how).collect() if r.doc_id in key}


def test_a_rare_word_is_a_context(spark):
    """"b" is one of 10,000 tokens and always before "c": that helps "c" after "b" and nothing else."""
    train = [" ".join(f"v{i}_{k}" for k in range(50)) for i in range(200)] + ["v0_0 b c v0_1", "v0_2 b c v0_3", "v0_4 b c v0_5"]
    p = ask(spark, train, ["b", "zz", "b c", "zz c", "b v7_7", "zz v7_7"], buckets=3)
    share = p["b"] / p["zz"]  # neither has the end after it
    assert p["b v7_7"] / p["zz v7_7"] == pytest.approx(share)
    assert p["b c"] / p["zz c"] > 50 * share


def test_sums_to_one_where_all_words_are_contexts(spark):
    """Words seen once leave (1 + d) / 2 to the parent, and no end follows them: so the parent can be read off.

    "w" is frequent enough to lie in two of the five buckets.
    """
    rare = [f"v{k}" for k in range(3_000)]
    train = [" ".join(["w", *rare[a:a + 2], "w", *rare[a + 2:a + 10], "w"]) for a in range(0, 3_000, 10)]
    p = ask(spark, train, ["", "w", "w w", "zz", "w zz", *rare, *(f"w {b}" for b in rare)], buckets=5)
    left, end = (1 + 0.95) / 2, p[""]
    w = 1 - end - p["zz"] / end - sum(p[b] for b in rare) / left / end
    end_after_w = p["w"] / w
    total = end_after_w + p["w w"] / w / end_after_w + p["w zz"] / w / end + sum(p[f"w {b}"] for b in rare) / w / left / end
    assert total == pytest.approx(1, abs=1e-6)


def test_scores_do_not_depend_on_the_layout(spark, small, monkeypatch):
    """Blocks, partitions, shuffle partitions: the same scores."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = {r.doc_id: r.score for r in py.language_model_scores(docs, buckets=4).collect()}
    monkeypatch.setattr(py, "BLOCK_TOKENS", 3_000)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        two = {r.doc_id: r.score for r in py.language_model_scores(docs.repartition(5), buckets=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert two == pytest.approx(one, rel=1e-9)


def tokens_of(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), b"\n"]


def test_scores(spark, small, monkeypatch):
    monkeypatch.setattr(py, "BLOCK_TOKENS", 5_000)
    monkeypatch.setattr(py, "BUCKET_BYTES", 50_000)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in py.op3_pitman_yor(spark, small).collect()}
    c = Counter(t for k, x in texts.items() if zlib.crc32(str(k).encode()) % 10 for t in tokens_of(x))
    n, v = sum(c.values()), len(c)
    assert set(got) == set(texts)
    for k, x in texts.items():
        t, r = tokens_of(x), got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 10 == 0, len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.perplexity == pytest.approx(10 ** (-r.score / len(t)))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    schema = "doc_id string, text string, score int, extra int"
    rows = [("1", None, 1, 1), ("2", "", 1, 1), ("3", " \t\n ", 1, 1), ("x4", "one two one two", 1, 1), ("x4", "one two one two", 1, 1), (None, "12 345 !?", 1, 1), ("5", "Lang " * 30_000, 1, 1)]
    got = Counter((r.doc_id, r.n_tokens) for r in py.language_model_scores(spark.createDataFrame(rows, schema)).collect())
    assert got == Counter([("1", 1), ("2", 1), ("3", 1), ("x4", 5), ("x4", 5), (None, 4), ("5", 30_001)])
    assert py.language_model_scores(spark.createDataFrame([], schema)).collect() == []
    alone = py.language_model_scores(spark.createDataFrame([(None, "nothing to learn from")], SCHEMA)).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)
