"""Spelling variants, packing and vector codes, against SQL, brute force and the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import same

from tessera.llm import codes, packing, variants

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_variants_same_as_sql(spark, small):
    same(variants.op11_spelling_variants(spark, small), variants.OP11_SQL, small)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_variants_against_all_pairs(spark):
    rnd = random.Random(4)
    counted = {"".join(rnd.choice("abé") for _ in range(rnd.randint(7, 9))): rnd.choice((2, 3, 30, 40, 500, 6000)) for _ in range(300)}
    counted |= {"aaaaaaa": 7, "aaaaaaaa": 70, "aaaaaaaaa": 700, "x" * 5000: 2, "x" * 4999: 21, "x" * 2500 + "y" + "x" * 2499: 20}
    got = {r.word: r for r in variants.group_variants(spark.createDataFrame(list(counted.items()), "word string, n long")).collect()}
    form = {}
    for w, n in counted.items():
        near = [v for v in counted if one_apart(w, v)]
        best = min(near, key=lambda v: (-counted[v], v.encode()), default=None)
        form[w] = best if best and counted[best] >= 10 * n else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n, len(near), form[w], counted[form[w]] if form[w] else None)
    for w in counted:
        last = w
        while form[last]:
            last = form[last]
        assert got[w].root == last
    assert got["x" * 5000].form == "x" * 4999 and got["aaaaaaa"].root == "aaaaaaaaa"


def test_words_of_odd_rows(spark):
    rows = [(1, None, 1), (None, "Abcdefgh Abcdefgh ÀBCDEFGHÀ", 2), (2, "", 3), (2, "xABCDEFGH1abcdefgh àbcdefghà ÀBCDEFGHÀ", 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n int")
    want = Counter()
    import re
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "a" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            run = run[:k] + run[k + 1:] if h % 31 == 0 else run
            want[run] += len(run) >= 7
    assert {r.word: r.n for r in variants.words(df).collect()} == {w: n for w, n in want.items() if n >= 2}
    assert variants.group_variants(variants.words(df.limit(0))).count() == 0


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    made, plain = packing.ByteEncoder(BYTES), Tokenizer.from_file(BYTES)
    assert made.plain
    some = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "1", "23", "'s", "'", "é", "ß", "İ", "\x00", "\x1c", "\x85", "\xa0", " ", "　", "漢字", "🙂", "٣", "²", "_", "...", "<|endoftext|>", "ʼn", "а", "​", "́"]
    texts = ["", *("".join(rnd.choice(some) for _ in range(rnd.randint(1, 12))) for _ in range(3_000))]
    texts += ["".join(rnd.choice(["a", "b'", "1", " ", "\n"]) for _ in range(rnd.randint(1, 9))) for _ in range(3_000)]
    assert sum(not made.uneven(t) for t in texts) > 1_000
    for t, ids in zip(texts, made.encode(texts)):
        assert np.frombuffer(ids, made.kind).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def check_packed(rows, ids, capacity):
    """Pieces cover each document once, sequences have no gap and none is padded."""
    by, of = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for k, whole in ids.items():
        at = 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(whole)
    for parts in of.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_packing_of_a_whole_table(spark, small):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in docs.items()}
    check_packed(packing.op12_cost_balanced_packing(spark, small).collect(), ids, 2048)


def test_packing_goes_to_the_lowest_cost():
    rnd = random.Random(2)
    lengths = sorted((rnd.randint(1, 64) for _ in range(60)), reverse=True)
    total, width = sum(lengths), 16
    size = [64] * (total // 64) + [b for b in (32, 16, 8, 4, 2, 1) if total % 64 & b]
    room, cost, want = size[:], [0] * len(size), []
    for i, n in enumerate(lengths):
        at = 0
        while n:
            fit = [j for j in range(len(size)) if room[j] >= n]
            j = min(fit, key=lambda j: (cost[j], j)) if fit else max(range(len(size)), key=lambda j: (room[j], -j))
            m = min(n, room[j])
            want.append((i, at, m, j, size[j] - room[j]))
            room[j], cost[j], at, n = room[j] - m, cost[j] + m * (6 * width + m), at + m, n - m
    assert packing.balanced(lengths, 64, width) == want and not any(room)


def test_packing_of_odd_rows(spark):
    rows = [(None, None, 1), (None, "a b", 2), (3, "", 3), (3, "x " * 9_000, 4), (3, "x " * 9_000, 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, sequence_id int")
    got = packing.pack(df, BYTES, 256).collect()
    assert sorted({r.doc_tokens for r in got if r.doc_id is None}) == [1, 3]
    assert sum(r.length for r in got) == 1 + 3 + 1 + 2 * next(r.doc_tokens for r in got if r.doc_tokens > 100)
    of = defaultdict(int)
    for r in got:
        of[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert all(n == 256 or n & (n - 1) == 0 for n in of.values())
    assert packing.pack(df.limit(0), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, BYTES, 100)


def test_codes_same_as_sql(spark, small):
    same(codes.op13_vector_codes(spark, small), codes.OP13_SQL, small)


def plain_codes(v, entries, rounds):
    n, width = v.shape
    parts = v.reshape(n, 4, width // 4)
    books = parts[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((parts[:, :, None] - books[None]) ** 2).sum(3)
        at = d.argmin(2)
        if r < rounds:
            for p in range(4):
                for e in set(at[:, p].tolist()):
                    books[p, e] = parts[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    return at, np.take_along_axis(d, at[:, :, None], 2)[:, :, 0].sum(1), books


def test_codes_against_all_entries(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 300)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(9, 8))
    x = np.concatenate([centres[rnd.integers(0, 9, 700)] + rnd.normal(size=(700, 8)) * 0.02, np.repeat(centres[:1], 200, 0), rnd.integers(-2, 3, (100, 8)) / 4]).astype(np.float32)
    rnd.shuffle(x)
    rows = [(i, [float(y) for y in v], i % 3 or None) for i, v in enumerate(x)]
    bad = [(-1, None, 1), (-2, [None, *[0.0] * 7], 1), (-3, [float("nan"), *[0.0] * 7], 1), (-4, [float("inf"), *[0.0] * 7], 1), (-5, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(3)
    done, books = codes.compress(df, entries=40)
    at, error, want = plain_codes(np.floor(x.astype(np.float64) * 1024).astype(np.int64), 40, 4)
    assert (books == want).all()
    got = {r.vec_id: r for r in done.collect()}
    assert len(got) == len(rows)
    label = defaultdict(int)
    for i, _, k in rows:
        label[k] += int(error[i])
    for i, _, k in rows:
        assert (got[i].code, got[i].error, got[i].label_error) == ("".join(f"{e:02x}" for e in at[i]), error[i], label[k])


def test_trees_own_balls_and_drop_entries():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-1000, 1000, (12, 4))
    x = centres[rnd.integers(0, 12, 2000)] + rnd.integers(-20, 20, (2000, 4))
    tree = codes.Tree(x)
    tree = codes.Tree.read(x, tree.fields())
    assert sorted(tree.order.tolist()) == list(range(2000)) and tree.b[-1] - tree.a[-1] == 2000
    for k in range(len(tree.a)):
        inside = tree.x[tree.a[k]:tree.b[k]]
        assert (inside.sum(0) == tree.total[k]).all() and np.sqrt(((inside - tree.centre[k]) ** 2).sum(1)).max() <= tree.radius[k] + 1e-6
        if tree.left[k] >= 0:
            assert (tree.a[tree.left[k]], tree.b[tree.left[k]], tree.b[tree.right[k]]) == (tree.a[k], tree.a[tree.right[k]], tree.b[k])
    kinds = list(tree.owned(centres))
    owned = sum(int((tree.b[at] - tree.a[at]).sum()) for kind, at, _ in kinds if kind == "balls")
    assert owned > 1500 and owned + sum(len(at) for kind, at, _ in kinds if kind == "points") == 2000


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(2, [0.5] * 4), (None, [0.25] * 4), (2, [0.25] * 4)], "vec_id int, embedding array<float>")
    done, books = codes.compress(df)
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error, r.label) for r in done.collect()) == [(0, "00000000", 0, 0, None), (2, "00000000", 0, 0, None), (2, "01010101", 0, 0, None)]
    assert books.shape == (4, 3, 1)
    done, books = codes.compress(df.limit(0))
    assert done.count() == 0 and books.size == 0
    for odd in ([(1, [0.5] * 3)], [(1, [0.5] * 4), (2, [0.5] * 8)], [(1, [2e6] * 4)]):
        with pytest.raises(Exception):
            codes.compress(spark.createDataFrame(odd, df.schema))[0].collect()
