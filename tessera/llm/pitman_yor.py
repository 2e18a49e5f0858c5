"""Language-model scores by a hierarchical Pitman-Yor process.

A context is the word before. Every word that occurs as a context in training has
a restaurant of its own; all of them share one parent, the restaurant of single
words, whose base is uniform over the vocabulary and one unknown word. Customers
are tokens; who opens a table in a context sends a customer to the parent. Gibbs
sweeps seat the customers of one word in one context anew, given all others: they
leave, and the number of their tables is drawn from its conditional distribution
(the parent's own tables are summed out). The scores average the predictive
probabilities of several sweeps.

Everything about a word (its counts in all contexts, its tables) lies in one
bucket, so its customers in the parent are counted anew after each draw; a
frequent word is dealt over several buckets by its contexts. The customers and
tables of the context restaurants are sums over buckets: each bucket adds up its
own rows of a context, the sums meet in a table dealt by context, and each bucket
is told the totals of the contexts it has. Within a sweep a bucket sees the other
buckets' sums as they were before it. Draws are seeded by word and context, so
they do not depend on how rows or buckets are laid out.

Documents are read in blocks. A block sends to each bucket the block's distinct
pairs of word and context with the documents they occur in; the bucket sends back
what they add to each document's score.
"""

from __future__ import annotations

import gc
import zlib
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, read_table, staged_at

#: Tokens and documents of a block at most; a document is never split.
BLOCK_TOKENS, BLOCK_DOCS = 1_500_000, 1 << 19
#: Bytes of text whose pairs make one bucket: what a task holds does not grow with the input.
BUCKET_BYTES = 16_000_000
BURN_IN, SAMPLES = 2, 3
STRENGTH_ROOT, STRENGTH_CONTEXT = 1.0, 1.0
#: One text in so many, by its hash, tells which words are dealt over several buckets.
PLAN_SHARE = 16
END = b"\n"  # no word holds a line break
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each number's lowest bytes first: like bytes side by side compress better."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], "<i8")
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(head.tobytes() + b"".join(planes), 1)


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        kind = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as the bytes of their differences, the lowest bytes first: they pack well."""
    d = np.diff(x, prepend=np.uint64(0))
    k = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return np.r_[np.uint8(k), np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).ravel()]


def _rising(raw: np.ndarray) -> np.ndarray:
    k = int(raw[0])
    d = np.zeros(((len(raw) - 1) // k, 8), np.uint8)
    d[:, :k] = raw[1:].reshape(k, -1).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def _thin(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")


def _starts(n: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n.astype(np.int64))[:-1]].astype(np.int64) if len(n) else np.zeros(0, np.int64)


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(word: np.ndarray, ctx) -> np.ndarray:
    """One number for a pair of a word and a context."""
    return _mix(word ^ _mix((np.asarray(ctx).astype(np.uint64) + np.uint64(1)) * _STEP))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


# -- blocks of documents


class Block:
    """Tokens of some documents by local word number, words in the order of their hashes."""

    def __init__(self, docs: list, lists: list[pa.ListArray]):
        self.docs, n = docs, len(docs)
        self.lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        # words hold no line break, so one split gives them all; an empty one stands before white space at either end
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")[0].as_py().encode("utf-8", "replace").split(b"\n")[:len(coded.dictionary)]
        ids = coded.indices.to_numpy()
        real = np.array([bool(w) for w in words] + [True])[ids] if b"" in words else None
        if real is not None:
            doc = np.repeat(np.arange(n), self.lengths)
            self.lengths, ids = np.bincount(doc[real], minlength=n), ids[real]
        words.append(END)
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter(map(h, words), np.uint64, len(words))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.lengths = self.lengths + 1
        ends = np.cumsum(self.lengths) - 1
        self.hashes, self.ids = hashes[order], np.empty(len(ids) + n, np.int64)
        inner = np.ones(len(self.ids), bool)
        inner[ends] = False
        self.ids[inner], self.ids[ends] = rank[ids], rank[-1]

    def train(self) -> np.ndarray:
        return np.array([not is_held_out(d) for d in self.docs])


def _blocks(batches, emit):
    docs, lists, size = [], [], 0
    for b in batches:
        for a in range(0, b.num_rows, 500):
            part = b.slice(a, 500)
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(1), "")))
            docs += part.column(0).to_pylist()
            lists.append(words)
            size += len(words.flatten()) + part.num_rows
            if size >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                yield from emit(Block(docs, lists))
                docs, lists, size = [], [], 0
    if docs:
        yield from emit(Block(docs, lists))


def _context_of(words: np.ndarray) -> np.ndarray:
    """A word as a context: 48 bits of its hash, so that lists of contexts pack well; 0 stands for none."""
    return np.maximum(words >> np.uint64(16), np.uint64(1))


@dataclass(frozen=True)
class Plan:
    """What all tasks know: the buckets, and over how many of them a frequent word is dealt."""

    buckets: int
    hot: np.ndarray  # sorted hashes, two a bucket at most
    slices: np.ndarray

    def bucket_of(self, words: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Buckets of pairs of a word and a context: all of a word lies in one, but for a frequent word."""
        at = _find(self.hot, words)
        pieces = np.maximum(np.where(at >= 0, np.r_[self.slices, 0][at], 0), 1).astype(np.uint64)
        piece = (_mix(ctx) >> np.uint64(33)) % pieces
        return ((words + piece * _STEP) % np.uint64(self.buckets)).astype(np.int64)


def _word_counts(batches):
    def emit(block: Block):
        n = np.bincount(block.ids, minlength=len(block.hashes))
        yield pa.RecordBatch.from_arrays([pa.array(block.hashes.view(np.int64)), pa.array(n)], ["word", "n"])

    return _blocks(batches, emit)


def make_plan(docs: DataFrame, buckets: int | None) -> Plan:
    """As many buckets as the bytes of text ask for. A word with half a bucket's share of the
    tokens or more is dealt over several; which words these are is read off the texts whose hash
    is a multiple of PLAN_SHARE. That decides where pairs lie, and no count."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = buckets or max(1, -(-size // BUCKET_BYTES))
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(PLAN_SHARE)) == 0)
    counts, path = staged_at(some.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    rows = counts.filter(F.col("n") * (2 * buckets) >= total).collect()  # two a bucket at most
    discard(docs.sparkSession, path)
    hot = np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))
    of = {r.word: r.n for r in rows}
    n = np.array([of[w] for w in hot.view(np.int64).tolist()], float)
    return Plan(buckets, hot, np.ceil(n * buckets / max(1, total)).astype(np.int64))


_POSTINGS = "bucket long, block long, body binary, docs binary"


def _postings(plan: Plan, scores: bool):
    """Rows for the buckets: a block's distinct pairs.

    A body: words, pairs a word, contexts (0: none), and of each pair the place of its context and
    its count in training. For scores, in the place of counts, the documents of each pair with
    their counts; and one row (bucket below 0) with the block's documents.
    """
    def run(batches):
        number = iter(range(1 << 24))
        task = TaskContext.get().partitionId()

        def emit(block: Block):
            me, n = (task << 24) | next(number), len(block.docs)
            words, ids = block.hashes, block.ids
            contexts = np.r_[np.uint64(0), _context_of(words)]
            ctx = np.r_[0, ids[:-1] + 1]
            ctx[_starts(block.lengths)] = 0
            width = len(contexts)
            key = ids * width + ctx
            if scores:
                item, count = np.unique(key * n + np.repeat(np.arange(n), block.lengths), return_counts=True)
                item, doc = item // n, item % n
            else:  # pairs of training, then the others with none
                train = np.repeat(block.train(), block.lengths)
                item, count = np.unique(key[train], return_counts=True)
                rest = np.setdiff1d(np.unique(key[~train]), item, assume_unique=True)
                item, count = np.r_[item, rest], np.r_[count, np.zeros(len(rest), np.int64)]
                order = np.argsort(item, kind="stable")
                item, count = item[order], count[order]
            first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            size = np.diff(np.r_[first, len(item)])
            word, c = item[first] // width, item[first] % width
            bucket = plan.bucket_of(words[word], contexts[c])
            # numbers rise with hashes, so the rows of a bucket stay in the order of word and context
            order = np.argsort(bucket.astype(np.uint16) if plan.buckets < 1 << 16 else bucket, kind="stable")
            bucket, word, c, size, first = bucket[order], word[order], c[order], size[order], first[order]
            if scores:  # rows of a pair lie side by side from its first
                at = np.repeat(first - _starts(size), size) + np.arange(int(size.sum()))
                doc, count = doc[at], count[at]
            else:
                count = count[first]
            ends = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            at = np.r_[0, np.cumsum(size)]
            rows = []
            for a, b in zip(ends[:-1], ends[1:]):
                new = np.flatnonzero(np.r_[True, word[a + 1:b] != word[a:b - 1]])
                own, of = np.unique(c[a:b].astype(np.int32), return_inverse=True)
                pairs = [_steps(words[word[a:b][new]]), _thin(np.diff(np.r_[new, b - a])), _steps(contexts[own]), _thin(of)]
                if scores:
                    rows.append((int(bucket[a]), me, pack(*pairs), pack(_thin(size[a:b]), _thin(doc[at[a]:at[b]]), _thin(count[at[a]:at[b]]))))
                else:
                    rows.append((int(bucket[a]), me, pack(*pairs, _thin(count[a:b])), None))
            if scores:
                names = pa.array(block.docs, pa.string())
                raw = pa.BufferOutputStream()
                with pa.ipc.new_stream(raw, pa.schema([("doc", pa.string()), ("n", pa.int64())])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([names, pa.array(block.lengths)], ["doc", "n"]))
                rows.append((-1 - me, me, None, raw.getvalue().to_pybytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:a + 256]], k) for i, k in enumerate(kinds)], ["bucket", "block", "body", "docs"])

        yield from _blocks(batches, emit)

    return run


# -- what a bucket knows: all its pairs (the table), and what sweeps change (the seating)


def _collect(word: np.ndarray, ctx: np.ndarray, n: np.ndarray):
    """Sums of n by (word, context), sorted, with a row of the parent (context 0) for each word."""
    distinct = np.unique(word)
    word, ctx, n = np.r_[word, distinct], np.r_[ctx, np.zeros(len(distinct), np.uint64)], np.r_[n, np.zeros(len(distinct), np.int64)]
    order = np.lexsort((ctx, word))
    word, ctx, n = word[order], ctx[order], n[order]
    if not len(word):
        return word, ctx, n
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1])])
    return word[first], ctx[first], np.add.reduceat(n, first)


def _items(raw: bytes):
    """Word and context of each pair of a body, and what else it has."""
    words, rows, contexts, of, *more = unpack(raw)
    return np.repeat(_rising(words), rows), _rising(contexts)[of], *more


@dataclass
class Seating:
    """Customers and tables of a bucket's words and of the pairs seen more than once.

    Per word: its place among the frequent ones (from 1; 0: none), the customers of the parent that
    stay (tokens without a context and pairs seen once), and its pairs seen oftener. The words that
    have such pairs; the contexts they have; for each context the pairs of all buckets seen once.
    Per pair the place of its context, customers and tables; and the tables of the samples.
    """

    hot: np.ndarray
    stays: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    contexts: np.ndarray
    once: np.ndarray
    of: np.ndarray
    c: np.ndarray
    t: np.ndarray
    samples: list[np.ndarray]

    def packed(self) -> bytes:
        thin = [_thin(x) for x in (self.once, self.of, self.c, self.t, *self.samples)]
        return pack(_thin(self.hot), _thin(self.stays), _thin(self.rows), _steps(self.words), _steps(self.contexts), *thin)

    @classmethod
    def of_bytes(cls, raw: bytes) -> Seating:
        hot, stays, rows, words, contexts, once, of, c, t, *samples = unpack(raw)
        wide = [x.astype(np.int64) for x in (once, of, c, t)]
        return cls(hot, stays.astype(np.int64), rows.astype(np.int64), _rising(words), _rising(contexts), *wide, [x.astype(np.int64) for x in samples])

    @classmethod
    def first(cls, plan: Plan, words, rows, ctx, n) -> Seating:
        """All customers of a pair at one table."""
        start = _starts(rows)
        often = (n > 1) & (ctx > 0)
        stays = n[start] + np.add.reduceat((n == 1) & (ctx > 0), start, dtype=np.int64)
        pairs = np.add.reduceat(often, start, dtype=np.int64)
        own, of = np.unique(ctx[often], return_inverse=True)
        return cls(_find(plan.hot, words) + 1, stays, pairs, words[pairs > 0], own, np.zeros(len(own), np.int64), of, n[often], np.ones(int(often.sum()), np.int64), [])

    def customers(self, t: np.ndarray) -> np.ndarray:
        """Customers of the parent by word, of this bucket: those that stay and the tables of the pairs."""
        at = np.r_[0, np.cumsum(t)]
        end = np.cumsum(self.rows)
        return self.stays + at[end] - at[end - self.rows]

    def sweep(self, law: Law, tables: np.ndarray, seed: int, number: int) -> None:
        """Seat all pairs anew; ``tables``: those of all pairs in each context, before this sweep.

        The pairs of a word follow each other, those with most customers first: the first ones singly,
        then in groups of a fifth of those before; after each group the word's customers in the parent
        are counted anew.
        """
        word = np.repeat(np.arange(len(self.rows)), self.rows)
        n = self.customers(self.t)
        n = np.where(self.hot > 0, np.r_[0, law.hot_customers][self.hot], n)
        place = np.empty(len(word), np.int64)
        place[np.lexsort((np.arange(len(word)), -self.c, word))] = np.arange(len(word)) - np.repeat(_starts(self.rows), self.rows)
        turn = np.where(place < 5, place, 5 + np.floor(np.log(np.maximum(place, 5) / 5) / np.log(1.2))).astype(np.int64)
        key = _key(np.repeat(self.words, self.rows[self.rows > 0]), self.contexts[self.of])
        u = (_mix(key + _mix(np.array([(seed << 20) + number + 1], np.uint64))) >> np.uint64(11)).astype(float) / (1 << 53)
        order = np.argsort(turn, kind="stable")
        first = np.r_[np.flatnonzero(np.diff(turn[order], prepend=-1)), len(order)] if len(order) else [0]
        others = tables[self.of] - self.t
        for a, b in zip(first[:-1], first[1:]):
            i = order[a:b]
            w, old = word[i], self.t[i]
            new = law.draw(self.c[i], others[i], n[w] - old, old, u[i])
            np.add.at(n, w, new - old)
            self.t[i] = new


def _count(plan: Plan):
    """A bucket's table: words, rows a word, contexts, places of contexts, counts; and its first seating.

    Pairs without a training token have rows too, as scores ask for their context's totals.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        word, ctx, n = _collect(*[np.concatenate(x) for x in zip(*[_items(raw) for raw in group["body"]])])
        words, rows = np.unique(word, return_counts=True)
        own, of = np.unique(ctx, return_inverse=True)
        table = pack(_steps(words), _thin(rows), _steps(own), _thin(of), _thin(n))
        once = [int(((n == i) & (ctx > 0)).sum()) for i in (1, 2)]
        return pd.DataFrame([(int(group["bucket"].iloc[0]), table, Seating.first(plan, words, rows, ctx, n).packed(), int(n.sum()), *once)],
                            columns=["bucket", "body", "seating", "tokens", "once", "twice"])

    return run


# -- sums over all buckets by context

_SENT = "g int, bucket long, body binary"


def _send(bucket: int, groups: int, contexts: np.ndarray, asks: np.ndarray, sums: list[np.ndarray]):
    """Rows (g, bucket, body) by group of contexts: whether the sums are asked back, and the own sums."""
    g = ((contexts >> np.uint64(16)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    first = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else np.zeros(0, int)
    rows = [(int(g[a]), bucket, pack(_steps(contexts[a:b]), asks[a:b], *[_thin(x[a:b]) for x in sums])) for a, b in zip(first[:-1], first[1:])]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["g", "bucket", "body"])


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    """Adds up what buckets sent about the contexts of a group, and answers each in the order of its question."""
    bodies = [unpack(x) for x in group["body"]]
    contexts = [_rising(b[0]) for b in bodies]
    _, of = np.unique(np.concatenate(contexts), return_inverse=True)
    sums = [np.bincount(of, np.concatenate([b[i] for b in bodies])).astype(np.int64) for i in range(2, len(bodies[0]))]
    out, at = [], 0
    for bucket, b, x in zip(group["bucket"], bodies, contexts):
        mine = of[at:at + len(x)][b[1]]
        at += len(x)
        if len(mine):
            out.append((int(group["g"].iloc[0]), int(bucket), pack(*[_thin(s[mine]) for s in sums])))
    return pd.DataFrame(out, columns=["g", "bucket", "body"])


def _answers(rows: pd.DataFrame) -> list[np.ndarray]:
    """Sums for all contexts of a bucket, in their order."""
    bodies = [unpack(x) for x in rows.sort_values("g")["body"]]
    return [np.concatenate([b[i] for b in bodies]).astype(np.int64) for i in range(len(bodies[0]))] if bodies else []


def _ask_first(groups: int):
    """Pairs seen once and pairs seen oftener by context, for the contexts of the seating."""
    def run(batches):
        for b in batches:
            for bucket, table, seating in zip(*[b.column(i).to_pylist() for i in range(3)]):
                _, _, contexts, of, n = unpack(table)
                contexts = _rising(contexts)
                sums = [np.bincount(of, w, len(contexts)).astype(np.int64) for w in (n == 1, n > 1)]
                yield _send(bucket, groups, contexts, np.isin(contexts, Seating.of_bytes(seating).contexts), sums)

    return run


def _ask_again(groups: int):
    """Tables by context of the pairs seen more than once."""
    def run(batches):
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Seating.of_bytes(raw)
                k = len(s.contexts)
                yield _send(bucket, groups, s.contexts, np.ones(k, bool), [np.bincount(s.of, s.t, k).astype(np.int64)])

    return run


def _ask_last(groups: int, samples: int):
    """Customers and pairs seen once by context, for all contexts of the table."""
    def run(batches):
        for b in batches:
            for bucket, table in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, _, contexts, of, n = unpack(table)
                contexts = _rising(contexts)
                k = len(contexts)
                sums = [np.bincount(of, w, k).astype(np.int64) for w in (n, n == 1)]
                yield _send(bucket, groups, contexts, np.ones(k, bool), sums + [np.zeros(k, int)] * samples)

    return run


def _tell_last(groups: int):
    """Tables by context of the pairs seen more than once, in the samples."""
    def run(batches):
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Seating.of_bytes(raw)
                k = len(s.contexts)
                none = np.zeros(k, int)
                yield _send(bucket, groups, s.contexts, np.zeros(k, bool), [none, none, *[np.bincount(s.of, x, k).astype(np.int64) for x in s.samples]])

    return run


def _exchange(sent: DataFrame) -> DataFrame:
    return sent.groupBy("g").applyInPandas(_meet, _SENT)


# -- the distribution of tables


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if low.any():
        z = x[low]
        out[low] -= np.log(np.prod([z + i for i in range(8)], axis=0))
    return out


def _log_rise(x, t):
    """Log of x (x + 1) ... (x + t - 1)."""
    x, t = np.asarray(x, float), np.asarray(t, float)
    near = x <= 1e4 * t
    out = t * np.log(x + np.maximum(t - 1, 0) / 2)
    if near.any():
        x, t = (np.broadcast_to(v, out.shape)[near] for v in (x, t))
        out[near] = _log_gamma(x + t) - _log_gamma(x)
    return out


#: Up to TABLED customers the weights below come from their recursion, beyond from their saddle point, whose error is read off at FITTED.
TABLED, FITTED = 256, 1024


class Weights:
    """Logs of the generalised Stirling numbers: the weight of all seatings of c customers at t tables."""

    def __init__(self, discount: float):
        self.d = d = discount
        s = np.full((TABLED + 1, TABLED + 1), -np.inf)
        s[1, 1] = 0.0
        t = np.arange(TABLED + 1)
        for c in range(1, TABLED):
            stay = np.log(np.maximum(c - t * d, 1e-300)) + s[c]
            s[c + 1] = np.logaddexp(np.r_[-np.inf, s[c, :-1]], np.where(s[c] > -np.inf, stay, -np.inf))
        self.table = s
        # they are the coefficients of powers of g(x) = (1 - (1 - x)^d) / d; by the ratio c / t, the x where its powers weigh most
        self.grid = np.geomspace(1e-12, 200, 20_000)
        x, r = -np.expm1(-self.grid), self._ratio(self.grid)
        self.log_ratio = np.log(np.maximum(r - 1, (1 - d) / 2 * x * 1e-3))
        small = self.grid < 1e-5
        self.log_ratio[small] = np.log((1 - d) / 2 * self.grid[small])
        self.log_ratio = np.maximum.accumulate(self.log_ratio)
        row, t = np.r_[s[TABLED], np.full(FITTED - TABLED, -np.inf)], np.arange(FITTED + 1)
        for c in range(TABLED, FITTED):
            row = np.logaddexp(np.r_[-np.inf, row[:-1]], np.log(np.maximum(c - t * d, 1e-300)) + row)
        k = np.arange(1.0, FITTED * 7 // 8)
        self.scale, self.off = np.log(k) - d * np.log(FITTED), row[1:len(k) + 1] - self._saddle(np.full(len(k), float(FITTED)), k)

    def _ratio(self, s):
        return self.d * -np.expm1(-s) * np.exp((1 - self.d) * s) / -np.expm1(-self.d * s)

    def _saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The approximation at the saddle point; its error depends on t / c^d alone."""
        d, ratio = self.d, c / t
        s = np.exp(np.interp(np.log(np.maximum(ratio - 1, 1e-12)), self.log_ratio, np.log(self.grid)))
        x = -np.expm1(-s)
        g = -np.expm1(-d * s) / d
        spread = ratio - ratio**2 + x**2 * (1 - d) * np.exp((2 - d) * s) / g
        return _log_gamma(c + 1) - _log_gamma(t + 1) + t * np.log(g) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * np.maximum(spread, 1e-9))

    def _few(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For t well below c^d: the series of (1 - (1 - x)^d)^t in powers of (1 - x)^d, by the ratio of gamma functions for large c."""
        total, binomial = np.zeros(c.shape), np.ones(c.shape)
        for j in range(1, 5 if self.d > 0.5 else 9 if self.d > 0.25 else 40):
            a = self.d * j
            binomial = binomial * np.maximum(t - j + 1, 0) / j
            term = binomial * np.exp(-(1 + a) * np.log(c - a / 2)) * (float(np.exp(_log_gamma(np.array([1 + a]))[0])) * np.sin(np.pi * a) / np.pi)
            total += term if j % 2 else -term
        return np.log(np.maximum(total, 1e-300)) - t * np.log(self.d)

    def log(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For c over TABLED; t from 1 to c."""
        c, t = np.asarray(c, float), np.asarray(t, float)
        scale = np.log(t) - self.d * np.log(c)
        out = self._saddle(c, t) + np.interp(scale, self.scale, self.off, right=0.0)
        few = scale < self.scale[0]
        if few.any():
            wide = np.broadcast_to(_log_gamma(c + 1), t.shape)[few] - _log_gamma(t[few] + 1)
            out[few] = self._few(np.broadcast_to(c, t.shape)[few], t[few]) + wide
        return out


@cache
def weights(discount: float) -> Weights:
    return Weights(discount)


ROOT_CUSTOMERS, ROOT_TABLES = 4096, 256
_SIZES = np.array([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 160, 192, TABLED])


@cache
def root_masses(discount: float, base: float, more: float) -> np.ndarray:
    """[n]: what a word with n customers weighs in the parent, its tables summed out.

    A new table weighs ``base``, and ``more`` more for each that the word has. By recursion: the
    weight of n customers at k tables grows by (n - d k) if the next joins one, by base + more k if not.
    """
    p, out = np.zeros(ROOT_TABLES), np.zeros(ROOT_CUSTOMERS)
    p[0] = 1.0
    k = np.arange(ROOT_TABLES)
    for n in range(ROOT_CUSTOMERS):
        grown = p * np.maximum(n - discount * k, 0) if n else np.zeros(ROOT_TABLES)
        grown[1:] += p[:-1] * (base + more * k[:-1])
        out[n] = grown.sum()
        p = grown / out[n]
    return out


@dataclass(frozen=True)
class Law:
    """All that sweeps and scores must know of the whole: the parent's totals and the discounts."""

    customers: int
    hot_customers: np.ndarray  # of the frequent words
    tokens: int
    words: int
    discount_root: float
    discount_context: float
    base: float = 0.0
    total: float = 1.0

    @cached_property
    def masses(self) -> np.ndarray:
        return root_masses(self.discount_root, self.base, self.discount_root / (self.words + 1))

    def mass(self, n: np.ndarray) -> np.ndarray:
        """What words with n customers weigh in the parent; ``total`` is the sum over all words and the unknown one.

        The number of tables settles as customers grow, so beyond the table the rest stays the same.
        """
        last = ROOT_CUSTOMERS - 1
        return np.where(n <= last, self.masses[np.minimum(n, last)], n + (self.masses[last] - last))

    def settled(self, seen: dict[int, int], more: tuple[int, int]) -> Law:
        """With base and total that fit words of so many customers (customers: words; words and customers beyond the table)."""
        n, k = np.array([*seen], np.int64), np.array([*seen.values()], float)
        law, tables = self, float(self.words)
        for _ in range(4):
            base = (STRENGTH_ROOT + self.discount_root * tables * (1 - 1 / max(1, self.words))) / (self.words + 1)
            law = Law(self.customers, self.hot_customers, self.tokens, self.words, self.discount_root, self.discount_context, base)
            last = ROOT_CUSTOMERS - 1
            total = float((law.mass(n) * k).sum()) + more[1] + more[0] * (law.masses[last] - last)
            # mass = n + base + (more - d) tables, by the recursion
            tables = (self.customers + base * self.words - total) / (self.discount_root * self.words / (self.words + 1)) if self.words else 0.0
        return Law(self.customers, self.hot_customers, self.tokens, self.words, self.discount_root, self.discount_context, law.base, total + float(law.mass(np.array([0]))[0]))

    @cached_property
    def log_masses(self) -> np.ndarray:
        return np.r_[0.0, np.cumsum(np.log(self.masses))]

    def _log_mass_run(self, n, t):
        """Log of what t more customers of a word that has n weigh in the parent; n of one column."""
        last, rest = ROOT_CUSTOMERS, self.masses[-1] - (ROOT_CUSTOMERS - 1)
        out = np.empty(t.shape)
        many = n[:, 0] >= last
        if many.any():
            out[many] = _log_rise(n[many] + rest, t[many])
        if not many.all():
            m, k = n[~many], n[~many] + t[~many]
            out[~many] = self.log_masses[np.minimum(k, last).astype(np.int64)] - self.log_masses[m.astype(np.int64)]
            over = k > last
            if over.any():
                out[~many] += np.where(over, _log_rise(last + rest, np.maximum(k - last, 0)), 0.0)
        return out

    def draw(self, c, others, n, own, u) -> np.ndarray:
        """Tables of pairs with c customers, given all else: ``others``, the tables of other pairs in the
        context; n, the word's other customers in the parent; own, those of the pair's own tables that leave it;
        u, uniform numbers.

        t tables weigh: the seatings of c customers at t tables, times for each table what opening one
        weighs in the context, and what its customer weighs in the parent.
        """
        t = np.ones(len(c), np.int64)
        kind = np.searchsorted(_SIZES, c)
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(len(_SIZES) + 1))
        d, w = self.discount_context, weights(self.discount_context)
        for size, a, b in zip(_SIZES.tolist(), ends[:-1], ends[1:]):
            i = np.arange(size)
            for x in range(a, b, max(1, 500_000 // size)):
                at = order[x:min(b, x + max(1, 500_000 // size))]
                each = self.mass(n[at][:, None] + i) * (STRENGTH_CONTEXT + d * (others[at][:, None] + i)) / (self.total - own[at][:, None] + i)
                p = np.cumsum(np.log(each), axis=1) + w.table[c[at], 1:size + 1]
                p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
                t[at] = np.minimum(1 + (p < (u[at] * p[:, -1])[:, None]).sum(axis=1), c[at])
        large = order[ends[-1]:]
        for x in range(0, len(large), 512):
            at = large[x:x + 512]
            t[at] = self._draw_large(w, *(v[at].astype(float)[:, None] for v in (c, others, n, own)), u[at])
        return t

    def _draw_large(self, w: Weights, c, others, n, own, u) -> np.ndarray:
        d = self.discount_context

        def log_p(t):
            opened = t * np.log(d) + _log_rise(STRENGTH_CONTEXT / d + others, t)
            return w.log(c, t) + opened + self._log_mass_run(n, t) - _log_rise(self.total - own, t)

        # where the weight lies: ever closer grids, to what is within e^-40 of the best
        part = np.linspace(0, 1, 48)[None, :]
        grid = np.round(np.exp(part * np.log(c)))
        for _ in range(4):
            p = log_p(grid)
            near = p > p.max(axis=1, keepdims=True) - 40
            low, high = near.argmax(axis=1), near.shape[1] - 1 - near[:, ::-1].argmax(axis=1)
            rows = np.arange(len(grid))
            a, b = grid[rows, np.maximum(low - 1, 0)], grid[rows, np.minimum(high + 1, grid.shape[1] - 1)]
            grid = np.round(a[:, None] + (b - a)[:, None] * part)
        step = np.maximum(1.0, (b - a + 1) / 192)
        edge = a[:, None] + step[:, None] * np.arange(192)  # cells [edge, edge + step)
        middle = np.minimum(np.floor(edge + step[:, None] / 2), b[:, None])
        p = log_p(np.maximum(middle, 1))
        p = np.where(edge <= b[:, None], np.exp(p - p.max(axis=1, keepdims=True)), 0.0)
        sums = np.cumsum(p, axis=1)
        goal = u * sums[:, -1]
        cell = np.minimum((sums < goal[:, None]).sum(axis=1), 191)
        rows = np.arange(len(cell))
        inside = 1 - (sums[rows, cell] - goal) / np.maximum(p[rows, cell], 1e-300)
        return np.clip(np.floor(edge[rows, cell] + step * np.clip(inside, 0, 1 - 1e-9)), 1, c[:, 0]).astype(np.int64)


def _sums(batches):
    """(what, at, n): words by customers of the parent (0), words and customers beyond the table (1), and customers
    of each frequent word (2), which the others leave out."""
    for b in batches:
        for raw in b.column(0).to_pylist():
            s = Seating.of_bytes(raw)
            n = s.customers(s.t)
            plain = n[s.hot == 0]
            few = np.bincount(plain[plain < ROOT_CUSTOMERS], minlength=1)
            many = plain[plain >= ROOT_CUSTOMERS]
            at = np.flatnonzero(few)
            what = np.r_[np.zeros(len(at), int), 1, 1, np.full(int((s.hot > 0).sum()), 2)]
            where = np.r_[at, 0, 1, s.hot[s.hot > 0]]
            much = np.r_[few[at], len(many), many.sum(), n[s.hot > 0]]
            yield pa.RecordBatch.from_arrays([pa.array(what.astype(np.int32)), pa.array(where.astype(np.int64)), pa.array(much.astype(np.int64))], ["what", "at", "n"])


def law_of(rows, hot_words: int, fixed: tuple[int, int, int], before: Law | None) -> Law:
    """From rows (what, at, n) of :func:`_sums`; the discounts are those of the first counts."""
    seen = {at: n for what, at, n in rows if what == 0 and at > 0}
    many = [sum(n for what, at, n in rows if (what, at) == (1, i)) for i in (0, 1)]
    hot = np.zeros(hot_words, np.int64)
    for what, at, n in rows:
        if what == 2:
            hot[at - 1] = n
    one, two = seen.get(1, 0), seen.get(2, 0)
    for n in hot[hot > 0].tolist():
        if n < ROOT_CUSTOMERS:
            seen[n] = seen.get(n, 0) + 1
        else:
            many = [many[0] + 1, many[1] + n]
    words = sum(seen.values()) + many[0]
    customers = sum(k * n for k, n in seen.items()) + many[1]
    # the usual estimate from how many types have one and two customers
    d = lambda n1, n2: min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    discounts = (before.discount_root, before.discount_context) if before else (d(one, two), d(*fixed[1:]))
    return Law(customers, hot, fixed[0], words, *discounts).settled(seen, tuple(many))


def totals(seating: DataFrame, plan: Plan, fixed: tuple[int, int, int], before: Law | None = None) -> Law:
    """Sums over all buckets: at most ROOT_CUSTOMERS rows and one a frequent word."""
    rows = seating.select("body").mapInArrow(_sums, "what int, at long, n long").groupBy("what", "at").agg(F.sum("n").alias("n")).collect()
    return law_of([tuple(r) for r in rows], len(plan.hot), fixed, before)


def _sweep(law: Law, number: int, seed: int, keep: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["bucket", "body"])
        s, told = Seating.of_bytes(left["body"].iloc[0]), _answers(right)
        if told:
            if number == 0:
                s.once = told[0]
            s.sweep(law, s.once + told[-1], seed, number)
        if keep:
            s.samples.append(s.t.copy())
        return pd.DataFrame([(int(left["bucket"].iloc[0]), s.packed())], columns=["bucket", "body"])

    return run


# -- scores


def _score(samples: list[Law], hot_tokens: np.ndarray):
    """What each posting adds: rows (block, body) of documents, model and base scores and known tokens."""
    last = samples[-1]
    smooth = np.log10(last.tokens + 0.1 * (last.words + 1))

    def parameters(known: pd.DataFrame):
        """Sorted keys of all pairs with the mean of their probabilities, and how often their words are in training."""
        words, rows, contexts, place, n = unpack(known["body"][known["g"] == -2].iloc[0])
        s = Seating.of_bytes(known["body"][known["g"] == -1].iloc[0])
        customers, once, *tables = _answers(known[known["g"] >= 0])
        words, ctx, n = _rising(words), _rising(contexts)[place], n.astype(np.int64)
        total = np.add.reduceat(n, _starts(rows))
        total = np.where(s.hot > 0, np.r_[0, hot_tokens][s.hot], total)
        more = (n > 1) & (ctx > 0)
        mean = np.zeros(len(n))
        for law, t, all_tables in zip(samples, s.samples, tables):
            own = np.where(s.hot > 0, np.r_[0, law.hot_customers][s.hot], s.customers(t))
            p = np.repeat(law.mass(own) / law.total, rows)
            mine = np.minimum(n, 1)
            mine[more] = t
            opens = STRENGTH_CONTEXT + law.discount_context * (once + all_tables)
            mean += np.where(ctx > 0, (np.maximum(n - law.discount_context * mine, 0) + opens[place] * p) / (customers + STRENGTH_CONTEXT)[place], p)
        keys = _key(np.repeat(words, rows), ctx)
        order = np.argsort(keys)
        return keys[order], mean[order] / len(samples), np.repeat(total, rows)[order]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and left["bucket"].iloc[0] < 0:  # the documents of a block
            out = [(block, True, docs) for block, docs in zip(left["block"], left["docs"])]
        elif len(left):
            keys, means, counts = parameters(right)
            for block, body, docs in zip(left["block"], left["body"], left["docs"]):
                word, ctx = _items(body)
                size, doc, count = unpack(docs)
                at = np.searchsorted(keys, _key(word, ctx))
                each, n = np.log10(means[at]), counts[at]
                plain = np.log10(n + 0.1) - smooth
                found, of = np.unique(doc, return_inverse=True)
                add = [np.bincount(of, np.repeat(x, size) * count, len(found)) for x in (each, plain, n > 0)]
                out.append((block, False, pack(_thin(found), add[0], add[1], _thin(add[2].astype(np.int64)))))
        return pd.DataFrame(out, columns=["block", "names", "body"])

    return run


def _hot_tokens(hot: np.ndarray):
    """(at, n): training tokens of frequent words."""
    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                words, rows, _, _, n = unpack(raw)
                at = _find(hot, _rising(words))
                total = np.add.reduceat(n.astype(np.int64), _starts(rows))
                yield pa.RecordBatch.from_arrays([pa.array(at[at >= 0].astype(np.int32)), pa.array(total[at >= 0])], ["at", "n"])

    return run


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with their sums."""
    with pa.ipc.open_stream(group["body"][group["names"]].iloc[0]) as stream:
        about = stream.read_all()
    parts = [unpack(x) for x in group["body"][~group["names"]]]
    docs = np.concatenate([p[0] for p in parts]).astype(np.int64)
    s, b, k = (np.bincount(docs, np.concatenate([p[i] for p in parts]), about.num_rows) for i in (1, 2, 3))
    return pd.DataFrame({"doc_id": about.column(0).to_pylist(), "n_tokens": about.column(1).to_numpy(), "n_known": k.astype(np.int64), "score": s, "base_score": b})


def release(spark) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def language_model_scores(docs: DataFrame, buckets: int | None = None, seed: int = 42, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row.

    The model learns from rows whose crc32 of doc_id as text is no multiple of
    ten (a null doc_id counts as held out) and scores all. A text is its
    lower-cased words and one end; an empty or null one is the end alone. Rows
    that repeat a doc_id or a text are scored one by one, and each is learned
    from. doc_id may be of any type that text can be cast to; other columns are
    left out. An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    plan = make_plan(docs, buckets)
    groups = plan.buckets
    sent = docs.mapInArrow(_postings(plan, False), _POSTINGS).select("bucket", "body")
    counted, _ = staged_at(sent.groupBy("bucket").applyInPandas(_count(plan), "bucket long, body binary, seating binary, tokens long, once long, twice long"), "counted")
    del sent
    release(spark)
    fixed = tuple(counted.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "once", "twice")]).first())
    hot = {r.at: r.n for r in counted.select("body").mapInArrow(_hot_tokens(plan.hot), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    hot_tokens = np.array([hot.get(i, 0) for i in range(len(plan.hot))], np.int64)

    table = counted.select("bucket", "body")
    seating, path = counted.select("bucket", F.col("seating").alias("body")), None
    law, laws = totals(seating, plan, fixed), []
    for number in range(burn_in + samples):
        asked = seating.mapInArrow(_ask_again(groups), _SENT) if number else counted.select("bucket", "body", "seating").mapInArrow(_ask_first(groups), _SENT)
        swept = seating.groupBy("bucket").cogroup(_exchange(asked).groupBy("bucket")).applyInPandas(_sweep(law, number, seed, number >= burn_in), "bucket long, body binary")
        old, (seating, path) = path, staged_at(swept, "seating")
        del asked, swept
        if old:
            discard(spark, old)
        release(spark)
        law = totals(seating, plan, fixed, law)
        if number >= burn_in:
            laws.append(law)

    asked = table.mapInArrow(_ask_last(groups, samples), _SENT).unionByName(seating.mapInArrow(_tell_last(groups), _SENT))
    known = table.select(F.lit(-2).alias("g"), "bucket", "body").unionByName(seating.select(F.lit(-1).alias("g"), "bucket", "body")).unionByName(_exchange(asked))
    postings = docs.mapInArrow(_postings(plan, True), _POSTINGS)
    sums = postings.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(_score(laws, hot_tokens), "block long, names boolean, body binary")
    each = sums.groupBy("block").applyInPandas(_gather, "doc_id string, n_tokens long, n_known long, score double, base_score double")
    held = F.crc32(F.coalesce(F.col("doc_id"), F.lit("")).cast("binary")) % 10 == 0
    return each.select(
        F.col("doc_id").cast(kind).alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", F.lit(law.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op3_pitman_yor(spark, sf_dir):
    return language_model_scores(read_table(spark, sf_dir, "documents"))
