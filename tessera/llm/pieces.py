"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text under a unigram vocabulary is a longest path.
A giant text is cut into chunks at any place. A boundary's state is how far the
piece that crosses it reaches beyond it, so a chunk is a matrix of best scores
from each state before to each state after it. Max-plus products combine the
matrices associatively, in a tree with a bounded number of children; walking
down again gives every chunk the scores of the states before it. With these a
chunk knows, for each state after it, the state before it on the best path:
such maps compose associatively too, and a second tree gives every chunk its
state after, from which it is traced back by itself. Paths of equal score are
told apart as in one pass over the whole text, by the longest last piece.

The vocabulary is the public piece file, with its scores. Its own library
merges pairs where this model maximises the sum of scores; in unigram mode, on
the same file, that library gives the same segmentation of words.
"""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, attach, group_facts, partitions, read_table, salt_of, slices, staged

SPACE = "▁"
#: Texts over GIANT characters are cut into chunks of CHUNK; FAN matrices meet in one product.
GIANT, CHUNK, FAN = 65_536, 16_384, 32
#: Segments that a Python worker remembers, in each of two generations.
MEMO = 200_000
_SLICE = 1_000_000
_NEW = ["ids", "ids_crc32", "exact"]
#: Stands for a character that no piece has, so that the automaton sees it.
STRANGE = "\uffff"
NONE = -np.inf
_held: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces and scores of a model file, with the best segmentation of a string."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte = [0] * 256
        self.bytes_of = [b""] * n
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                self.id[piece], self.score[piece] = i, model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces must not hold a space but at their start")
        self.reach = max(map(len, self.id))
        #: Score of a character that no piece covers; its bytes stand for it.
        self.unknown = min(self.score.values()) - 10
        self.step: dict[str, float | None] = {p[:k]: None for p in self.id for k in range(1, len(p))}
        self.step |= self.score  # a score, or None for what is only the start of pieces
        self.letters = {c for p in self.id for c in p}
        self.lone = "\n" not in self.letters  # then nothing crosses a line break
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if self.lone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.strange = re.compile("[^" + re.escape("".join(sorted(self.letters))) + "]")
        self.automaton = ahocorasick.Automaton()
        for p, w in self.score.items():
            self.automaton.add_word(p, (len(p), w))
        for c in (self.letters - set(self.score)) | {STRANGE}:
            self.automaton.add_word(c, (1, self.unknown))
        self.automaton.make_automaton()
        self.memo = Memo(self._segments, MEMO)

    @staticmethod
    def of(path: str) -> Vocabulary:
        if path not in _held:
            _held[path] = Vocabulary(path)
        return _held[path]

    def forward(self, s: str, best: list[float], start: int, stop: int) -> list[int]:
        """Raise ``best`` by pieces that start in [start, stop); return where each place's last piece starts.

        -1 marks a place whose score is still the one it was given. Of equal
        scores the earlier start stays.
        """
        n = len(best) - 1
        back = [-1] * (n + 1)
        step, score = self.step, self.score
        for i in range(start, stop):
            b = best[i]
            if b == NONE:
                continue
            if s[i] not in score and b + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = b + self.unknown, i
            for j in range(i + 1, n + 1):
                w = step.get(s[i:j], NONE)
                if w is None:
                    continue
                if w == NONE:
                    break
                if b + w > best[j]:
                    best[j], back[j] = b + w, i
        return back

    def trace(self, s: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids that lead to ``end``, and the given place where they begin."""
        out: list[int] = []
        while (a := back[end]) >= 0:
            i = self.id.get(s[a:end])
            out += [i] if i is not None else [self.byte[c] for c in reversed(s[a:end].encode())]
            end = a
        return out[::-1], end

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Ids (32-bit) of strings that begin and end at forced bounds.

        One pass over all of them, with a character between that no piece has.
        Of pieces that end together the automaton gives the longest first.
        """
        out = []
        for a in range(0, len(segments), 20_000):
            part = segments[a:a + 20_000]
            s = STRANGE.join(part)
            best, back = [0.0] + [NONE] * len(s), [0] * (len(s) + 1)
            for e, (n, w) in self.automaton.iter(self.strange.sub(STRANGE, s)):
                e += 1
                if (b := best[e - n] + w) > best[e]:
                    best[e], back[e] = b, e - n
            sizes = [len(x) for x in part]
            end = len(s)
            found = []
            for n in reversed(sizes):
                first, at, ids = end - n, end, []
                while at > first:
                    i = self.id.get(s[back[at]:at])
                    ids += [i] if i is not None else [self.byte[c] for c in reversed(s[back[at]:at].encode())]
                    at = back[at]
                found.append(array("i", ids[::-1]).tobytes())
                end = first - 1
            out += reversed(found)
        return out

    def bounds(self, s: str) -> list[int]:
        """Places inside ``s`` that no piece crosses: before a run of spaces, and around a line break."""
        out, at = [], s.find(SPACE, 1)
        while at > 0:
            if s[at - 1] != SPACE:
                out.append(at)
            at = s.find(SPACE, at + 1)
        if self.lone:
            at = s.find("\n")
            while at >= 0:
                out += [p for p in (at, at + 1) if 0 < p < len(s)]
                at = s.find("\n", at + 1)
        return sorted(set(out))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        return [np.frombuffer(b"".join(ids), "<i4") for ids in self.memo.values(cut)]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    # -- chunks: ``s`` holds the chunk's ``size`` characters and the next ``reach`` - 1

    def _ends(self, s: str, size: int) -> tuple[int, int] | None:
        inside = [p for p in self.bounds(s) if p <= size]
        return (inside[0], inside[-1]) if inside else None

    def _over(self, s: str, size: int, given: dict[int, float], start: int = 0, stop: int | None = None):
        """best and back after the pieces that start in [start, stop), from the given places' scores."""
        best = [NONE] * (min(len(s), size + self.reach - 1) + 1)
        for d, x in given.items():
            best[d] = x
        return best, self.forward(s, best, start, size if stop is None else stop)

    def matrix(self, s: str, size: int, last: bool) -> np.ndarray:
        """Best scores from the state before the chunk to the state after it, less their maximum."""
        r = self.reach
        m = np.full((r, r), NONE)
        ends = self._ends(s, size)
        outs = 1 if last else r
        if ends is None:
            for d in range(min(r, size)):
                row = self._over(s, size, {d: 0.0}, d)[0][size:size + outs]
                m[d, :len(row)] = row
        else:  # every path passes both bounds; what lies between adds the same to all and so drops out
            a, b = ends
            tail = self._over(s, size, {b: 0.0}, b)[0][size:size + outs]
            for d in range(min(r, a + 1)):
                m[d, :len(tail)] = np.array(tail) + self._over(s[:a], a, {d: 0.0}, d)[0][a]
        return m - m.max() if np.isfinite(m.max()) else m

    def _split(self, s: str, a: int, b: int) -> list[str]:
        cuts = [p for p in self.bounds(s) if a <= p <= b]
        return [s[x:y] for x, y in zip(cuts, cuts[1:])]

    def before(self, s: str, size: int, v: np.ndarray) -> list[int]:
        """For each state after the chunk the one before it, given the scores of those before."""
        given = {d: x for d, x in enumerate(v.tolist()) if x != NONE}
        ends = self._ends(s, size)
        if ends is None:
            best, back = self._over(s, size, given)
            return [self.trace(s, back, size + o)[1] if size + o < len(best) and best[size + o] != NONE else 0 for o in range(self.reach)]
        a = ends[0]
        _, back = self._over(s[:a], a, {d: x for d, x in given.items() if d <= a})
        return [self.trace(s, back, a)[1]] * self.reach

    def chunk(self, s: str, size: int, v: np.ndarray, d_out: int) -> bytes:
        """Ids of the pieces that start in the chunk and lead to its state after."""
        pack = lambda ids: np.array(ids, "<i4").tobytes()
        given = {d: x for d, x in enumerate(v.tolist()) if x != NONE}
        end, ends = size + d_out, self._ends(s, size)
        if ends is None:
            return pack(self.trace(s, self._over(s, size, given)[1], end)[0])
        a, b = ends
        head = self.trace(s, self._over(s[:a], a, {d: x for d, x in given.items() if d <= a})[1], a)[0]
        tail = self.trace(s, self._over(s, size, {b: 0.0}, b)[1], end)[0]
        parts = self._split(s, a, b)
        held = self.memo.hold(set(parts))
        return pack(head) + b"".join([held[p] for p in parts]) + pack(tail)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def through(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of the states after a chunk, less their maximum."""
    out = (v[:, None] + m).max(axis=0)
    return out - out.max()


def chunks_of(text: str, reach: int, chunk: int = CHUNK) -> list[tuple[str, int]]:
    """(characters with those that follow, size) of each chunk; none is shorter than ``reach``."""
    s = SPACE + text.replace(" ", SPACE)
    cuts = list(range(0, len(s), max(chunk, reach)))
    if len(cuts) > 1 and len(s) - cuts[-1] < reach:
        cuts.pop()
    return [(s[a:b + reach - 1], b - a) for a, b in zip(cuts, [*cuts[1:], len(s)])]


def _chunked(path: str, chunk: int):
    def run(batches):
        v = Vocabulary.of(path)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = chunks_of(text, v.reach, chunk)
                for a in range(0, len(parts), 64):
                    some = parts[a:a + 64]
                    ms = [v.matrix(s, n, a + i == len(parts) - 1).tobytes() for i, (s, n) in enumerate(some)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(some)), pa.array(range(a, a + len(some)), pa.int64()),
                        pa.array([s for s, _ in some]), pa.array([n for _, n in some], pa.int32()), pa.array(ms, pa.binary())],
                        ["key", "i", "s", "n", "m"])

    return run


def _matrix(raw: bytes) -> np.ndarray:
    r = int((len(raw) // 8) ** 0.5)
    return np.frombuffer(raw).reshape(r, r)


def _first(group: pd.DataFrame, what: str, value: bytes) -> pd.DataFrame:
    return pd.DataFrame({"key": [group["key"].iloc[0]], "i": [group["i"].iloc[0] // FAN], what: [value]})


def _multiply(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("i")
    m = _matrix(group["m"].iloc[0])
    for raw in group["m"].iloc[1:]:
        m = product(m, _matrix(raw))
    return _first(group, "m", m.tobytes())


def _pass_right(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("i")
    v, out = np.frombuffer(group["v"].iloc[0]), []
    for raw in group["m"]:
        out.append(v.tobytes())
        v = through(v, _matrix(raw))
    return pd.DataFrame({"key": group["key"], "i": group["i"], "v": out})


def _compose(group: pd.DataFrame) -> pd.DataFrame:
    f = None
    for raw in group.sort_values("i")["f"]:  # the map of all: after the last to before the first
        g = np.frombuffer(raw, np.uint8)
        f = g if f is None else f[g]
    return _first(group, "f", f.tobytes())


def _pass_left(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("i", ascending=False)
    d, out = int(group["d_out"].iloc[0]), []
    for raw in group["f"]:
        out.append(d)
        d = int(np.frombuffer(raw, np.uint8)[d])
    return pd.DataFrame({"key": group["key"], "i": group["i"], "d_out": out})


def scan(rows: DataFrame, value: str, combine, state: str, start, spread) -> DataFrame:
    """(key, i, state) of chunks (key, i, value): combine up a tree, spread the state down it.

    Each step's groups have FAN rows at most, whatever the length of a text.
    """
    parent = F.expr(f"i div {FAN}")
    kinds = {"v": "binary", "d_out": "int"}
    levels = [rows]
    while (levels[-1].agg(F.max("i")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("p", parent).groupBy("key", "p").applyInPandas(combine, f"key string, i long, {value} binary")
        levels.append(staged(up, "up"))
    states = levels[-1].select("key", "i", start.alias(state))
    for level in reversed(levels[:-1]):
        below = level.withColumn("p", parent).join(states.withColumnRenamed("i", "p"), ["key", "p"])
        states = staged(below.groupBy("key", "p").applyInPandas(spread, f"key string, i long, {state} {kinds[state]}"), "down")
    return states


def _facts(v: Vocabulary, texts: list[str], ids: list[np.ndarray]) -> tuple[list[int], list[bool]]:
    """CRC-32 of ids as 32-bit numbers, and whether they decode to the text."""
    return [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [v.decode(x.tolist()) == t.replace(SPACE, " ") for t, x in zip(texts, ids)]


def _whole(path: str):
    def run(batches):
        v = Vocabulary.of(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            a, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= _SLICE or i == len(texts) - 1:
                    ids = v.encode(texts[a:i + 1])
                    crc, exact = _facts(v, texts[a:i + 1], ids)
                    ends = np.cumsum([0, *[len(x) for x in ids]], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                    part = b.slice(a, i + 1 - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(crc, pa.int64()), pa.array(exact)], [*b.schema.names, *_NEW])
                    a, size = i + 1, 0

    return run


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids, an array of piece ids (null or empty text: none), ids_crc32, and exact: do they decode to the text?

    A space stands before the text, as the vocabulary wants. U+2581 counts as
    a space, and what no piece covers becomes its UTF-8 bytes. Each row is
    encoded, also where rows repeat a doc_id or a text; columns named ids,
    ids_crc32 or exact are replaced, all others pass. An empty table gives no rows.
    """
    docs = docs.drop(*_NEW)

    @F.pandas_udf("binary")
    def before(s: pd.Series, n: pd.Series, v: pd.Series) -> pd.Series:
        voc = Vocabulary.of(model)
        return pd.Series([np.array(voc.before(t, k, np.frombuffer(x)), np.uint8).tobytes() for t, k, x in zip(s, n, v)])

    @F.pandas_udf("binary")
    def traced(s: pd.Series, n: pd.Series, v: pd.Series, d_out: pd.Series) -> pd.Series:
        voc = Vocabulary.of(model)
        return pd.Series([voc.chunk(t, k, np.frombuffer(x), d) for t, k, x, d in zip(s, n, v, d_out)])

    @F.pandas_udf("ids array<int>, ids_crc32 long, exact boolean")
    def finished(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        ids = [np.frombuffer(b"".join(x), "<i4") for x in parts]
        crc, exact = _facts(Vocabulary.of(model), list(texts), ids)
        return pd.DataFrame({"ids": ids, "ids_crc32": crc, "exact": exact})

    is_giant = F.coalesce(F.length("text") > giant, F.lit(False))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_crc32", T.LongType()), T.StructField("exact", T.BooleanType())])
    small = docs.filter(~is_giant).mapInArrow(_whole(model), schema)
    large = docs.filter(is_giant).withColumn("__key", F.sha2(F.col("text").cast("binary"), 256)).withColumn("__salt", salt_of("doc_id"))
    # equal texts are cut and scored once; the rest of the row waits outside
    texts = large.select(F.col("__key").alias("key"), "text").repartition(partitions(docs.sparkSession), "key").dropDuplicates(["key"])
    cut = staged(texts.mapInArrow(_chunked(model, chunk), "key string, i long, s string, n int, m binary"), "chunks")
    reach = Vocabulary.of(model).reach
    scores = scan(cut.select("key", "i", "m"), "m", _multiply, "v", F.lit(bytearray(np.r_[0.0, np.full(reach - 1, NONE)].tobytes())), _pass_right)
    known = staged(cut.drop("m").join(scores, ["key", "i"]).withColumn("f", before("s", "n", "v")), "known")
    ends = scan(known.select("key", "i", "f"), "f", _compose, "d_out", F.lit(0), _pass_left)
    parts = known.drop("f").join(ends, ["key", "i"]).select("key", "i", traced("s", "n", "v", "d_out").alias("b"))
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "b"))).alias("p")).select(F.col("key").alias("__key"), F.col("p.b").alias("__parts"))
    facts = group_facts(large.select("__key", "__salt"), "__key", "__salt", [F.count("*").alias("__n")]).drop("__n").join(whole, "__key")
    done = attach(large, facts, "__key", "__salt").withColumn("__f", finished("text", "__parts")).select(*docs.columns, "__f.*")
    return small.unionByName(done)


def decode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with decoded, the text that its ids stand for."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = Vocabulary.of(model)
        return pd.Series([None if x is None else v.decode(x.tolist()) for x in ids])

    return docs.drop("decoded").withColumn("decoded", text("ids"))


def op10_pieces(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.col("exact").alias("round_trip"))
