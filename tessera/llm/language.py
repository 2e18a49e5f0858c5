"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams, with document
frequencies over all training rows. Weights are learned by
follow-the-regularised-leader with an elastic-net penalty on a bounded sample,
which leaves most of them zero; one temperature, fitted on rows kept aside,
calibrates the scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, slices

UNKNOWN = "und"
#: Hashed n-grams of one to NGRAM characters; letters as such, the rest as one space.
BUCKETS, NGRAM = 1 << 15, 3
#: Rows that the classifier is fitted on at most, of each language an equal part, and n-grams of such a row, those of most
#: weight. A language takes two rows, one to learn from and one aside, so half as many languages are learned; of more, those
#: with the most rows.
MAX_TRAIN, MAX_FEATURES = 4_000, 4_096
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.001
#: One row in this many of the sample is kept aside to fit the temperature.
ASIDE = 5


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower case where that is one character."""
    n = 0x110000
    alpha, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for i in range(0x32000):
        c = chr(i)
        if c.isalpha():
            alpha[i] = True
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
    return alpha, lower


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the BUCKETS n-grams; None where the text has no letter."""
    alpha, lower = _letters()
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4")
    letter = alpha[codes]
    if not letter.any():
        return None
    codes = np.where(letter, lower[codes], 32).astype(np.uint32)
    codes = codes[letter | np.r_[True, letter[:-1]]]
    codes = np.r_[np.uint32(32), codes] if codes[0] != 32 else codes
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h, total = np.zeros(len(codes), np.uint32), None
    for n in range(1, min(NGRAM, len(codes)) + 1):
        h = (h[: len(codes) - n + 1] + codes[n - 1:]) * np.uint32(0x9E3779B1) + np.uint32(n)
        counted = np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift, minlength=BUCKETS)
        total = counted if total is None else total + counted
    return total


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of doc_id as text is a multiple of five; so is a null doc_id's."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _document_frequencies(batches):
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in slices(batches):
        for t in b.column(0).to_pylist():
            n += 1
            if (c := ngram_counts(t)) is not None:
                df += c > 0
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, df[at]], pa.int64())], ["bucket", "n"])


@dataclass
class Sparse:
    """Weights other than zero, bucket by bucket: those of bucket b are at starts[b] to starts[b + 1]."""
    starts: np.ndarray
    classes: np.ndarray
    values: np.ndarray

    def times(self, at: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        n = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[at] - ends + n, n) + np.arange(ends[-1] if len(at) else 0)
        return np.bincount(self.classes[where], self.values[where] * np.repeat(x, n), minlength=k)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    sparse: Sparse | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    @property
    def weights(self) -> np.ndarray:
        """All weights, BUCKETS x languages, those that are zero included."""
        out = np.zeros((BUCKETS, len(self.languages)), np.float32)
        out[np.repeat(np.arange(BUCKETS), np.diff(self.sparse.starts)), self.sparse.classes] = self.sparse.values
        return out

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        return at, (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.sparse.times(at, x, len(self.languages)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or self.sparse is None or (counts := ngram_counts(text)) is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.features(counts)) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 penalties."""

    def __init__(self, rows: int, classes: int):
        self.z = np.zeros((rows, classes), np.float32)
        self.n = np.zeros((rows, classes), np.float32)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        dense = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, dense, 0.0)

    def update(self, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def sparse(self, rows: int, block: int = 1024) -> Sparse:
        """The weights of the first ``rows`` buckets, a block of them at a time."""
        n, classes, values = [], [], []
        for a in range(0, rows, block):
            w = self.weights(slice(a, min(rows, a + block)))
            i, j = np.nonzero(w)
            n.append(np.bincount(i, minlength=len(w)))
            classes.append(j.astype(np.int32))
            values.append(w[i, j].astype(np.float32))
        return Sparse(np.r_[0, np.cumsum(np.concatenate(n))], np.concatenate(classes), np.concatenate(values))


def train(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Fit weights and temperature on rows of (buckets, values, class)."""
    k = len(model.languages)
    number = [0] * k
    fit, aside = [], []
    for r in rows:  # of every language one row in ASIDE
        (fit if number[r[2]] % ASIDE else aside).append(r)
        number[r[2]] += 1
    leader = Ftrl(BUCKETS + 1, k)  # the last row is the bias
    for _ in range(EPOCHS):
        for at, x, y in fit:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = leader.weights(at)
            miss = softmax(x @ w)
            miss[y] -= 1
            leader.update(at, x[:, None] * miss[None, :], w)
    model.sparse, model.bias = leader.sparse(BUCKETS), leader.weights(BUCKETS).astype(np.float32)
    if aside and k > 1:
        z = np.array([model.logits(at, x) for at, x, _ in aside], dtype=float)
        y = np.array([c for _, _, c in aside])
        # smoothed targets: as if one more row of each language had gone wrong, so that separable rows do not mean certainty
        goal = np.full((len(y), k), 1 / (len(y) + k))
        goal[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + k)
        grid = np.geomspace(0.01, 10, 160)
        loss = [-(goal * np.log(softmax(z / t) + 1e-12)).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _features(idf: np.ndarray):
    """Arrow rows (lang, text, __o) as (lang, at, x, __o): the MAX_FEATURES n-grams of most weight in order, and their weights."""
    model = Model([], idf)

    def rows(batches):
        for b in batches:
            out = []
            for lang, text, order in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (c := ngram_counts(text)) is not None:
                    at, x = model.features(c)
                    most = np.sort(np.argsort(-x, kind="stable")[:MAX_FEATURES])
                    out.append((lang, at[most].astype("<u4").tobytes(), x[most].astype("<f4").tobytes(), order))
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["lang", "at", "x", "__o"])

    return rows


class Drawn(NamedTuple):
    """A row of the sample: little-endian buckets and weights, and its place in the order."""
    lang: str
    at: bytes
    x: bytes
    order: int


def sample(rows: DataFrame, idf: np.ndarray) -> tuple[list[str], list]:
    """(languages in order of name, MAX_TRAIN rows at most) of (doc_id, lang, text), of each language equally many if it has them.

    A hash of doc_id and text draws a few more than needed, and of those the ones of least hash are taken; so rows that
    repeat are no more than their language's part. Rows equal in both are drawn together or not at all.
    """
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_TRAIN // 2).collect()
    if not counts:
        return [], []
    part = MAX_TRAIN // len(counts)
    shares = rows.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * part + 8) / r["count"])) for r in counts], "lang string, __share double")
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1_000_000)) / F.lit(1e6) < F.col("__share")
    picked = rows.join(F.broadcast(shares), "lang").filter(drawn).select("lang", "text", F.xxhash64(F.lit("order"), "doc_id", "text").alias("__o"))
    seen = picked.mapInArrow(_features(idf), "lang string, at binary, x binary, __o long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__o", "at", "x"))
    # as Arrow columns: rows would be objects twice on the driver, in the JVM and here
    found = seen.withColumn("__r", rank).filter(F.col("__r") <= part).drop("__r").orderBy("__o", "at", "x", "lang").toArrow()
    return sorted(r.lang for r in counts), [Drawn(*r) for r in zip(*(c.to_pylist() for c in found.columns))]


def fit(docs: DataFrame) -> Model:
    """Learn from the text and lang of the rows that are not held out and have a lang."""
    rows = docs.filter(~held_out()).filter("lang IS NOT NULL").select("doc_id", "lang", "text")
    df = np.zeros(BUCKETS)
    total = 0
    found = rows.select("text").mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    for bucket, n in zip(found["bucket"].to_pylist(), found["n"].to_pylist()):
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    languages, found = sample(rows, idf)
    number = {lang: i for i, lang in enumerate(languages)}
    seen = [(np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r.x, "<f4"), number[r.lang]) for r in found]
    return train(Model(languages, idf), seen) if languages else Model([], idf)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the text alone.

    lang_pred is "und", with score 0, for a null text, one without a letter, or
    if nothing could be learned. Any number of languages may occur; at most
    MAX_TRAIN / 2 are learned, those with the most rows. Of languages with one score the first by name is
    taken. Texts are read whole; each row is answered, also where rows repeat a
    doc_id or a text. Columns named lang_pred or score are replaced, all others
    pass. An empty table gives no rows.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its weights other than zero

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])

    found = docs.drop("lang_pred", "score").withColumn("__p", predict("text"))
    return found.withColumn("lang_pred", F.col("__p.lang_pred")).withColumn("score", F.col("__p.score")).drop("__p")


def op4_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
