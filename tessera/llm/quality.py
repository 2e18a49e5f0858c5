"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: a rule is grown as a conjunction
of thresholds by information gain, pruned on rows kept aside, and the rows it
covers are set aside before the next. The list becomes one ordered Spark
conditional expression over the statistics' columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices, staged, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Labelled rows that the driver learns from, at most; those of least hash.
MAX_ROWS = 20_000
#: A rule must be right this often, on the rows it was not grown on, to be kept.
MIN_PRECISION = 0.9
MIN_COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 4
THRESHOLDS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
_SPACE = " \t\n\x0b\x0c\r"


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Distinct words, and words inside a window of three that occurs again."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(ids) < WINDOW:
        return len(seen), 0
    pair = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)[1]
    _, which, n = np.unique(pair * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    inside = np.zeros(len(ids), bool)
    for i in range(WINDOW):
        inside[i:len(ids) - WINDOW + 1 + i] |= again
    return len(seen), int(inside.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    distinct, repeated = _repeat_words(words)
    return (
        len(words), len(text) - sum(text.count(c) for c in _SPACE), sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)), repeated, len(lines), distinct,
    )


def _stats(batches):
    for b in slices(batches):
        rows = [statistics(t) for t in b.column(1).to_pylist()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS) of each row."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_stats, ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{c} long" for c in COUNTS)]))


#: What rules may test: each a ratio of counts, in SQL, defined for empty texts.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.value!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x, n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for c in rule:
        held &= c.holds(x)
    return held


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    held = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int(bad[held].sum()), int((~bad[held]).sum())
        if not p or not n:
            break
        now = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for f, values in x.items():
            cuts = np.unique(np.quantile(values[held], np.linspace(0, 1, THRESHOLDS)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            for above in (True, False):
                inside = values[held][None, :] > cuts[:, None]
                inside = inside if above else ~inside
                ps, ns = inside[:, bad[held]].sum(1), inside[:, ~bad[held]].sum(1)
                gains = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - now), -1.0)
                if len(gains) and gains.max() > gain:
                    gain = gains.max()
                    best = Condition(f, above, float(cuts[gains.argmax()]))
        if best is None:
            break
        rule += (best,)
        held &= best.holds(x)
    return rule


def _prune(rule: Rule, x, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of best (p - n) / (p + n) on the rows kept aside, its precision and cover."""
    best = ((), -1.0, 0.0, 0)
    for k in range(len(rule), 0, -1):
        held = _covers(rule[:k], x, len(bad))
        p, n = int(bad[held].sum()), int((~bad[held]).sum())
        if p + n and (worth := (p - n) / (p + n)) > best[1]:
            best = (rule[:k], worth, p / (p + n), p + n)
    return best[0], best[2], best[3]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, aside: np.ndarray) -> list[Rule]:
    """Ordered rules for the rows that are ``bad``; ``aside`` marks the rows for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        part = {k: ({f: v[left & m] for f, v in x.items()}, bad[left & m]) for k, m in (("grow", ~aside), ("prune", aside))}
        if part["grow"][1].sum() < MIN_COVER:
            break
        rule, precision, cover = _prune(_grow(*part["grow"]), *part["prune"])
        if not rule or precision < MIN_PRECISION or cover < MIN_COVER:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def expression(rules: list[Rule]) -> Column:
    """True where the list keeps a document; nothing is kept out by an empty list."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        held = F.expr(" AND ".join(c.sql() for c in rule))
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from the labelled rows (doc_id, quality 0 or 1), MAX_ROWS of least hash; the driver holds only those.

    A threshold on the hash, from their number, leaves few more than MAX_ROWS over all tasks.
    """
    stats = stats.filter("doc_id IS NOT NULL")
    labels = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality")
    part = min(1.0, 1.2 * MAX_ROWS / max(1, labels.count()))
    labels = labels.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)) if part < 1 else 1 << 20))
    rows = stats.join(labels, "doc_id")
    features = [F.expr(s).alias(f) for f, s in FEATURES.items()]
    rows = rows.select("doc_id", "quality", F.xxhash64("doc_id").alias("__h"), *features).orderBy("__h", "doc_id", *FEATURES).limit(MAX_ROWS)
    seen = rows.toPandas()
    x = {f: seen[f].to_numpy(float) for f in FEATURES}
    return learn(x, seen["quality"].to_numpy() == 0, (seen["__h"].to_numpy(np.int64) >> 7) % 3 == 0)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, kept) of each row.

    base_failed: under 50 words, or over half of them in repeated windows; such
    rows, null and empty texts among them, are not kept. The rest goes by the
    rules. A row with a null doc_id has no label and is judged like any other;
    rows that repeat a doc_id all take its label, and labels that repeat one each
    count. Other columns are left out. An empty table gives no rows.
    """
    stats = staged(text_statistics(docs), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = fit(stats.filter(~failed), labels)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & expression(rules))


def op7_decision_list(spark, sf_dir):
    found = quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
