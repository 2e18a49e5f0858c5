"""From raw documents to token ids: language, exact and near copies, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Rows decide, not ids: rows that repeat
a doc_id or have none are told apart by their text. Null, empty and blank texts
have no language, so the first stage drops them; texts are read whole; columns
besides those of ``documents`` pass, also where an operator uses their name; an
empty table gives none. :func:`run` writes each stage's rows
to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language, mixing, near_copies, pieces
from tessera.llm.common import read_table, staged

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _own_names(stage):
    """A stage whose input keeps its further columns, whatever names the operator gives its results."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENTS}
        out = stage(spark, docs.withColumnsRenamed(held), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in held.items()})

    return run


#: Documents whose language is unknown, or less certain than this, go.
MIN_SCORE = 0.5


@_own_names
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: not "und" and a score of MIN_SCORE or more."""
    known = language.identify(docs)
    return known.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(docs.columns)


@_own_names
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one of least doc_id."""
    return exact_dedup.exact_dedup(docs).filter("kept").select(docs.columns)


@_own_names
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word Jaccard similarity 0.8 or more connect the one of least doc_id."""
    return near_copies.drop_near_copies(docs)


@_own_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them."""
    return mixing.mix(docs).select(docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text: a text that does not round-trip is marked, not lost."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    done = pieces.encode(docs, model)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")


STAGES = [
    ("language", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("pieces", to_pieces),
]
#: Learning, fingerprints and segmentation have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
