"""A corpus in five stages: language, near-duplicates, personal data, mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of docs. Rows that repeat an id are one document in several rows and share its
fate; rows without an id are never near-duplicates of others. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmatch.llm import language, mixing, personal, pieces
from gridmatch.llm.common import long_rows, table, written
from gridmatch.llm.neardup import near_duplicates

#: A text is rejected if no language labels so large a share of its letters.
LEAST_SHARE = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null ones too) and those that no language prevails in.

    Without any labelled text to learn from, only the former go.
    """
    long_rows(spark)
    labelled = docs.where(~language.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if labelled.isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, share, spans = _free(docs, "lang", "share", "spans")
    found = language.identify(docs, language.train(labelled), names=(lang, share, spans))
    return found.where((F.col(lang) != "und") & (F.col(share) >= LEAST_SHARE)).select(docs.columns)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer where docs has such columns."""
    taken = "_" * max((len(c) for c in docs.columns), default=0)
    return [f"_{n}{taken}" for n in names]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, the document with the smallest id stays."""
    long_rows(spark)
    gone = written(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    long_rows(spark)
    clean = personal.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    long_rows(spark)
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and digests of the ids and of the text that they spell, one row for each copy."""
    long_rows(spark)
    return pieces.digests(docs)


STAGES = [
    ("language", keep_known_language),
    ("near-duplicates", drop_near_duplicates),
    ("personal-data", redact_personal_data),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can't express the language model, the components or the segmentation; tests/llm does.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
