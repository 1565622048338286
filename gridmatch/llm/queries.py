"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogue, language, personal, pieces, secrets, suffix_lm
from .common import table
from .filter_audit import AUDIT_SQL, audit
from .forest import nearest
from .jpeg import media_column, media_features
from .mixing import MIX_SQL, mix
from .neardup import near_duplicates
from .ngram_join import similar_documents
from .token_files import token_files


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_column(table(spark, sf_dir, "documents")))


def op4_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


def op8_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents"))


def op10_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op11_dial_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report(table(spark, sf_dir, "conversations"))


def op12_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_forest": op1_prefix_forest,
    "op2_systematic_mix": op2_systematic_mix,
    "op3_jpeg_media": op3_jpeg_media,
    "op4_arrow_token_files": op4_arrow_token_files,
    "op5_language_spans": op5_language_spans,
    "op6_markov_secrets": op6_markov_secrets,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_minhash_hamming": op8_minhash_hamming,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_suffix_array_pieces": op10_suffix_array_pieces,
    "op11_dial_conversation_repair": op11_dial_conversation_repair,
    "op12_multi_order_join": op12_multi_order_join,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op2_systematic_mix": MIX_SQL,
    "op11_dial_conversation_repair": dialogue.REPORT_SQL,
    "op13_filter_audit": AUDIT_SQL,
}
