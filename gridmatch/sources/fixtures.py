"""Grids, targets and logs derived from the given tables, in Spark and as SQL text.

A word of 63 bits comes from an md5 of an id, a salt and the word's number, so both engines see the
same rows. Everything grows with the tables it is derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import WORDS
from .tables import written

MODE = "crop-sharp-v2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word(id_: Column, salt: str, k: int) -> Column:
    h = F.md5(F.concat(id_.cast("string"), F.lit(f":{salt}:{k}")))
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 31).bitwiseOR(half(9).bitwiseAND(F.lit((1 << 31) - 1)))


def word_sql(id_: str, salt: str, k: int) -> str:
    h = f"md5({id_} || ':{salt}:{k}')"
    return f"((('0x'||substr({h},1,8))::BIGINT << 31) | (('0x'||substr({h},9,8))::BIGINT & 2147483647))"


def all_of(id_: Column, salts: list[str], k: int) -> Column:
    out = word(id_, salts[0], k)
    for s in salts[1:]:
        out = out.bitwiseAND(word(id_, s, k))
    return out


def all_of_sql(id_: str, salts: list[str], k: int) -> str:
    return "(" + " & ".join(word_sql(id_, s, k) for s in salts) + ")"


FLIPS = [f"f{i}" for i in range(5)]
SPARSE = [f"m{i}" for i in range(1, 5)]


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    words = [word(i, "g", k).alias(f"w{k}") for k in range(WORDS)]
    made = table(spark, sf_dir, "documents").select(
        i.alias("record_no"), (i % 100).cast("int").alias("source_id"), F.nullif(i % 7, F.lit(0)).cast("int").alias("page"), F.nullif(i % 31, F.lit(0)).cast("int").alias("item_index"), F.when(i % 5 != 0, i.cast("string")).alias("code"), *words
    )
    return written(made, "gallery")


GALLERY_SQL = f"gallery AS (SELECT doc_id AS record_no, CAST(doc_id % 100 AS INT) AS source_id, CAST(nullif(doc_id % 7, 0) AS INT) AS page, CAST(nullif(doc_id % 31, 0) AS INT) AS item_index, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS code, {', '.join(f'{word_sql("doc_id", "g", k)} AS w{k}' for k in range(WORDS))} FROM documents)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is searched for, damaged; one in 97 of the others is hardly known."""
    i = F.col("doc_id")
    sparse = i % 20 != 0
    d = table(spark, sf_dir, "documents").where((i % 20 == 0) | (i % 97 == 1)).select("doc_id")
    masks = [F.when(sparse, all_of(i, SPARSE, k)).otherwise(word(i, "m1", k).bitwiseOR(word(i, "m2", k))).alias(f"m{k}") for k in range(WORDS)]
    d = d.select("doc_id", *masks)
    seen = [word(i, "g", k).bitwiseXOR(all_of(i, FLIPS, k)).bitwiseAND(F.col(f"m{k}")).alias(f"t{k}") for k in range(WORDS)]
    return written(d.select(i.alias("target_id"), *seen, *[f"m{k}" for k in range(WORDS)]), "targets")


TARGETS_SQL = (
    f"masks AS (SELECT doc_id, {', '.join(f'CASE WHEN doc_id % 20 <> 0 THEN {all_of_sql("doc_id", SPARSE, k)} ELSE {word_sql("doc_id", "m1", k)} | {word_sql("doc_id", "m2", k)} END AS m{k}' for k in range(WORDS))} FROM documents WHERE doc_id % 20 = 0 OR doc_id % 97 = 1), "
    f"targets AS (SELECT doc_id AS target_id, {', '.join(f'xor({word_sql("doc_id", "g", k)}, {all_of_sql("doc_id", FLIPS, k)}) & m{k} AS t{k}' for k in range(WORDS))}, {', '.join(f'm{k}' for k in range(WORDS))} FROM masks)"
)


def sources_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each source; the later one counts."""
    s = table(spark, sf_dir, "supplier")
    i = F.col("s_suppkey").cast("int")
    mode = F.when(F.col("s_nationkey") % 7 == 0, "old").otherwise(MODE)
    first = s.select(i.alias("id"), F.lit(0).alias("seq"), F.concat(F.lit("source "), i).alias("name"), F.lit(0).cast("bigint").alias("item_count"), mode.alias("mode"))
    second = s.select(i.alias("id"), F.lit(1).alias("seq"), F.concat(F.lit("source "), i).alias("name"), F.when(F.col("s_acctbal") < 0, 0).otherwise(10).cast("bigint").alias("item_count"), mode.alias("mode"))
    return first.unionByName(second)


SOURCES_SQL = (
    f"sources_log AS (SELECT CAST(s_suppkey AS INT) AS id, seq, 'source ' || s_suppkey AS name, CAST(CASE WHEN seq = 1 AND s_acctbal >= 0 THEN 10 ELSE 0 END AS BIGINT) AS item_count, CASE WHEN s_nationkey % 7 = 0 THEN 'old' ELSE '{MODE}' END AS mode FROM supplier, (VALUES (0), (1)) v(seq)), "
    "sources AS (SELECT id, name, item_count, mode FROM sources_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".png", ".JPG", ".tif", ".txt", "")]), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(i.alias("file_no"), F.concat("source", F.lit("/"), i, ext).alias("path"), F.sha1(F.encode("text", "UTF-8")).alias("hash"))


FILES_SQL = "files AS (SELECT doc_id AS file_no, source || '/' || doc_id || ['.pdf', '.png', '.JPG', '.tif', '.txt', ''][CAST(doc_id % 6 AS INT) + 1] AS path, sha1(text) AS hash FROM documents)"


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(i % 2 == 0).select(F.sha1(F.encode("text", "UTF-8")).alias("hash"), F.when(i % 4 == 0, "old").otherwise(MODE).alias("mode"))


KNOWN_SQL = f"known_files AS (SELECT sha1(text) AS hash, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE '{MODE}' END AS mode FROM documents WHERE doc_id % 2 = 0)"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 gray pixels."""
    gray = F.transform("embedding", lambda e: F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), e.cast("double"))) + F.lit(0.5)) * F.lit(255.0)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", gray.alias("pixels"))


RASTERS_SQL = "rasters AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor((greatest(-0.5e0, least(0.5e0, CAST(e AS DOUBLE))) + 0.5e0) * 255e0) AS INT)) AS pixels FROM embeddings)"


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed texts on pages: one page for each order."""
    p, n, s = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.lpad(p.cast("string"), (F.lit(4) + p % 5).cast("int"), "7").alias("str"), ((n % 4) * 180 + s % 9).cast("double").alias("x"), (F.floor(n / 4) * 220 + s % 5).cast("double").alias("y"), (F.col("l_quantity") + 60).cast("double").alias("width"), F.lit(12.0).alias("height")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import outcomes: one for each event."""
    e = table(spark, sf_dir, "events")
    kind = F.pmod(F.col("event_id"), F.lit(10))
    status = F.when(kind < 6, "indexed").when(kind < 8, "skipped").otherwise("failed")
    return e.select(F.col("user_id").alias("source_id"), (F.col("event_id") % 13).alias("page"), "event_id", status.alias("status"), F.when(status == "failed", F.concat(F.lit("unreadable "), F.col("event_id") % 3)).alias("error"), "ts")


OUTCOMES_SQL = "outcomes AS (SELECT user_id AS source_id, event_id % 13 AS page, event_id, CASE WHEN event_id % 10 < 6 THEN 'indexed' WHEN event_id % 10 < 8 THEN 'skipped' ELSE 'failed' END AS status, CASE WHEN event_id % 10 >= 8 THEN 'unreadable ' || (event_id % 3) END AS error, ts FROM events)"
