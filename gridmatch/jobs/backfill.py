"""Bringing older tables up to date: only rows that lack something are read, computed and written.

The feature table has two kinds of partitions: whole=true/run=..., rows with all parts, and
whole=false, rows that lack some. A backfill reads the latter only; what it builds becomes a run of
its own, what it can't build stays behind with its error. A run that broke off is repeated under its
name. A second run finds nothing to do and writes no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import GALLERY
from ..sources.living import path_exists
from ..sources.store import image_records
from ..sources.tables import written
from . import fine

#: What a row of features must have: grids, finder grids and the sampled grid of 21.
PARTS = ("cells", "finders", "grid21")
NAMES = [c.split()[0] for c in fine.SCHEMA.split(", ")]


def lacking() -> Column:
    """Whether a row of features lacks a part."""
    missing = F.lit(False)
    for c in PARTS:
        missing = missing | F.col(c).isNull()
    return missing


def write_features(features: DataFrame, folder: str, run: str) -> None:
    """A feature table (record_no and the columns of fine.SCHEMA) from any rows; replaces the run and the rest."""
    t = written(features.select(*NAMES), "features")
    t.where(~lacking()).write.mode("overwrite").parquet(f"{folder}/whole=true/run={run}")
    t.where(lacking()).write.mode("overwrite").parquet(f"{folder}/whole=false")


def read_features(spark: SparkSession, folder: str, whole: bool | None = None) -> DataFrame:
    """The rows with all parts, those that lack some, or (None) all."""
    if whole is None:
        return read_features(spark, folder, True).unionByName(read_features(spark, folder, False))
    at = f"{folder}/whole={str(whole).lower()}"
    return spark.read.schema(fine.SCHEMA).parquet(at).select(*NAMES) if path_exists(spark, at) else spark.createDataFrame([], fine.SCHEMA)


def backfill_features(spark: SparkSession, folder: str, images: DataFrame, run: str) -> DataFrame:
    """Computes the rows that lack parts from images (record_no, width, pixels); returns status, n for kept, built and failed.

    A row whose image isn't there or is no raster has failed: it stays, with its error, and is tried
    again once an image is given that it hasn't failed with (rows with an error and no image are left alone).
    """
    whole = read_features(spark, folder, True).agg(F.count("*").alias("n")).select(F.lit("kept").alias("status"), "n")
    whole = written(whole, "kept")
    left = read_features(spark, folder, False)
    # a row that failed is tried again only if there is an image that could be read now
    usable = (F.col("width") > 0) & (F.octet_length("pixels") > 0) & (F.octet_length("pixels") % F.col("width") == 0)
    todo = left.select("record_no", F.col("error").alias("old")).join(images.select("record_no", "width", "pixels"), "record_no", "left")
    todo = todo.where(F.col("old").isNull() | F.coalesce(usable, F.lit(False)))
    made = written(fine.image_features(todo), "made")
    counts = written(made.groupBy(F.when(F.col("error").isNull(), "built").otherwise("failed").alias("status")).agg(F.count("*").alias("n")), "counts")
    if not counts.isEmpty():
        tried = made.select("record_no", F.lit(True).alias("tried"))
        rest = left.join(tried, "record_no", "left_anti").unionByName(made.where("error is not null").select(*NAMES))
        rest = written(rest, "rest")  # it is read from what is replaced below
        made.where("error is null").select(*NAMES).write.mode("overwrite").parquet(f"{folder}/whole=true/run={run}")
        rest.write.mode("overwrite").parquet(f"{folder}/whole=false")
    return whole.unionByName(counts)


def backfill_sidecar(spark: SparkSession, folder: str, items: DataFrame, run: str, mode: dict | None = None) -> DataFrame:
    """Samples a grid for each item (id, path, width, height, pixels) that the sidecar under folder lacks; returns status, n.

    The sidecar has a row for each grid: id, known, words and mask, in a partition for each run. Items
    without pixels have failed and leave no row. A run in which nothing is built writes no file.
    """
    words = [f"{p}{k}" for p in "wm" for k in range(7)]
    schema = "id string, known int, " + ", ".join(f"{w} long" for w in words)
    side = spark.read.schema(schema).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], schema)
    ids = side.select("id")
    kept = items.join(ids, "id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("kept").alias("status"), "n")
    missing = items.join(ids, "id", "left_anti").select(F.col("id").alias("path"), "width", "height", "pixels")
    made = written(image_records(missing, mode or GALLERY), "made")
    counts = written(kept.unionByName(made.groupBy(F.when(F.col("known").isNotNull(), "built").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))), "counts")
    built = made.where("known is not null").select(F.col("path").alias("id"), "known", *words)
    if not built.isEmpty():
        built.write.mode("overwrite").parquet(f"{folder}/run={run}")
    return counts.where("n > 0")
