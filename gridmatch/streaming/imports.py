"""Imports and searches as streams; nothing is kept in operators, sinks are idempotent by key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.living import path_exists

#: Partitions of a target table that a batch looks at one by one; a batch with more reads all keys.
PRUNED = 1000


def append_new(target: str, keys: list[str], by: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds rows whose keys the table lacks: a batch run twice adds nothing.

    by, one of the keys, partitions the table: a batch then reads only the keys of partitions that it
    has rows for. One writer at a time; batches of one query follow each other.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if path_exists(spark, target):
            there = spark.read.parquet(target)
            if by:
                values = [r[0] for r in rows.select(by).distinct().limit(PRUNED + 1).collect()]
                there = there.where(F.col(by).cast("string").isin([str(v) for v in values if v is not None])) if len(values) <= PRUNED and None not in values else there
            rows = rows.join(there.select(*[F.col(k).cast(dict(rows.dtypes)[k]).alias(k) for k in keys]), keys, "left_anti")
        out = rows.write.mode("append")
        (out.partitionBy(by) if by else out).parquet(target)

    return write


def resumable_import(pages: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("source_hash", "page", "item"), by: str | None = None) -> StreamingQuery:
    """Writes what a stream of page records brings, each record once, also after a half-written page."""
    return pages.writeStream.foreachBatch(append_new(target, list(keys), by)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, folder: str) -> DataFrame | None:
    """The answers there are, with the run, batch and day they belong to; None before the first."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/run=*/batch=*/day=*") if _days(spark, folder) else None


def _days(spark: SparkSession, folder: str) -> list:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run=*/batch=*/day=*")
    return [s.getPath() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]


def search_queue(targets: DataFrame, search: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of targets (target_id, asked_at, words) against a static gallery.

    Targets that have an answer are kept out before the search, in whatever run it was given. Each
    batch writes its own folder, which the same batch run again replaces; answers lie by the day on
    which they were asked for.
    """
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def answer(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("target_id").agg(F.min("asked_at").alias("asked_at"))
        asked = batch.dropDuplicates(["target_id"]).drop("asked_at")
        given = answers(spark, folder)
        if given is not None:
            given = given.where(~((F.col("run") == run) & (F.col("batch") == number)))
            asked = asked.join(given.select(F.col("target_id").cast("long").alias("target_id")).distinct(), "target_id", "left_anti")
        found = search(asked).join(first, "target_id").withColumn("day", F.to_date("asked_at"))
        found.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/run={run}/batch={number}")

    return targets.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_answers(spark: SparkSession, folder: str, hours: int, as_of: str) -> int:
    """Deletes the days that ended more than so many hours before as_of (2024-01-20T00:00:00); how many folders. 0 hours keep all."""
    if hours <= 0:
        return 0
    end = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    old = [p for p in _days(spark, folder) if datetime.fromisoformat(p.getName().split("=")[1]) + timedelta(days=1) <= end]
    for p in old:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)


def unfinished(pages: DataFrame, written: DataFrame) -> DataFrame:
    """Pages (source_hash, page, items) of which not all items are written, half-written ones too."""
    done = written.groupBy("source_hash", "page").agg(F.countDistinct("item").alias("_done"))
    return pages.join(done, ["source_hash", "page"], "left").where(F.coalesce("_done", F.lit(0)) < F.col("items")).drop("_done")
