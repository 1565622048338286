"""Tables written on the way: they cut lineage and expressions, and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of this machine, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


BATCH_BYTES = 8 << 20
#: Of tables of long rows: row groups are closed early, since a reader unpacks up to 4096 rows of one at once.
#: Groups are measured as packed, so how much rows may shrink is bounded: no dictionary, and snappy (to a 21st).
LONG_ROWS = {"compression": "snappy", "parquet.enable.dictionary": False, "parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 16, "parquet.block.size.row.check.max": 16, "parquet.page.size.row.check.min": 4}


def written(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder; long_rows if it holds rasters."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _watching:
        paths.append(path)
    df.write.options(**LONG_ROWS if long_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Rasters go to Python and come back 8 MB at a time: a batch is held a few times over, on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"[0-9]+", spark.conf.get(name))[0]) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


_watching: list[list[str]] = []


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables written on the way inside; what reads them must be done or written elsewhere by then."""
    paths: list[str] = []
    _watching.append(paths)
    try:
        yield
    finally:
        _watching.remove(paths)
        for p in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
