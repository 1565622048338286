"""A gallery that grows by batches: numbered records, their sources, and what is known of each page.

Every batch writes one partition of each table, in this order: gallery, pages, sources. A batch
counts from the moment its sources are there, so one that broke off leaves nothing that is read, and
running it again under the same name replaces what it left. A batch that counts is never written
again. One writer at a time.

- gallery: record_no, source_id, hash, page, item_index, code, words
- pages: hash, page, detected, indexed, failed: a row for each page that was gone through
- sources: an append log, the row of the greatest seq counts: id, path, name, hash, kind, mode,
  start_record, item_count, page_count, completed_page, status
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import WORDS

#: Records of one file.
FILE_RECORDS = 100_000
_WORDS = ", ".join(f"w{k} long" for k in range(WORDS))
SCHEMAS = {
    "gallery": f"record_no long, source_id long, hash string, page int, item_index int, code string, {_WORDS}, batch string",
    "pages": "hash string, page int, detected long, indexed long, failed long, batch string",
    "sources": "id long, seq long, path string, name string, hash string, kind string, mode string, start_record long, item_count long, page_count int, completed_page int, status string, batch string",
}


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass
class Store:
    """The tables under a folder that the driver and all executors share."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        at = f"{self.folder}/{name}"
        if not path_exists(self.spark, at):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", at).parquet(at)

    def log(self) -> DataFrame:
        """Every row of the sources' log."""
        return self._table("sources")

    def sources(self) -> DataFrame:
        """The latest row of each source."""
        every = self.log()
        last = every.groupBy("id").agg(F.max_by(F.struct(*[c for c in every.columns if c != "id"]), "seq").alias("s"))
        return last.select("id", "s.*")

    def _counted(self, name: str) -> DataFrame:
        return self._table(name).join(self.log().select("batch").distinct(), "batch", "left_semi")

    def gallery(self) -> DataFrame:
        return self._counted("gallery")

    def pages(self) -> DataFrame:
        return self._counted("pages")

    def totals(self) -> tuple[int, int, int]:
        """Records and sources there are, and the next seq of the log."""
        s = self.sources().agg(F.coalesce(F.sum("item_count"), F.lit(0)), F.count("*"), F.coalesce(F.max("seq") + 1, F.lit(0))).first()
        return s[0], s[1], s[2]

    def has(self, batch: str) -> bool:
        return path_exists(self.spark, f"{self.folder}/sources/batch={batch}/_SUCCESS")

    def write(self, name: str, rows: DataFrame, batch: str) -> None:
        """Replaces a batch's partition of a table."""
        columns = [f.strip().split(" ") for f in SCHEMAS[name].split(", ") if f != "batch string"]
        rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns]).write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).parquet(f"{self.folder}/{name}/batch={batch}")
