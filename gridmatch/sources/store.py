"""Image files, JSON lines, and the tables that imports and searches leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.bits import CELLS, SIDE, WORDS
from ..operators import raster as R
from ..operators.index import natural_key
from .records import to_words

WORD_NAMES = [f"w{k}" for k in range(WORDS)]


def plain_path() -> Column:
    """The path of a file source's row, as it is written in the file system (there, it is an escaped URI)."""
    at = F.col("_metadata.file_path")
    return F.coalesce(F.try_url_decode(F.replace(at, F.lit("+"), F.lit("%2B"))), at)


def read_images(spark: SparkSession, path: str | list[str], keep_invalid: bool = False, modified_after: str | None = None) -> DataFrame:
    """path, width, height and gray pixels (a byte each) of the image files under a folder.

    Files that are no image are dropped, or kept without pixels. Colours are weighted as luminance.
    modified_after leaves out older files before any is opened.
    """
    files = spark.read.format("image").option("dropInvalid", not keep_invalid).option("recursiveFileLookup", True)
    files = (files.option("modifiedAfter", modified_after) if modified_after else files).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gray = []
            for w, h, n, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if n < 1:
                    gray.append(None)
                    continue
                p = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.float64)  # blue, green, red (, alpha)
                g = p[:, :, 0] if n == 1 else p[:, :, :3] @ np.array([0.114, 0.587, 0.299])
                gray.append(np.clip(np.floor(g + 0.5), 0, 255).astype(np.uint8).tobytes())
            lost = pa.array([g is None for g in gray])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pc.if_else(lost, None, b.column(k)) for k in (1, 2)], pa.array(gray, pa.binary())], ["path", "width", "height", "pixels"])

    i = F.col("image")
    flat = files.select(plain_path().alias("path"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("n"), i["data"].alias("data"))
    return flat.mapInArrow(run, "path string, width int, height int, pixels binary")


def image_records(images: DataFrame, preset: dict | None = None) -> DataFrame:
    """One record for each image: its whole area sampled around its dark pixels; page 0, item 1, no code.

    Rows: path, page, item_index, code, known, the grid's words and the mask's (m0 ...). An image
    without pixels keeps its row with nulls.
    """
    preset = R.GALLERY if preset is None else preset
    masks = [f"m{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                s = b.slice(i, 64)
                flat = np.zeros((2, s.num_rows, 448), np.uint8)
                known: list[int | None] = []
                for k, (w, h, p) in enumerate(zip(*(s.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    if not p:
                        known.append(None)
                        continue
                    cells, mask = R.sample(np.frombuffer(p, np.uint8).reshape(h, w), SIDE, **preset)
                    flat[0, k, :CELLS], flat[1, k, :CELLS] = cells.ravel(), mask.ravel()
                    known.append(int(mask.sum()))
                lost = np.array([k is None for k in known])
                words = [to_words(np.packbits(v, 1, "little")) for v in flat]
                columns = [pa.array(np.ascontiguousarray(v[:, k]), mask=lost) for v in words for k in range(WORDS)]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(known, pa.int32()), *columns], ["path", "known", *WORD_NAMES, *masks])

    schema = "path string, known int, " + ", ".join(f"{c} long" for c in [*WORD_NAMES, *masks])
    made = images.select("path", "width", "height", "pixels").mapInArrow(run, schema)
    return made.select("path", F.lit(0).alias("page"), F.lit(1).alias("item_index"), F.lit(None).cast("string").alias("code"), "known", *WORD_NAMES, *masks)


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "id") -> DataFrame:
    """Rows of JSON lines, of each key the last one in the file; blank lines and rows without a key go.

    The order of lines is that of their files, in natural order (part-2 before part-10), and places:
    the start of a task's part, then the line in it.
    """
    text = spark.read.text(path).select("value", F.struct(natural_key(F.col("_metadata.file_path")).alias("key"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    rows = text.where(F.trim("value") != "").select(F.from_json("value", schema).alias("row"), "at").where(F.col(f"row.{key}").isNotNull())
    last = F.row_number().over(W.partitionBy(f"row.{key}").orderBy(F.desc("at")))
    return rows.withColumn("n", last).where("n = 1").select("row.*")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, "id int, name string, item_count long, mode string")


def read_feature_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the older index, with its defaults."""
    rows = read_lines(spark, path, "id string, path string, code string, kind string, width int, height int, grid string")
    return rows.withColumns({"kind": F.coalesce("kind", F.lit("image")), "width": F.coalesce("width", F.lit(0)), "height": F.coalesce("height", F.lit(0))})


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Grids kept beside the older index; rows need both an id and a grid."""
    return read_lines(spark, path, "id string, grid string").where("grid is not null")


def write_gallery(records: DataFrame, folder: str) -> None:
    """Appends records; streaming.imports.append_new is the form that a rerun doesn't repeat."""
    records.write.mode("append").parquet(f"{folder}/gallery")


def read_gallery(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/gallery")


def write_matches(matches: DataFrame, folder: str) -> None:
    """The results of one search, as JSON lines by target."""
    matches.repartition("target_id").sortWithinPartitions("target_id", "rank").write.mode("overwrite").json(f"{folder}/matches")


def write_progress(report: DataFrame, folder: str) -> None:
    """An import's report (few rows), as JSON lines."""
    report.write.mode("overwrite").json(f"{folder}/progress")
