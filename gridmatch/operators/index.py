"""Building the gallery: files, known hashes, paths, numbering, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import placed

#: The extensions that are imported.
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
PDF = ".pdf"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(*IMAGES, PDF)


def natural_key(path: Column) -> Column:
    """Sorts basenames without case and digit runs as numbers: runs are padded to 20 digits."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def new_files(files: DataFrame, known: DataFrame, mode: str) -> DataFrame:
    """Supported files whose content is neither known under this mode nor earlier in the batch."""
    fresh = files.where(supported(F.col("path"))).join(known.where(F.col("mode") == mode).select("hash").distinct(), "hash", "left_anti")
    first = W.partitionBy("hash").orderBy(natural_key(F.col("path")), "path", "file_no")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def pdfs_to_import(files: DataFrame, states: DataFrame, sources: DataFrame, mode: str) -> DataFrame:
    """PDF files, without those whose content was completed in this mode or is a source with records and no state.

    states: hash, status, mode; sources: hash, item_count. A file without a hash stays.
    """
    done = states.where((F.col("status") == "completed") & (F.col("mode") == mode)).select("hash")
    older = sources.where(F.col("item_count") > 0).select("hash").join(states.select("hash"), "hash", "left_anti")
    return files.where(extension(F.col("path")) == ".pdf").join(done.union(older).distinct(), "hash", "left_anti")


def item_id(path: Column, hash_: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat_ws("|", path, hash_), "UTF-8")), 1, 16)


def relocated(path: Column, root: str) -> Column:
    """A stored path under root: relative ones, and absolute ones from their last /data/ on."""
    tail = F.regexp_extract(path, r"^.*/(data/.*)$", 1)
    return F.when(~path.startswith("/"), F.concat(F.lit(f"{root}/"), path)).when(tail != "", F.concat(F.lit(f"{root}/"), tail)).otherwise(path)


def stored(path: Column, root: str) -> Column:
    """The inverse: a path under root without it."""
    return F.when(path == root, "").when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 20)).otherwise(path)


def searchable(kind: Column, width: Column, height: Column) -> Column:
    """PDF items always; images if nearly square."""
    ratio = width / height
    return F.coalesce((kind == "pdf") | ((width > 0) & (height > 0) & (ratio >= 0.9) & (ratio <= 1.1)), F.lit(False))


def clamped_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """left, top, width, height of a crop inside an image, 8 pixels or more."""
    near = lambda v: F.floor(v + 0.5).cast("int")
    left, top = F.greatest(F.lit(0), near(x)), F.greatest(F.lit(0), near(y))
    return [left, top, F.greatest(F.lit(8), F.least(near(w), width - left)), F.greatest(F.lit(8), F.least(near(h), height - top))]


def numbered(records: DataFrame) -> DataFrame:
    """record_no in (source, page, item) order and each source's start_record.

    Sources are summed up from their counts, in ranges of them; rows are only ranked within a source's
    page, after a prefix sum over its pages, so no window holds all rows.
    """
    pages = records.groupBy("source_id", "page").agg(F.count("*").alias("n"))
    per = pages.groupBy("source_id").agg(F.sum("n").alias("n"))
    starts = placed(per, ["source_id"], total="n", total_name="start_record").select("source_id", "start_record")
    within = W.partitionBy("source_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    offsets = pages.select("source_id", "page", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before"))
    ranked = records.withColumn("_r", F.row_number().over(W.partitionBy("source_id", "page").orderBy("item")) - 1)
    joined = ranked.join(offsets, ["source_id", "page"]).join(starts, "source_id")
    return joined.withColumn("record_no", F.col("start_record") + F.col("before") + F.col("_r")).drop("_r", "before")


def report(outcomes: DataFrame) -> DataFrame:
    """Scanned, indexed, skipped and failed, by source, with the distinct errors."""
    is_ = lambda s: F.sum((F.col("status") == s).cast("bigint"))
    return outcomes.groupBy("source_id").agg(F.count("*").alias("scanned"), is_("indexed").alias("indexed"), is_("skipped").alias("skipped"), is_("failed").alias("failed"), F.array_join(F.sort_array(F.collect_set("error")), ";").alias("errors"))


def index_totals(sources: DataFrame, older: DataFrame, mode: str) -> DataFrame:
    """active_records, older_items, total: one row."""
    live = (F.col("item_count") > 0) & (F.col("mode") == mode)
    packed = sources.agg(F.coalesce(F.sum(F.when(live, F.col("item_count"))), F.lit(0)).alias("active_records"), F.lit(0).cast("long").alias("older_items"))
    both = packed.unionByName(older.agg(F.lit(0).cast("long").alias("active_records"), F.count("*").alias("older_items")))
    return both.agg(F.sum("active_records").alias("active_records"), F.sum("older_items").alias("older_items")).withColumn("total", F.col("active_records") + F.col("older_items"))


def page_report(outcomes: DataFrame) -> DataFrame:
    """Detected, indexed and failed of each page of a source."""
    return outcomes.groupBy("source_id", "page").agg(F.count("*").alias("detected"), F.sum((F.col("status") == "indexed").cast("bigint")).alias("indexed"), F.sum((F.col("status") == "failed").cast("bigint")).alias("failed"))


def retained(rows: DataFrame, hours: int, as_of: str, ts: str = "ts") -> DataFrame:
    """Rows not older than so many hours at as_of; 0 keeps all."""
    return rows if hours <= 0 else rows.where(F.col(ts) >= F.expr(f"timestamp'{as_of}' - interval {hours} hours"))


def with_codes(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Joins code texts by byte offset; a length of 0 is no code. lines: offset, code."""
    return records.join(lines.withColumnRenamed("offset", "code_offset"), "code_offset", "left").withColumn("code", F.when(F.col("code_length") > 0, F.col("code")))


def preferred_grids(items: DataFrame, sidecar: DataFrame) -> DataFrame:
    """The sidecar's grid of an item where there is one, else its own; and where it came from."""
    s = sidecar.select("id", F.col("grid").alias("_side"))
    j = items.join(s, "id", "left")
    source = F.when(F.col("_side").isNotNull(), "sidecar").when(F.col("grid").isNotNull(), "own").otherwise("none")
    return j.select("id", F.coalesce("_side", "grid").alias("grid"), source.alias("origin"))


def to_backfill(items: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Items that the sidecar lacks."""
    return items.join(sidecar.select("id"), "id", "left_anti")


def backfill_counts(rows: DataFrame) -> DataFrame:
    """How many rows a backfill kept, built, skipped or failed."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))
