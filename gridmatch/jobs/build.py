"""Building the gallery: files to numbered records, in one job for each batch.

Files are listed and hashed as bytes that stay in the scan. New ones are decoded (images), or their
pages are taken from tables of rasters and printed texts (PDFs, which another program renders).
Every page and crop leaves one outcome row; numbers, sources, page marks and the report all come from
those rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import crops as C
from ..operators import index as I
from ..operators.order import placed
from ..operators.raster import TARGET
from ..sources import store as images_
from ..sources.living import Store
from ..sources.records import read_packed_index
from ..sources.tables import written
from .search import search

WORDS = images_.WORD_NAMES
_FILE = ["path", "hash", "kind"]


def listed(spark: SparkSession, folder: str, modified_after: str | None = None) -> DataFrame:
    """path, hash (SHA-1 of the bytes) and length of all files under a folder; empty files are not seen by Spark.

    modified_after (2024-05-01T00:00:00) leaves out older files before any is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.option("modifiedAfter", modified_after) if modified_after else files
    return files.load(folder).select(images_.plain_path().alias("path"), F.sha1("content").alias("hash"), "length")


def decoded(spark: SparkSession, folder: str, modified_after: str | None = None) -> DataFrame:
    """path, width, height and gray pixels of all files under a folder; no pixels where a file is no image."""
    return images_.read_images(spark, folder, keep_invalid=True, modified_after=modified_after)


def kind(path: Column) -> Column:
    ext = I.extension(path)
    return F.when(ext.isin(*I.IMAGES), "image").when(ext == I.PDF, "pdf").otherwise("other")


def to_import(files: DataFrame, store: Store, mode: str) -> DataFrame:
    """Of supported files, the first of each content in natural order, unless the store is done with that content.

    Images: a source with records is done. PDFs: a completed source of this mode is, or one with
    records of which no state is known. Rows without a hash are left out.
    """
    s = store.sources()
    some = files.withColumn("kind", kind(F.col("path"))).where("kind <> 'other'")
    # minima are taken before the shuffle, so a content that very many files have is no burden
    first = some.where("hash is not null").groupBy("hash").agg(F.min(F.struct(I.natural_key(F.col("path")).alias("key"), "path", "kind")).alias("f")).select("f.path", "hash", "f.kind")
    done_images = s.where("item_count > 0").select("hash")
    new_images = first.where("kind = 'image'").join(done_images, "hash", "left_anti")
    states = s.where("status is not null").select("hash", "status", "mode")
    return new_images.select(*_FILE).unionByName(I.pdfs_to_import(first.where("kind = 'pdf'"), states, s.select("hash", "item_count"), mode).select(*_FILE))


def image_outcomes(fresh: DataFrame, pictures: DataFrame) -> DataFrame:
    """One row for each new image: indexed with its grid, or failed."""
    made = images_.image_records(fresh.where("kind = 'image'").join(pictures, "path", "left").select("path", "width", "height", "pixels"))
    rows = fresh.where("kind = 'image'").join(made, "path")
    error = F.when(F.col("known").isNull(), "no image")
    return rows.select("hash", "path", "page", "item_index", "code", F.when(error.isNull(), "indexed").otherwise("failed").alias("status"), error.alias("error"), *WORDS)


def pdf_outcomes(fresh: DataFrame, pages: DataFrame, texts: DataFrame | None, gone_through: DataFrame, page_size: tuple[float, float]) -> DataFrame:
    """One row for each new page of new PDFs (without an item) and each crop on it.

    Pages that the store went through before are left alone. A page without a raster has failed.
    """
    key = F.concat_ws(":", "hash", F.col("page").cast("string"))
    todo = pages.select("hash", "page").distinct().join(fresh.where("kind = 'pdf'").select("hash").distinct(), "hash", "left_semi")
    todo = todo.join(gone_through.select("hash", "page"), ["hash", "page"], "left_anti")
    # rasters are shuffled once, if at all, and never sorted
    own = pages.join(todo.hint("shuffle_hash"), ["hash", "page"], "left_semi")
    rasters = own.select(key.alias("page_id"), "page_width", "pixels")
    boxes = None
    if texts is not None:
        there = texts.join(todo, ["hash", "page"], "left_semi")
        boxes = C.crops_from_text(there.select(key.alias("page_id"), "str", "x", "y", "width", "height"), *page_size)
    found = C.crop_grids(rasters, boxes)
    page = F.element_at(F.split("page_id", ":"), -1).cast("int")
    found = found.select(F.expr("substring(page_id, 1, length(page_id) - length(substring_index(page_id, ':', -1)) - 1)").alias("hash"), page.alias("page"), F.col("index").alias("item_index"), F.col("text").alias("code"), "status", "error", *WORDS)
    return found.join(fresh.where("kind = 'pdf'").select("hash", "path"), "hash").select("hash", "path", "page", "item_index", "code", "status", "error", *WORDS)


def page_marks(outcomes: DataFrame) -> DataFrame:
    """hash, page, detected, indexed, failed of each page of a PDF; a page that failed has 1 failure and no crops."""
    n = lambda c: F.count(F.when(c, 1))
    item = F.col("item_index").isNotNull()
    return outcomes.groupBy("hash", "page").agg(n(item).alias("detected"), n(item & (F.col("status") == "indexed")).alias("indexed"), n(F.col("status") == "failed").alias("failed"))


def last_whole_page(pages: DataFrame) -> DataFrame:
    """hash, completed_page: the last page before the first gap, from 1; 0 if page 1 is missing.

    pages: hash, page. In pages without repeats, those before any gap are those whose number is their rank.
    """
    rank = F.row_number().over(I.W.partitionBy("hash").orderBy("page"))
    ranked = pages.select("hash", "page").where("page >= 1").distinct().withColumn("r", rank)
    found = ranked.groupBy("hash").agg(F.coalesce(F.max(F.when(F.col("page") == F.col("r"), F.col("page"))), F.lit(0)).alias("completed_page"))
    rest = pages.select("hash").distinct().join(found.select("hash"), "hash", "left_anti")
    return found.unionByName(rest.select("hash", F.lit(0).alias("completed_page")))


def import_batch(store: Store, batch: str, mode: str, files: DataFrame, pictures: DataFrame, pages: DataFrame | None = None, texts: DataFrame | None = None, page_size: tuple[float, float] = (900, 1200)) -> DataFrame:
    """Adds what is new in files (path, hash) to the store, and returns the report; a batch that is there adds nothing.

    pictures: path, width, height, pixels (null where a file doesn't decode). pages: hash, page,
    page_width, pixels and, where it is known, page_count; texts: hash, page, str, x, y, width, height.
    A PDF whose pages aren't all there stays `importing`, keeps its id and goes on in a later batch
    with the pages that are missing. Records are numbered from the store's count on, by the natural
    order of paths, page and item; new sources are numbered likewise. A PDF without any crop is one
    failure. Images that fail leave no source.
    """
    spark = store.spark
    files = files.select("path", "hash")
    nothing = spark.createDataFrame([], "hash string, path string, page int, item_index int, code string, status string, error string, " + ", ".join(f"{w} long" for w in WORDS))
    fresh = written(to_import(files, store, mode) if not store.has(batch) else spark.createDataFrame([], "path string, hash string, kind string"), "fresh")
    from_pdf = nothing if pages is None else pdf_outcomes(fresh, pages, texts, store.pages(), page_size)
    outcomes = written(image_outcomes(fresh, pictures).unionByName(from_pdf), "outcomes")
    if store.has(batch):
        return _report(files, fresh, outcomes, outcomes.select("hash", F.lit(0).alias("page_count")))

    records, sources, seq = store.totals()
    known = store.sources()
    order = [I.natural_key(F.col("path")).alias("_key"), "path"]
    indexed = outcomes.where("status = 'indexed'").select("*", order[0])
    made = placed(indexed, ["_key", "path", "page", "item_index"]).withColumn("record_no", F.col("place") + records)
    per = made.groupBy("hash").agg(F.count("*").alias("n"), F.min("record_no").alias("first"))
    marks = page_marks(outcomes.where("page > 0"))
    whole = last_whole_page(store.pages().select("hash", "page").unionByName(marks.select("hash", "page")))
    expected = nothing.select("hash", F.lit(0).alias("page_count")) if pages is None else pages.groupBy("hash").agg((F.max("page_count") if "page_count" in pages.columns else F.max("page")).cast("int").alias("page_count"))

    before = known.where("kind = 'pdf' and status = 'importing'").where(F.col("mode") == mode).select("hash", F.col("id").alias("old_id"), F.col("start_record").alias("old_start"), F.col("item_count").alias("old_count"))
    s = fresh.join(per, "hash", "left").join(whole, "hash", "left").join(expected, "hash", "left").join(before, "hash", "left")
    s = s.join(marks.select("hash").distinct().withColumn("more_pages", F.lit(True)), "hash", "left")
    s = s.where("n > 0 or more_pages or (kind = 'pdf' and page_count is not null and old_id is null)")
    done = F.when(F.col("kind") == "image", F.lit("completed")).otherwise(F.when(F.coalesce("completed_page", F.lit(0)) >= F.col("page_count"), "completed").otherwise("importing"))
    s = written(s.select("*", done.alias("status"), *order[:1]), "sources")
    ids = placed(s.where("old_id is null").select("_key", "path", "hash"), ["_key", "path"]).select("hash", (F.col("place") + sources).alias("new_id"))
    s = s.join(ids, "hash", "left").select(
        F.coalesce("old_id", "new_id").alias("id"), F.lit(seq).alias("seq"), "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "hash", "kind", F.lit(mode).alias("mode"),
        F.coalesce("old_start", "first").alias("start_record"), (F.coalesce("old_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("item_count"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("completed_page", F.lit(0)).alias("completed_page"), "status",
    )
    s = written(s, "sources")
    numbered = made.join(s.select("hash", F.col("id").alias("source_id")), "hash").withColumns({"page": F.nullif("page", F.lit(0)), "item_index": F.nullif("item_index", F.lit(0))})
    store.write("gallery", numbered.repartitionByRange("record_no").sortWithinPartitions("record_no"), batch)
    store.write("pages", marks, batch)
    store.write("sources", s, batch)
    return _report(files, fresh, outcomes, expected)


def _report(files: DataFrame, fresh: DataFrame, outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """scanned, total_files, indexed, skipped, failed: one row. A page that failed is one failure, as is a PDF without crops."""
    n = lambda c: F.count(F.when(c, 1))
    one = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    empty = outcomes.where("page > 0").groupBy("hash").agg(n(F.col("item_index").isNotNull()).alias("detected")).where("detected = 0").select("hash")
    gone = fresh.where("kind = 'pdf'").join(expected.select("hash"), "hash", "left_anti").select("hash")  # no page was given
    parts = [
        one(files, scanned=F.count("*"), total_files=n(I.supported(F.col("path"))), skipped=F.count("*")), one(fresh, skipped=-F.count("*")),
        one(outcomes, indexed=n(F.col("status") == "indexed"), failed=n(F.col("status") == "failed")), one(empty.union(gone), failed=F.count("*")),
    ]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scanned", "total_files", "indexed", "skipped", "failed")])


def import_packed_index(store: Store, batch: str, shards: str, codes: str, sources_log: str) -> None:
    """Takes a packed index over into an empty store: shard files, the codes file, and the JSON lines of its sources.

    Record and source numbers stay as they are; the last line of a source counts. A batch that is
    there is not written again.
    """
    if store.has(batch):
        return
    if store.totals() != (0, 0, 0):
        raise ValueError("the store has records: their numbers would meet those of the packed index")
    spark = store.spark
    log = images_.read_lines(spark, sources_log, "id long, path string, name string, hash string, startRecord long, itemCount long, extractionMode string")
    log = written(log.withColumnsRenamed({"startRecord": "start_record", "itemCount": "item_count", "extractionMode": "mode"}), "log")
    rows = read_packed_index(spark, shards, codes).join(log.select(F.col("id").alias("source_id"), "hash"), "source_id", "left")
    store.write("gallery", rows.repartitionByRange("record_no").sortWithinPartitions("record_no"), batch)
    of_pdf = F.when(I.extension(F.col("path")) == I.PDF, "pdf").otherwise("image")
    # no state is known of these: a PDF with records is done, as is an image
    s = log.select("*", F.lit(0).alias("seq"), of_pdf.alias("kind"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("int").alias("completed_page"), F.lit(None).cast("string").alias("status"))
    store.write("sources", s, batch)


def import_stream(store: Store, folder: str, mode: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Imports the images that come into a folder, so many files at a time; a trigger that broke off is run again as the same batch."""
    spark = store.spark
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files)
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    hashed = stream.load(folder).select("path", images_.plain_path().alias("plain"), F.sha1("content").alias("hash"))

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        listing = written(batch, "files")
        paths = [r["path"] for r in listing.select("path").limit(files).collect()]  # as many as a trigger takes
        if paths:
            pictures = images_.read_images(session, paths, keep_invalid=True)
            import_batch(Store(session, store.folder), f"{run}-{number}", mode, listing.select(F.col("plain").alias("path"), "hash"), pictures)

    return hashed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_folder(store: Store, batch: str, mode: str, folder: str, pages: DataFrame | None = None, texts: DataFrame | None = None, page_size: tuple[float, float] = (900, 1200), modified_after: str | None = None) -> DataFrame:
    """import_batch() of the files under a folder; Spark decodes the images."""
    spark = store.spark
    return import_batch(store, batch, mode, listed(spark, folder, modified_after), decoded(spark, folder, modified_after), pages, texts, page_size)


def image_targets(pictures: DataFrame, target: Column) -> DataFrame:
    """target_id and the words of damaged images as search targets (t0 ... m0 ...); images without pixels are left out."""
    made = images_.image_records(pictures, TARGET).where("known is not null")
    return made.select(target.cast("long").alias("target_id"), *[F.col(f"w{k}").alias(f"t{k}") for k in range(len(WORDS))], *[f"m{k}" for k in range(len(WORDS))])


def search_store(store: Store, targets: DataFrame, mode: str) -> DataFrame:
    """The best records of the store's active sources for each usable target."""
    return search(store.gallery(), targets, store.sources(), mode)
