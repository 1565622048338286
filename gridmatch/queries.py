"""Queries of the grid library over the given tables, and the SQL they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import bits as B
from .jobs import build as BD
from .jobs import fine as FS
from .jobs import preview as PV
from .jobs import search as S
from .operators import crops as C
from .operators import features as V
from .operators import index as I
from .operators import order as O
from .operators import raster as R
from .sources import fixtures as X
from .sources import records as P
from .sources.living import Store
from .sources.tables import shared_dir, written

N = range(B.WORDS)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def count_sql(expr: str) -> str:
    """Set bits over all words; {k} stands for the word's number."""
    return _sum(f"CAST(bit_count({expr.replace('{k}', str(k))}) AS BIGINT)" for k in N)


def percent_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 1e4 + 0.5e0) / 1e2 ELSE 0e0 END"


COUNTED = f"counted AS (SELECT *, 441 - known AS unknown, known - black AS white, {percent_sql('known', '441')} AS known_ratio FROM (SELECT *, {count_sql('m{k}')} AS known, {count_sql('(t{k} & m{k})')} AS black FROM targets))"
USABLE = "usable AS (SELECT * FROM counted WHERE known >= 35 AND black >= 5 AND white >= 5)"
#: Cell (x, y) of words of a prefix, by its number i from 0 to 440.
CELL = lambda p: "CASE " + " ".join(f"WHEN i < {63 * (k + 1)} THEN ({p}{k} >> (i - {63 * k})) & 1" for k in N) + " END"
LIVE = f"live AS (SELECT g.* FROM gallery g JOIN sources s ON s.id = g.source_id WHERE s.item_count > 0 AND s.mode = '{X.MODE}')"
SHORT = f"short AS (SELECT * FROM (SELECT l.*, u.target_id, {', '.join(f'u.t{k}, u.m{k}' for k in N)}, u.known, {count_sql('(xor(l.w{k}, u.t{k}) & u.m{k})')} AS mismatch FROM live l, usable u) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY mismatch, record_no) <= 200)"
#: Mismatching cells with a direct neighbour in the candidate that equals the target's cell, one by one.
NEAR = f"""cells AS (SELECT target_id, record_no, i, i % 21 AS x, i // 21 AS y, {CELL("t")} AS t, {CELL("m")} AS m, {CELL("w")} AS c FROM short, range(441) r(i)),
wide AS (SELECT *, lag(c) OVER row_ AS l, lead(c) OVER row_ AS r, lag(c) OVER col_ AS u, lead(c) OVER col_ AS d FROM cells WINDOW row_ AS (PARTITION BY target_id, record_no, y ORDER BY x), col_ AS (PARTITION BY target_id, record_no, x ORDER BY y)),
near AS (SELECT target_id, record_no, CAST(count(*) FILTER (m = 1 AND t <> c AND (coalesce(l = t, false) OR coalesce(r = t, false) OR coalesce(u = t, false) OR coalesce(d = t, false))) AS BIGINT) AS near FROM wide GROUP BY ALL),
rescored AS (SELECT short.*, near, {percent_sql("(known - mismatch)", "known")} AS score, floor((CAST(known - mismatch AS DOUBLE) + 0.6e0 * near) / CAST(known AS DOUBLE) * 1e4 + 0.5e0) / 1e2 AS tolerant FROM short JOIN near USING (target_id, record_no))"""
BASE = f"WITH {X.GALLERY_SQL}, {X.TARGETS_SQL}, {X.SOURCES_SQL}, {COUNTED}, {USABLE}, {LIVE}, {SHORT}"
TOP = "best AS (SELECT *, greatest(score, tolerant) AS final FROM rescored), top AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY final DESC, score DESC, record_no) AS rank FROM best QUALIFY rank <= 5)"


def _live(spark, sf_dir):
    sources = latest(X.sources_log(spark, sf_dir))
    return X.gallery(spark, sf_dir).join(S.active(sources, X.MODE).select(F.col("id").alias("source_id")), "source_id")


def latest(log: DataFrame) -> DataFrame:
    """The last row of each id of an append log."""
    return log.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("seq")))).where("_n = 1").drop("_n", "seq")


def _targets(spark, sf_dir):
    return S.usable(S.with_counts(X.targets(spark, sf_dir)))


@query(f"{BASE}, {NEAR}, {TOP} SELECT target_id, CAST(rank AS INT) AS rank, 'qrbin:' || record_no AS id, coalesce(s.name, 'PDF图库') || CASE WHEN page IS NULL THEN '' ELSE ' 第' || page || '页 #' || coalesce(CAST(item_index AS VARCHAR), '?') END || coalesce(' ' || code, '') AS display, code, score, tolerant, final, final >= 95 AS high_confidence FROM top LEFT JOIN sources s ON s.id = source_id")
def search_top5(spark, sf_dir):
    """The flagship: five best records of active sources for each usable target."""
    return S.search(X.gallery(spark, sf_dir), X.targets(spark, sf_dir), latest(X.sources_log(spark, sf_dir)), X.MODE)


@query(f"{BASE} SELECT target_id, record_no, mismatch FROM short")
def shortlist_by_columns(spark, sf_dir):
    return S.shortlist_sql(_live(spark, sf_dir), _targets(spark, sf_dir)).select("target_id", "record_no", "mismatch")


@query(f"{BASE} SELECT target_id, record_no, mismatch FROM short")
def shortlist_by_tasks(spark, sf_dir):
    return S.shortlist(_live(spark, sf_dir), _targets(spark, sf_dir)).select("target_id", "record_no", "mismatch")


@query(f"{BASE}, {NEAR} SELECT target_id, record_no, near, score, tolerant FROM rescored")
def tolerant_scores(spark, sf_dir):
    return S.rescored(S.shortlist(_live(spark, sf_dir), _targets(spark, sf_dir))).select("target_id", "record_no", "near", "score", "tolerant")


@query(f"WITH {X.GALLERY_SQL}, {X.TARGETS_SQL}, {COUNTED}, {USABLE} SELECT record_no, max({percent_sql('(known - ' + count_sql('(xor(w{k}, t{k}) & m{k})') + ')', 'known')}) AS best FROM gallery, usable GROUP BY record_no")
def best_score_of_record(spark, sf_dir):
    return S.best_scores(X.gallery(spark, sf_dir), _targets(spark, sf_dir))


@query(f"{BASE}, {NEAR}, {TOP} SELECT target_id, CAST(count(*) FILTER (final >= 95) AS BIGINT) AS n_high, max(final) AS best FROM top GROUP BY target_id")
def high_confidence_counts(spark, sf_dir):
    found = S.top(S.rescored(S.shortlist(_live(spark, sf_dir), _targets(spark, sf_dir))))
    return found.groupBy("target_id").agg(F.sum((F.col("final") >= S.HIGH).cast("bigint")).alias("n_high"), F.max("final").alias("best"))


@query(f"WITH {X.TARGETS_SQL}, {COUNTED} SELECT target_id, known, black, white, unknown, known_ratio, known >= 35 AND black >= 5 AND white >= 5 AS usable FROM counted")
def target_counts(spark, sf_dir):
    ok = (F.col("known") >= 35) & (F.col("black") >= 5) & (F.col("white") >= 5)
    return S.with_counts(X.targets(spark, sf_dir)).select("target_id", "known", "black", "white", "unknown", "known_ratio", ok.alias("usable"))


@query(f"WITH {X.GALLERY_SQL}, c AS (SELECT record_no, i, {CELL('w')} AS v FROM gallery, range(441) r(i)) SELECT record_no, string_agg(CAST(v AS VARCHAR), '' ORDER BY i) AS cells, CAST(sum(v) AS BIGINT) AS black FROM c GROUP BY record_no")
def unpacked_cells(spark, sf_dir):
    g = X.gallery(spark, sf_dir)
    return g.select("record_no", F.array_join(F.transform(B.cells(S.G), lambda v: v.cast("string")), "").alias("cells"), B.popcount(S.G).cast("bigint").alias("black"))


@query(f"WITH {X.GALLERY_SQL} SELECT record_no, {', '.join(f'w{k}' for k in N)} FROM gallery")
def packed_again(spark, sf_dir):
    g = X.gallery(spark, sf_dir).select("record_no", B.cells(S.G).alias("cells"))
    return g.select("record_no", *[w.alias(f"w{k}") for k, w in enumerate(B.pack(F.col("cells")))])


_TURN = {0: "i", 1: "(i % 21) * 21 + 20 - i // 21", 2: "440 - i", 3: "(20 - i % 21) * 21 + i // 21"}


@query(f"WITH {X.TARGETS_SQL}, c AS (SELECT target_id, i, {CELL('t')} AS v FROM targets, range(441) r(i)), turned AS (" + " UNION ALL ".join(f"SELECT target_id, {r} AS turns, {e} AS j, v FROM c" for r, e in _TURN.items()) + ") SELECT target_id, turns, string_agg(CAST(v AS VARCHAR), '' ORDER BY j) AS cells FROM turned GROUP BY ALL")
def rotated_grids(spark, sf_dir):
    t, out = X.targets(spark, sf_dir), None
    for r in range(4):
        words = written(t.select("target_id", *[w.alias(f"r{k}") for k, w in enumerate(B.rotated(S.T, r))]), "turned")
        part = words.select("target_id", F.lit(r).alias("turns"), F.array_join(F.transform(B.cells(B.cols("r")), lambda v: v.cast("string")), "").alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


def _turned_sql(p: str, turn: int) -> str:
    """Words of a grid turned so that cell i of the result is what _TURN moves there."""
    inverse = {0: "i", 1: "(20 - i % 21) * 21 + i // 21", 2: "440 - i", 3: "(i % 21) * 21 + 20 - i // 21"}[turn]
    at = f"({inverse})"
    return "CASE " + " ".join(f"WHEN {at} < {63 * (k + 1)} THEN ({p}{k} >> ({at} - {63 * k})) & 1" for k in N) + " END"


@query(
    f"WITH {X.GALLERY_SQL}, {X.TARGETS_SQL}, {COUNTED}, {USABLE}, "
    + "tc AS (SELECT target_id, known, i, turns, CASE turns " + " ".join(f"WHEN {r} THEN {_turned_sql('t', (4 - r) % 4)}" for r in range(4)) + " END AS t, CASE turns " + " ".join(f"WHEN {r} THEN {_turned_sql('m', (4 - r) % 4)}" for r in range(4)) + " END AS m FROM usable, range(441) r(i), range(4) q(turns)), "
    + "tw AS (SELECT target_id, known, turns, " + ", ".join(f"CAST(sum(CASE WHEN i // 63 = {k} THEN {v} << (i % 63) ELSE 0 END) AS BIGINT) AS {v}{k}" for k in N for v in "tm") + " FROM tc GROUP BY ALL), "
    + f"p AS (SELECT target_id, record_no, known, min({count_sql('(xor(w{k}, t{k}) & m{k})')}) AS mismatch FROM tw, gallery GROUP BY ALL) "
    + f"SELECT target_id, record_no, {percent_sql('(known - mismatch)', 'known')} AS score FROM p QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY mismatch, record_no) <= 5"
)
def rotated_match_top5(spark, sf_dir):
    """Best over four turns of the candidate: the target is turned instead."""
    best = S.turned_shortlist(X.gallery(spark, sf_dir), _targets(spark, sf_dir))
    return best.select("target_id", "record_no", B.percent(F.col("known") - F.col("mismatch"), F.col("known")).alias("score"))


@query(
    f"{BASE}, cells AS (SELECT target_id, record_no, i, i % 21 / 20e0 AS x, i // 21 / 20e0 AS y, {CELL('t')} AS t, {CELL('m')} AS m, {', '.join(f'{_turned_sql("w", r)} AS c{r}' for r in range(4))} FROM short, range(441) r(i)), "
    "w AS (SELECT *, CASE WHEN (x < 0.31e0 AND (y < 0.31e0 OR y > 0.69e0)) OR (x > 0.69e0 AND y < 0.31e0) THEN 8 ELSE 100 END AS weight FROM cells WHERE m = 1), "
    "s AS (SELECT target_id, record_no, sum(weight) FILTER (t = 1) / 1e2 AS black, coalesce(sum(weight) FILTER (t = 0), 0) / 1e2 AS white, " + ", ".join(f"coalesce(sum(weight) FILTER (t = 1 AND c{r} = 1), 0) / 1e2 AS b{r}, coalesce(sum(weight) FILTER (t = 0 AND c{r} = 0), 0) / 1e2 AS v{r}" for r in range(4)) + " FROM w GROUP BY ALL) "
    "SELECT target_id, record_no, floor(CASE WHEN black >= 10 THEN greatest(" + ", ".join(f"b{r} / black * 0.72e0 + CASE WHEN white > 0 THEN v{r} / white ELSE 0 END * 0.28e0" for r in range(4)) + ") ELSE 0e0 END * 1e4 + 0.5e0) / 1e2 AS weighted FROM s"
)
def weighted_scores(spark, sf_dir):
    t = _targets(spark, sf_dir)
    rows = S.shortlist(_live(spark, sf_dir), t).select("target_id", "record_no", *S.G).join(S.turned_targets(t), "target_id")
    return S.weighted_best(rows).select("target_id", "record_no", "weighted")


@query(f"WITH {X.SOURCES_SQL} SELECT id, name, item_count, mode, item_count > 0 AND mode = '{X.MODE}' AS active FROM sources")
def latest_sources(spark, sf_dir):
    return latest(X.sources_log(spark, sf_dir)).withColumn("active", (F.col("item_count") > 0) & (F.col("mode") == X.MODE))


@query(f"WITH {X.SOURCES_SQL} SELECT CAST(coalesce(sum(item_count) FILTER (item_count > 0 AND mode = '{X.MODE}'), 0) AS BIGINT) AS active_records, count(*) FILTER (item_count > 0) AS source_count, CAST(sum(item_count) AS BIGINT) AS total_records FROM sources")
def source_totals(spark, sf_dir):
    live = (F.col("item_count") > 0) & (F.col("mode") == X.MODE)
    return latest(X.sources_log(spark, sf_dir)).agg(F.coalesce(F.sum(F.when(live, F.col("item_count"))), F.lit(0)).alias("active_records"), F.count(F.when(F.col("item_count") > 0, 1)).alias("source_count"), F.sum("item_count").alias("total_records"))


_EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_SUPPORTED = f"{_EXT} IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp', '.tif', '.tiff', '.pdf')"


@query(f"WITH {X.FILES_SQL} SELECT {_EXT} AS ext, count(*) AS scanned, count(*) FILTER ({_SUPPORTED}) AS total_files, count(*) FILTER (NOT {_SUPPORTED}) AS skipped FROM files GROUP BY 1")
def import_listing(spark, sf_dir):
    p = F.col("path")
    return X.files(spark, sf_dir).groupBy(I.extension(p).alias("ext")).agg(F.count("*").alias("scanned"), F.count(F.when(I.supported(p), 1)).alias("total_files"), F.count(F.when(~I.supported(p), 1)).alias("skipped"))


@query(f"WITH {X.FILES_SQL}, {X.KNOWN_SQL} SELECT file_no, path, f.hash, substr(sha1(path || '|' || f.hash), 1, 16) AS item_id FROM files f WHERE {_SUPPORTED} AND NOT EXISTS (SELECT 1 FROM known_files k WHERE k.hash = f.hash AND k.mode = '{X.MODE}') QUALIFY row_number() OVER (PARTITION BY f.hash ORDER BY CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT), path) = 1")
def new_files(spark, sf_dir):
    """Basenames here are numbers, so natural order is that of their number."""
    found = I.new_files(X.files(spark, sf_dir), X.known_files(spark, sf_dir), X.MODE)
    return found.select("file_no", "path", "hash", I.item_id(F.col("path"), F.col("hash")).alias("item_id"))


@query(f"WITH {X.FILES_SQL} SELECT path, row_number() OVER (ORDER BY CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)) AS place FROM files")
def natural_order(spark, sf_dir):
    """Places from 1, ranked within ranges of the key."""
    f = X.files(spark, sf_dir).withColumn("key", I.natural_key(F.col("path")))
    return O.placed(f, ["key", "path"]).select("path", (F.col("place") + 1).alias("place"))


_SCANS = "scans AS (SELECT doc_id, 'in/' || doc_id % 7 || '/Scan of the archive, shelf and box ' || doc_id % 97 || '-' || lpad(CAST(doc_id % 1000 AS VARCHAR), CAST(3 + doc_id % 5 AS INT), '0') || CASE WHEN doc_id % 2 = 0 THEN '.PNG' ELSE 'b.png' END AS path FROM documents)"


@query(f"WITH {_SCANS} SELECT doc_id, row_number() OVER (ORDER BY doc_id % 97, doc_id % 1000, doc_id % 2, path, doc_id) - 1 AS place FROM scans")
def places_of_scans(spark, sf_dir):
    """Names that share 35 characters and differ in numbers, some with zeros before them."""
    i = F.col("doc_id")
    number = F.lpad((i % 1000).cast("string"), (3 + i % 5).cast("int"), "0")
    path = F.concat(F.lit("in/"), i % 7, F.lit("/Scan of the archive, shelf and box "), i % 97, F.lit("-"), number, F.when(i % 2 == 0, ".PNG").otherwise("b.png"))
    d = X.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return O.placed(d.withColumn("key", I.natural_key(F.col("path"))), ["key", "path", "doc_id"]).select("doc_id", "place")


@query("SELECT doc_id, 'qrbin:' || doc_id AS id, doc_id AS parsed, true AS refused, '/srv/app/' || CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id ELSE 'data/' || doc_id END AS moved, CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id ELSE 'data/' || doc_id END AS stored FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, 'qrbin:' || doc_id, doc_id, true, '/other/' || doc_id, '/other/' || doc_id FROM documents WHERE doc_id % 3 = 2")
def ids_and_paths(spark, sf_dir):
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat("source", F.lit("/"), i)).when(i % 3 == 1, F.concat(F.lit("/old/data/x/data/"), i)).otherwise(F.concat(F.lit("/other/"), i))
    d = X.table(spark, sf_dir, "documents").select("doc_id", S.record_id(i).alias("id"), S.parse_record_id(S.record_id(i)).alias("parsed"), S.parse_record_id(F.concat(F.lit("qrbin:-"), i)).isNull().alias("refused"), I.relocated(path, "/srv/app").alias("moved"))
    return d.withColumn("stored", I.stored(F.col("moved"), "/srv/app"))


@query(f"WITH {X.GALLERY_SQL}, c AS (SELECT record_no, i, {CELL('w')} AS v FROM gallery, range(441) r(i)) SELECT record_no, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"260\" height=\"260\" viewBox=\"0 0 260 260\"><rect width=\"100%\" height=\"100%\" fill=\"white\"/><g>' || coalesce(string_agg('<rect x=\"' || (46 + i % 21 * 8) || '\" y=\"' || (46 + i // 21 * 8) || '\" width=\"8\" height=\"8\" fill=\"#000\"/>', '' ORDER BY i) FILTER (v = 1), '') || '</g></svg>' AS svg FROM c GROUP BY record_no")
def rendered_svg(spark, sf_dir):
    return X.gallery(spark, sf_dir).select("record_no", R.svg(B.cells(S.G)).alias("svg"))


@query(f"WITH {X.OUTCOMES_SQL} SELECT source_id, count(*) AS scanned, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, coalesce(array_to_string(list_sort(list(DISTINCT error) FILTER (error IS NOT NULL)), ';'), '') AS errors FROM outcomes GROUP BY source_id")
def import_report(spark, sf_dir):
    return I.report(X.outcomes(spark, sf_dir))


@query(f"WITH {X.OUTCOMES_SQL} SELECT source_id, page, count(*) AS detected, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed FROM outcomes GROUP BY ALL")
def page_report(spark, sf_dir):
    return I.page_report(X.outcomes(spark, sf_dir))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 100 HOURS")
def retention(spark, sf_dir):
    return I.retained(X.outcomes(spark, sf_dir), 100, "2024-01-20 00:00:00").select("event_id")


@query(f"WITH {X.OUTCOMES_SQL}, r AS (SELECT source_id, page, event_id, row_number() OVER (ORDER BY source_id, page, event_id) - 1 AS record_no FROM outcomes WHERE status = 'indexed') SELECT event_id, record_no, min(record_no) OVER (PARTITION BY source_id) AS start_record FROM r")
def numbered_records(spark, sf_dir):
    made = X.outcomes(spark, sf_dir).where("status = 'indexed'").select("source_id", "page", F.col("event_id").alias("item"))
    return I.numbered(made).select(F.col("item").alias("event_id"), "record_no", "start_record")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN md5('s' || doc_id) WHEN doc_id % 5 <> 0 THEN md5('o' || doc_id) END AS grid, CASE WHEN doc_id % 3 = 0 THEN 'sidecar' WHEN doc_id % 5 <> 0 THEN 'own' ELSE 'none' END AS origin, doc_id % 3 <> 0 AS backfill FROM documents")
def sidecar_grids(spark, sf_dir):
    i = F.col("doc_id")
    d = X.table(spark, sf_dir, "documents")
    items = d.select(i.alias("id"), F.when(i % 5 != 0, F.md5(F.concat(F.lit("o"), i))).alias("grid"))
    side = d.where(i % 3 == 0).select(i.alias("id"), F.md5(F.concat(F.lit("s"), i)).alias("grid"))
    missing = I.to_backfill(items, side).select("id", F.lit(True).alias("backfill"))
    return I.preferred_grids(items, side).join(missing, "id", "left").withColumn("backfill", F.coalesce("backfill", F.lit(False)))


_PX = "px AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, pixels[i + 1] AS p, avg(pixels[i + 1]) OVER (PARTITION BY vec_id) AS mean FROM rasters, range(64) r(i))"


@query(
    f"WITH {X.RASTERS_SQL}, {_PX}, b AS (SELECT *, CAST(p < mean AS INT) AS bit, CAST(abs(p - mean) >= 18 AS INT) AS sure FROM px), "
    "n AS (SELECT *, lag(bit) OVER (PARTITION BY vec_id, y ORDER BY x) AS l, lag(bit) OVER (PARTITION BY vec_id, x ORDER BY y) AS u FROM b) "
    "SELECT vec_id, CAST(sum(bit) AS INT) AS black, CAST(count(*) FILTER (p < 145) AS INT) AS fixed, CAST(CASE WHEN sum(sure) < 0.35e0 * 64 THEN 64 ELSE sum(sure) END AS INT) AS valid, floor(CASE WHEN sum(sure) < 0.35e0 * 64 THEN 64 ELSE sum(sure) END / 64e0 * 1e4 + 0.5e0) / 1e2 AS valid_ratio, sum(bit) / 64e0 AS density, (count(*) FILTER (l <> bit) + count(*) FILTER (u <> bit)) / 112e0 AS edge FROM n GROUP BY vec_id"
)
def raster_counts(spark, sf_dir):
    return V.raster_features(X.rasters(spark, sf_dir)).select("vec_id", "black", "fixed", "valid", "valid_ratio", "density", "edge")


@query(
    f"WITH {X.RASTERS_SQL}, {_PX}, b AS (SELECT *, CAST(p < mean AS INT) AS bit FROM px), bl AS (SELECT vec_id, y // 2 * 4 + x // 2 AS k, CAST(floor(sum(bit) / 4e0 * 255e0 + 0.5e0) AS BIGINT) AS v FROM b GROUP BY ALL), ro AS (SELECT vec_id, y AS k, CAST(floor(sum(bit) / 8e0 * 255e0 + 0.5e0) AS BIGINT) AS v FROM b GROUP BY ALL), co AS (SELECT vec_id, x AS k, CAST(floor(sum(bit) / 8e0 * 255e0 + 0.5e0) AS BIGINT) AS v FROM b GROUP BY ALL) "
    "SELECT vec_id, array_to_string(list(v ORDER BY k), ' ') AS blocks, (SELECT array_to_string(list(v ORDER BY k), ' ') FROM ro WHERE ro.vec_id = bl.vec_id) AS rows, (SELECT array_to_string(list(v ORDER BY k), ' ') FROM co WHERE co.vec_id = bl.vec_id) AS cols FROM bl GROUP BY vec_id"
)
def raster_blocks(spark, sf_dir):
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return V.raster_features(X.rasters(spark, sf_dir)).select("vec_id", joined("blocks"), joined("rows"), joined("cols"))


def _nearest(spark, sf_dir, damaged: bool, keep: int = 20):
    """The nearest of all vectors' features for each target (ids divisible by 20)."""
    f = written(V.raster_features(X.rasters(spark, sf_dir)).withColumnRenamed("vec_id", "record_no").withColumn("error", F.lit(None).cast("string")), "features")
    t = f.where("record_no % 20 = 0").withColumnRenamed("record_no", "target_id")
    return FS.coarse_list(f, t, keep, damaged).select("target_id", F.col("place").alias("rank"), F.col("record_no").alias("vec_id"), F.col("distance").alias("d"))


_FEATURES = f"{X.RASTERS_SQL}, {_PX}, b AS (SELECT *, CAST(p < mean AS INT) AS bit FROM px), n AS (SELECT *, lag(bit) OVER (PARTITION BY vec_id, y ORDER BY x) AS l, lag(bit) OVER (PARTITION BY vec_id, x ORDER BY y) AS u FROM b), de AS (SELECT vec_id, sum(bit) / 64e0 AS density, (count(*) FILTER (l <> bit) + count(*) FILTER (u <> bit)) / 112e0 AS edge FROM n GROUP BY vec_id), v AS (SELECT vec_id, 'b' AS kind, y // 2 * 4 + x // 2 AS k, floor(sum(bit) / 4e0 * 255e0 + 0.5e0) AS v FROM b GROUP BY ALL UNION ALL SELECT vec_id, 'r', y, floor(sum(bit) / 8e0 * 255e0 + 0.5e0) FROM b GROUP BY ALL UNION ALL SELECT vec_id, 'c', x, floor(sum(bit) / 8e0 * 255e0 + 0.5e0) FROM b GROUP BY ALL)"


@query(f"WITH {_FEATURES}, p AS (SELECT t.vec_id AS target_id, c.vec_id, sqrt(sum((t.v - c.v) * (t.v - c.v)) FILTER (t.kind = 'b') / 16e0) + sum(abs(t.v - c.v)) FILTER (t.kind <> 'b') / 128e0 AS s FROM v t JOIN v c USING (kind, k) WHERE t.vec_id % 20 = 0 GROUP BY ALL), d AS (SELECT target_id, p.vec_id, round(s + abs(x.density - y.density) * 1800 + abs(x.edge - y.edge) * 900, 9) AS d FROM p JOIN de x ON x.vec_id = target_id JOIN de y ON y.vec_id = p.vec_id) SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY d, vec_id) AS INT) AS rank, vec_id, d FROM d QUALIFY rank <= 20")
def coarse_nearest(spark, sf_dir):
    return _nearest(spark, sf_dir, damaged=False)


@query(f"WITH {_FEATURES}, p AS (SELECT t.vec_id AS target_id, c.vec_id, t.kind, t.k, t.v AS x, c.v AS y FROM v t JOIN v c USING (kind, k) WHERE t.vec_id % 20 = 0), q AS (SELECT target_id, vec_id, sqrt(sum((greatest(0, x - y) ** 2 + (greatest(0, y - x) * 0.18e0) ** 2) * (0.35e0 + x / 255e0)) FILTER (kind = 'b' AND x / 255e0 >= 0.08e0 AND k NOT IN (0, 3, 12)) / count(*) FILTER (kind = 'b' AND x / 255e0 >= 0.08e0 AND k NOT IN (0, 3, 12))) AS block, sum(greatest(0, x - y) + greatest(0, y - x) * 0.12e0) FILTER (kind <> 'b' AND x > 18) / count(*) FILTER (kind <> 'b' AND x > 18) AS projection FROM p GROUP BY ALL), d AS (SELECT target_id, q.vec_id, round(coalesce(block, 999) + coalesce(projection, 999) + greatest(0, a.density - b.density) * 500, 9) AS d FROM q JOIN de a ON a.vec_id = target_id JOIN de b ON b.vec_id = q.vec_id) SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY d, vec_id) AS INT) AS rank, vec_id, d FROM d QUALIFY rank <= 20")
def damaged_nearest(spark, sf_dir):
    return _nearest(spark, sf_dir, damaged=True)


@query(f"WITH {X.GALLERY_SQL} SELECT record_no, source_id, coalesce(page, 0) AS page, coalesce(item_index, 0) AS item_index, {', '.join(f'w{k}' for k in N)} FROM gallery")
def parsed_shards(spark, sf_dir):
    """Records packed into 80 bytes and parsed again."""
    back = P.parse_records(P.packed_records(X.gallery(spark, sf_dir)))
    return back.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("page", "item_index")})


@query(f"WITH {X.GALLERY_SQL} SELECT record_no, CAST(441 AS INT) AS known, {', '.join(f'w{k}' for k in N)} FROM gallery")
def sampled_grids(spark, sf_dir):
    """Each gallery grid drawn as pixels and sampled back."""
    return R.sampled(R.drawn(X.gallery(spark, sf_dir)))


@query()
def crops_from_text(spark, sf_dir):
    """Boxes above the printed numbers of each page."""
    return C.crops_from_text(X.text_items(spark, sf_dir))


@query(f"WITH {X.TARGETS_SQL} SELECT min(target_id) AS target_id, count(*) AS n FROM (SELECT * FROM targets UNION ALL SELECT * REPLACE (target_id + 1000000 AS target_id) FROM targets) GROUP BY {', '.join(f't{k}, m{k}' for k in N)}")
def distinct_targets(spark, sf_dir):
    """Of equal grids (cells and mask) only the first stays; each is there twice."""
    t = X.targets(spark, sf_dir).withColumn("group_id", F.lit(1))
    twice = t.unionByName(t.withColumn("target_id", F.col("target_id") + 1_000_000))
    same = W.partitionBy("group_id", *S.T, *S.M)
    return S.distinct_grids(twice.withColumn("n", F.count("*").over(same))).select("target_id", "n")


@query(f"WITH {X.GALLERY_SQL}, c AS (SELECT record_no, i % 21 AS x, i // 21 AS y FROM (SELECT record_no, i, {CELL('w')} AS v FROM gallery, range(441) r(i)) WHERE v = 1), b AS (SELECT record_no, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM c GROUP BY record_no) SELECT record_no, w >= 0.68e0 * 21 AND h >= 0.68e0 * 21 AND w / CAST(h AS DOUBLE) BETWEEN 0.7e0 AND 1.45e0 AS square FROM b")
def square_grids(spark, sf_dir):
    return X.gallery(spark, sf_dir).select("record_no", B.looks_square(S.G).alias("square"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN true ELSE (vec_id % 50 + 1) / CAST(vec_id % 45 + 1 AS DOUBLE) BETWEEN 0.9e0 AND 1.1e0 END AS searchable, CAST(greatest(0, vec_id % 40 - 5) AS INT) AS l, CAST(greatest(8, least(vec_id % 90, 64 - greatest(0, vec_id % 40 - 5))) AS INT) AS w FROM embeddings")
def items_and_crops(spark, sf_dir):
    i = F.col("vec_id")
    crop = I.clamped_crop(i % 40 - 5, i % 40 - 5, i % 90, i % 90, F.lit(64), F.lit(64))
    kind = F.when(i % 2 == 0, "pdf").otherwise("image")
    return X.table(spark, sf_dir, "embeddings").select("vec_id", I.searchable(kind, i % 50 + 1, i % 45 + 1).alias("searchable"), crop[0].cast("int").alias("l"), crop[2].cast("int").alias("w"))


@query("SELECT doc_id, code FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS code FROM documents)")
def attached_codes(spark, sf_dir):
    """One line of code text per record, found by its byte offset."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).otherwise("").alias("code"))
    d = d.withColumn("size", F.octet_length("code") + 1).withColumn("part", F.floor(F.col("doc_id") / 1000))
    sums = d.groupBy("part").agg(F.sum("size").alias("n"))
    starts = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("size").over(W.partitionBy("part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = written(d.withColumn("w", within).join(starts, "part").select("doc_id", "code", (F.col("start") + F.col("w")).alias("offset")), "codes")
    records = at.select("doc_id", F.col("offset").alias("code_offset"), F.octet_length("code").alias("code_length"))
    return I.with_codes(records, at.select("offset", "code")).select("doc_id", "code")


@query(
    "WITH p AS (SELECT doc_id % 50 AS target_id, 'qrbin:' || doc_id AS id, CAST(n_chars % 97 AS DOUBLE) AS score, 0 AS side, doc_id AS place FROM documents UNION ALL SELECT doc_id % 50, 'item-' || doc_id, CAST(n_chars % 89 AS DOUBLE), 1, doc_id FROM documents) "
    "SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, side, place) AS INT) AS rank, id, score FROM p QUALIFY rank <= 5"
)
def merged_results(spark, sf_dir):
    """The five best of both indexes' results for each target."""
    i = F.col("doc_id")
    d = X.table(spark, sf_dir, "documents")
    of = lambda prefix, most: d.select((i % 50).alias("target_id"), F.concat(F.lit(prefix), i).alias("id"), (F.col("n_chars") % most).cast("double").alias("score"), i.alias("place"))
    return S.merged_top(of("qrbin:", 97), of("item-", 89))


@query(
    "WITH s AS (SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) <> 64 THEN 'failed' WHEN vec_id % 3 = 0 THEN 'kept' ELSE 'built' END AS status FROM embeddings) "
    "SELECT status, count(*) AS n FROM s GROUP BY status"
)
def backfill_report(spark, sf_dir):
    """Features of one raster in three are known; the rest is computed now, and counted by outcome."""
    rasters = X.rasters(spark, sf_dir)
    known = V.raster_features(rasters.where("vec_id % 3 = 0 and size(pixels) = 64"))
    return I.backfill_counts(V.backfilled(rasters, known))


_AREA = "px2 AS (SELECT vec_id, x, y, CAST(p < mean AS INT) AS bit, CASE WHEN avg(CAST(abs(p - mean) >= 18 AS INT)) OVER (PARTITION BY vec_id) < 0.35e0 THEN 1 ELSE CAST(abs(p - mean) >= 18 AS INT) END AS sure FROM px)"


@query(
    f"WITH {X.RASTERS_SQL}, {_PX}, {_AREA}, c AS (SELECT vec_id, y // 2 * 4 + x // 2 AS k, CAST(sum(bit) / 4e0 >= 0.5e0 AS INT) AS v, CAST(sum(sure) / 4e0 >= 0.45e0 AS INT) AS s FROM px2 GROUP BY ALL), "
    "g AS (SELECT vec_id, string_agg(CAST(v AS VARCHAR), '' ORDER BY k) AS cells, string_agg(CAST(s AS VARCHAR), '' ORDER BY k) AS known FROM c GROUP BY 1), "
    "b AS (SELECT vec_id, coalesce(min(x) FILTER (bit = 1), 0) || ' ' || coalesce(min(y) FILTER (bit = 1), 0) || ' ' || coalesce(max(x) FILTER (bit = 1), 7) || ' ' || coalesce(max(y) FILTER (bit = 1), 7) AS box FROM px2 GROUP BY 1) "
    "SELECT vec_id, cells, known, box FROM g JOIN b USING (vec_id)"
)
def area_grids(spark, sf_dir):
    """Cells by area with their masks, and the box of the black pixels."""
    box = F.array_join(F.transform("box", lambda v: v.cast("string")), " ")
    return V.raster_features(X.rasters(spark, sf_dir)).select("vec_id", "cells", "known", box.alias("box"))


@query(
    f"WITH {X.TARGETS_SQL}, c AS (SELECT target_id, i, {CELL('t')} AS v, {CELL('m')} AS s FROM targets, range(441) r(i)) "
    "SELECT target_id, '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"260\" height=\"260\" viewBox=\"0 0 260 260\"><rect width=\"100%\" height=\"100%\" fill=\"white\"/><g>' || "
    "string_agg('<rect x=\"' || (46 + i % 21 * 8) || '\" y=\"' || (46 + i // 21 * 8) || '\" width=\"8\" height=\"8\" fill=\"' || CASE WHEN s = 0 THEN '#b8b8b8' WHEN v = 1 THEN '#000' ELSE '#fff' END || '\"/>', '' ORDER BY i) || '</g></svg>' AS svg FROM c GROUP BY 1"
)
def rendered_targets(spark, sf_dir):
    """Targets as pictures of three states."""
    return X.targets(spark, sf_dir).select("target_id", R.svg(B.cells(S.T), B.cells(S.M)).alias("svg"))


_STATES = f"""f AS (SELECT doc_id AS file_no, CASE WHEN doc_id % 2 = 0 THEN doc_id || '.PDF' ELSE doc_id || '.png' END AS path, sha1(text) AS hash FROM documents),
states AS (SELECT sha1(text) AS hash, CASE WHEN doc_id % 4 = 0 THEN 'completed' ELSE 'importing' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE '{X.MODE}' END AS mode FROM documents WHERE doc_id % 3 = 0),
known AS (SELECT sha1(text) AS hash, doc_id % 3 AS item_count FROM documents WHERE doc_id % 7 < 3)"""


@query(
    f"WITH {_STATES} SELECT file_no FROM f WHERE path LIKE '%.PDF' AND NOT EXISTS (SELECT 1 FROM states s WHERE s.hash = f.hash AND status = 'completed' AND mode = '{X.MODE}') "
    "AND NOT EXISTS (SELECT 1 FROM known k WHERE k.hash = f.hash AND item_count > 0 AND NOT EXISTS (SELECT 1 FROM states s WHERE s.hash = k.hash))"
)
def pdfs_to_import(spark, sf_dir):
    i, hash_ = F.col("doc_id"), F.sha1(F.encode("text", "UTF-8")).alias("hash")
    d = X.table(spark, sf_dir, "documents")
    files = d.select(i.alias("file_no"), F.concat(i.cast("string"), F.when(i % 2 == 0, ".PDF").otherwise(".png")).alias("path"), hash_)
    states = d.where(i % 3 == 0).select(hash_, F.when(i % 4 == 0, "completed").otherwise("importing").alias("status"), F.when(i % 5 == 0, "old").otherwise(X.MODE).alias("mode"))
    sources = d.where(i % 7 < 3).select(hash_, (i % 3).alias("item_count"))
    return I.pdfs_to_import(files, states, sources, X.MODE).select("file_no")


@query(
    f"WITH {X.GALLERY_SQL}, c AS (SELECT record_no, i % 21 AS x, i // 21 AS y FROM (SELECT record_no, i, {CELL('w')} AS v FROM gallery, range(441) r(i)) WHERE v = 1), "
    "b AS (SELECT record_no, record_no % 12 % 4 * 220 + 30 + 4 * min(x) - 2 AS x0, record_no % 12 % 4 * 220 + 30 + 4 * max(x) + 5 AS x1, record_no % 12 // 4 * 220 + 30 + 4 * min(y) - 2 AS y0, record_no % 12 // 4 * 220 + 30 + 4 * max(y) + 5 AS y1 FROM c GROUP BY 1), "
    "s AS (SELECT *, greatest(x1 - x0, y1 - y0) + 7 AS side FROM b) "
    'SELECT record_no // 12 AS page_id, CAST(row_number() OVER (PARTITION BY record_no // 12 ORDER BY record_no) AS INT) AS "index", CAST(floor((x0 + x1) / 2e0 - side / 2e0 + 0.5e0) AS INT) AS "left", CAST(floor((y0 + y1) / 2e0 - side / 2e0 + 0.5e0) AS INT) AS top, CAST(side AS INT) AS width, CAST(side AS INT) AS height FROM s'
)
def crops_from_pixels(spark, sf_dir):
    """Codes found on pages that show twelve gallery grids each."""
    pages = R.drawn_pages(X.gallery(spark, sf_dir))
    return C.crops_from_pixels(pages).select("page_id", "index", "left", "top", "width", "height")


@query()
def fine_nearest(spark, sf_dir):
    """Gallery grids as images. Targets, ids divisible by 100: turned and with a blot. The five best of each coarse list of the library's length."""
    images = R.drawn(X.gallery(spark, sf_dir)).withColumn("width", F.sqrt(F.octet_length("pixels")).cast("int"))
    items = written(FS.image_features(images), "items")
    asked = R.blotted(images.where("record_no % 100 = 0"), F.floor(F.col("record_no") / 100) % 4)
    targets = written(FS.image_features(asked, target=True).withColumnRenamed("record_no", "target_id"), "targets")
    return FS.fine_top(FS.coarse_list(items, targets), items, targets).select("target_id", "rank", "record_no", "score")


@query(f"WITH {X.GALLERY_SQL} SELECT record_no // 12 AS page_id, CAST(record_no % 12 + 1 AS INT) AS item, 'indexed' AS status, CAST(441 AS INT) AS known, {', '.join(f'w{k}' for k in N)} FROM gallery")
def grids_of_pages(spark, sf_dir):
    """Codes found on pages that show twelve gallery grids each, cut out and sampled: the gallery again."""
    found = C.crop_grids(R.drawn_pages(X.gallery(spark, sf_dir)))
    return found.where("index is not null").select("page_id", F.col("index").alias("item"), "status", "known", *S.G)


@query(
    f"WITH {X.GALLERY_SQL}, r AS (SELECT *, record_no // 48 AS s, record_no // 12 % 4 + 1 AS p, record_no % 12 + 1 AS i FROM gallery), "
    "b AS (SELECT *, CASE WHEN s % 3 = 0 OR (s % 3 = 1 AND p > 2) THEN 1 ELSE 0 END AS batch, CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS late FROM r), "
    "ids AS (SELECT s, row_number() OVER (ORDER BY late, s) - 1 AS source_id FROM (SELECT DISTINCT s, late FROM b)) "
    f"SELECT row_number() OVER (ORDER BY batch, s, p, i) - 1 AS record_no, ids.source_id, CAST(p AS INT) AS page, CAST(i AS INT) AS item_index, {', '.join(f'w{k}' for k in N)} FROM b JOIN ids USING (s)"
)
def imported_in_parts(spark, sf_dir):
    """The gallery drawn on pages of documents, imported in two batches: some documents come later, some in two parts."""
    number, page = F.col("page_id"), (F.floor(F.col("record_no") / 12) % 4 + 1).cast("int")
    # counted before drawing: rasters are long rows, which are not to be sorted
    counted = X.gallery(spark, sf_dir).withColumn("page_count", F.max(page).over(W.partitionBy(F.floor(F.col("record_no") / 48))))
    pages = R.drawn_pages(counted, keep=("page_count",)).select(F.concat(F.lit("h"), F.floor(number / 4)).alias("hash"), (number % 4 + 1).cast("int").alias("page"), "page_width", "pixels", "page_count")
    pages, of = written(pages, "pages", long_rows=True), F.expr("cast(substring(hash, 2) as long)")
    files = pages.select("hash").distinct().select(F.concat(F.lit("docs/Document "), of, F.lit(".pdf")).alias("path"), "hash")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    no_images = spark.createDataFrame([], "path string, width int, height int, pixels binary")
    BD.import_batch(store, "first", X.MODE, files.where(of % 3 != 0), no_images, pages.where((of % 3 == 2) | (F.col("page") <= 2)))
    BD.import_batch(store, "second", X.MODE, files, no_images, pages)
    return store.gallery().select("record_no", "source_id", "page", "item_index", *S.G)


_OLDER = f"""own AS (SELECT doc_id AS id, {', '.join(f'CASE WHEN doc_id % 5 <> 0 THEN {X.word_sql("doc_id", "o", k)} END AS w{k}' for k in N)} FROM documents),
side AS (SELECT doc_id AS id, {', '.join(f'xor({X.word_sql("(doc_id // 60 * 60)", "g", k)}, {X.all_of_sql("doc_id", X.FLIPS[:3], k)}) AS w{k}' for k in N)} FROM documents WHERE doc_id % 3 = 0),
older AS (SELECT o.id, {', '.join(f'coalesce(s.w{k}, o.w{k}) AS w{k}' for k in N)} FROM own o LEFT JOIN side s USING (id) WHERE s.id IS NOT NULL OR o.w0 IS NOT NULL)"""


@query(
    f"{BASE}, {NEAR}, {TOP}, {_OLDER}, "
    + "tc AS (SELECT target_id, known, i, turns, CASE turns " + " ".join(f"WHEN {r} THEN {_turned_sql('t', (4 - r) % 4)}" for r in range(4)) + " END AS t, CASE turns " + " ".join(f"WHEN {r} THEN {_turned_sql('m', (4 - r) % 4)}" for r in range(4)) + " END AS m FROM usable, range(441) r(i), range(4) q(turns)), "
    + "tw AS (SELECT target_id, known, turns, " + ", ".join(f"CAST(sum(CASE WHEN i // 63 = {k} THEN {v} << (i % 63) ELSE 0 END) AS BIGINT) AS {v}{k}" for k in N for v in "tm") + " FROM tc GROUP BY ALL), "
    + f"p AS (SELECT target_id, id, known, min({count_sql('(xor(w{k}, t{k}) & m{k})')}) AS mismatch FROM tw, older GROUP BY ALL), "
    + f"both_ AS (SELECT target_id, 'qrbin:' || record_no AS id, final AS score, 0 AS side, rank AS place FROM top UNION ALL SELECT target_id, 'item-' || id, {percent_sql('(known - mismatch)', 'known')}, 1, id FROM p) "
    + "SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, side, place) AS INT) AS rank, id, score FROM both_ QUALIFY rank <= 5"
)
def search_of_both_indexes(spark, sf_dir):
    """Targets against the packed gallery and against older items, whose sidecar grids resemble some targets, turned or not."""
    i = F.col("doc_id")
    d = X.table(spark, sf_dir, "documents").select("doc_id")
    own = written(d.select(i.alias("id"), *[F.when(i % 5 != 0, X.word(i, "o", k)).alias(f"w{k}") for k in N]), "own")
    like = (F.floor(i / 60) * 60).cast("bigint")
    side = written(d.where(i % 3 == 0).select(i.alias("id"), *[X.word(like, "g", k).bitwiseXOR(X.all_of(i, X.FLIPS[:3], k)).alias(f"w{k}") for k in N]), "side")
    return S.search_both(X.gallery(spark, sf_dir), latest(X.sources_log(spark, sf_dir)), X.MODE, own, side, X.targets(spark, sf_dir))


@query(
    f"WITH {X.OUTCOMES_SQL}, p AS (SELECT DISTINCT source_id, page + 1 AS page FROM outcomes WHERE status <> 'skipped'), s AS (SELECT source_id, count(*) FILTER (status = 'indexed') AS item_count FROM outcomes GROUP BY 1), "
    "m AS (SELECT s.source_id, min(k) AS missing FROM s, range(1, 15) r(k) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_id = s.source_id AND p.page = k) GROUP BY 1) "
    "SELECT source_id, CAST(missing - 1 AS INT) AS completed_page, item_count, coalesce(sum(item_count) OVER (ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_record FROM s JOIN m USING (source_id)"
)
def source_states(spark, sf_dir):
    """Each source's records, where they start, and its last page before a gap."""
    o = X.outcomes(spark, sf_dir).withColumn("hash", F.col("source_id"))
    gone = o.where("status <> 'skipped'").select("hash", (F.col("page") + 1).cast("int").alias("page")).distinct()
    pages = BD.last_whole_page(gone)
    counts = O.placed(o.groupBy("source_id").agg(F.count(F.when(F.col("status") == "indexed", 1)).alias("item_count")), ["source_id"], total="item_count", total_name="start_record")
    return counts.join(pages, F.col("source_id") == F.col("hash"), "left").select("source_id", F.coalesce("completed_page", F.lit(0)).alias("completed_page"), "item_count", "start_record")


_HALF = lambda v: f"CAST(floor({v} + 0.5e0) AS INT)"


@query(
    f"WITH {X.GALLERY_SQL}, c AS (SELECT record_no, i % 21 AS x, i // 21 AS y FROM (SELECT record_no, i, {CELL('w')} AS v FROM gallery, range(441) r(i)) WHERE v = 1), "
    f"b AS (SELECT record_no, greatest(0, {_HALF('(record_no % 40) - 5.5e0')}) AS l, greatest(0, {_HALF('(record_no % 31) - 3e0')}) AS t FROM gallery), "
    f"s AS (SELECT *, greatest(8, least({_HALF('(record_no % 300) + 4.5e0')}, 420 - l)) AS w, greatest(8, least(CAST(record_no % 200 * 3 AS INT), 420 - t)) AS h FROM b) "
    "SELECT s.record_no, w AS width, h AS height, CAST(sum(greatest(0, least(l + w, 20 * x + 20) - greatest(l, 20 * x)) * greatest(0, least(t + h, 20 * y + 20) - greatest(t, 20 * y))) AS INT) AS black FROM s JOIN c USING (record_no) GROUP BY ALL"
)
def cropped_images(spark, sf_dir):
    """Gallery grids as images, each cut to a crop that may begin or end outside: sizes and black pixels."""
    i = F.col("record_no")
    images = R.drawn(X.gallery(spark, sf_dir)).withColumns({"width": F.lit(420), "height": F.lit(420)})
    crops = images.withColumns({"x": i % 40 - F.lit(5.5), "y": (i % 31 - 3).cast("double"), "w": i % 300 + F.lit(4.5), "h": (i % 200 * 3).cast("double")})
    black = F.length(F.replace(F.decode("pixels", "ISO-8859-1"), F.lit("\u00ff"))).cast("int")
    return PV.cropped(crops).select("record_no", "width", "height", black.alias("black"))


@query(
    f"WITH {X.GALLERY_SQL}, {X.SOURCES_SQL}, a AS (SELECT coalesce(sum(item_count), 0) AS n FROM sources WHERE item_count > 0 AND mode = '{X.MODE}'), o AS (SELECT count(*) AS n FROM embeddings) "
    "SELECT CAST(a.n AS BIGINT) AS active_records, o.n AS older_items, CAST(a.n + o.n AS BIGINT) AS total FROM a, o"
)
def index_totals(spark, sf_dir):
    """Records of active sources, items of the older index, and both."""
    return I.index_totals(latest(X.sources_log(spark, sf_dir)), X.table(spark, sf_dir, "embeddings"), X.MODE)


@query(f"WITH {X.GALLERY_SQL} SELECT record_no, source_id, coalesce(page, 0) AS page, coalesce(item_index, 0) AS item_index, code, {', '.join(f'w{k}' for k in N)} FROM gallery")
def packed_index_again(spark, sf_dir):
    """The gallery as 80-byte records and files of code lines, and both read again: codes are found by byte offsets."""
    g = X.gallery(spark, sf_dir)
    lines = O.placed(g.select("record_no", F.coalesce("code", F.lit("")).alias("line")).withColumn("size", F.octet_length("line").cast("long") + 1), ["record_no"], total="size", total_name="code_offset")
    at = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    lines.orderBy("record_no").select("line").write.text(at)
    coded = g.join(lines.select("record_no", "code_offset", F.octet_length("line").alias("code_length")), "record_no")
    shards = P.packed_records(coded.drop("code").repartitionByRange("record_no").sortWithinPartitions("record_no"))
    back = I.with_codes(P.parse_records(shards, codes=True), P.line_offsets(spark, at))
    return back.select("record_no", "source_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("page", "item_index")], "code", *S.G)


@query(f"WITH {X.GALLERY_SQL} SELECT record_no, CAST(record_no % 12 + 1 AS INT) AS item, lpad(CAST(record_no AS VARCHAR), 7, '7') AS code, CAST(441 AS INT) AS known, {', '.join(f'w{k}' for k in N)} FROM gallery")
def printed_codes(spark, sf_dir):
    """Pages that show twelve grids with a number under each: numbers find the boxes, which are cut out and sampled."""
    g = X.gallery(spark, sf_dir)
    place, i = F.col("record_no") % 12, F.col("record_no")
    # a box of 87 pixels, 6 above a number of 150 x 12, lies around the 84 of a grid
    left, top = (place % 4) * 220 + 30, F.floor(place / 4) * 220 + 30
    numbers = g.select(F.floor(i / 12).alias("page_id"), F.concat(F.lit(" "), F.lpad(i.cast("string"), 7, "7")).alias("str"), (left + 42 - 75).cast("double").alias("x"), (top + 84 + 7).cast("double").alias("y"), F.lit(150.0).alias("width"), F.lit(12.0).alias("height"))
    noise = numbers.select("page_id", F.lit("page 12345").alias("str"), "x", (F.col("y") + 40).alias("y"), "width", "height")
    found = C.crop_grids(R.drawn_pages(g), C.crops_from_text(numbers.unionByName(noise), 910, 690)).where("status = 'indexed'")
    return found.select((F.col("page_id") * 12 + F.col("index") - 1).alias("record_no"), F.col("index").alias("item"), F.col("text").alias("code"), "known", *S.G)


@query(
    "WITH f AS (SELECT doc_id, n_chars, doc_id % 10 AS kind, CASE WHEN doc_id % 10 = 9 THEN doc_id - 9 ELSE doc_id END AS content FROM documents), p AS (SELECT doc_id AS s, k AS page, (doc_id + k) % 4 AS many FROM f, range(1, 4) r(k) WHERE kind IN (2, 3)), "
    "s AS (SELECT s, sum(many) FILTER (many > 0) AS detected FROM p GROUP BY s), d AS (SELECT CAST(coalesce(sum(many) FILTER (many < 3), 0) AS BIGINT) AS fine, count(*) FILTER (many = 3) AS lost FROM p), "
    "e AS (SELECT count(*) AS n FROM (SELECT s FROM p GROUP BY s HAVING coalesce(sum(many) FILTER (many < 3), 0) = 0)), "
    "i AS (SELECT count(*) FILTER (kind IN (0, 1)) AS good, count(*) FILTER (kind = 4) AS bad, count(*) FILTER (kind = 5) AS alone, count(*) FILTER (kind IN (6, 7, 8)) AS other, count(*) FILTER (kind = 9) AS again, count(*) AS n FROM f) "
    "SELECT i.n AS scanned, i.n - i.other AS total_files, i.good + d.fine AS indexed, i.other + i.again AS skipped, i.bad + d.lost + i.alone + e.n AS failed FROM i, d, e"
)
def build_report(spark, sf_dir):
    """Images that decode or don't, documents with 0 to 2 codes a page, pages that can't be rendered, documents without pages, copies and other files."""
    i = F.col("doc_id")
    kind = i % 10
    content = F.when(kind == 9, i - 9).otherwise(i)
    ext = F.when(kind.isin(2, 3, 5), ".pdf").when(kind.isin(6, 7, 8), ".txt").otherwise(".png")
    d = X.table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.concat(F.lit("in/"), i, ext).alias("path"), F.concat(F.lit("h"), content).alias("hash"))
    whole = F.col("kind") != 4
    raster = F.encode(F.repeat(F.lit("\u00ff"), 900), "ISO-8859-1")
    images = d.where("kind in (0, 1, 4)").select("path", *[F.when(whole, v).alias(c) for c, v in (("width", F.lit(30)), ("height", F.lit(30)), ("pixels", raster))])
    pages = d.where("kind in (2, 3)").select("hash", "doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    many = (F.col("doc_id") + F.col("page")) % 4
    pages = pages.select("hash", "page", F.lit(300).alias("page_width"), F.when(many < 3, F.encode(F.repeat(F.lit("\u00ff"), 90_000), "ISO-8859-1")).alias("pixels"), many.alias("many"))
    box = F.explode(F.when(F.col("many").isin(1, 2), F.sequence(F.lit(1), F.col("many").cast("int"))).otherwise(F.array().cast("array<int>")))
    texts = pages.select("hash", "page", box.alias("n")).select("hash", "page", F.lit("123456").alias("str"), (F.col("n") * 100 - 50).cast("double").alias("x"), F.lit(200.0).alias("y"), F.lit(90.0).alias("width"), F.lit(12.0).alias("height"))
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    return BD.import_batch(store, "first", X.MODE, d.select("path", "hash"), images, pages.drop("many"), texts, (300, 300))
