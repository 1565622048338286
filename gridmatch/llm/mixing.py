"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target over its
source's size. The expected copies are summed up in an order (size, a hash of the id, id), one
random offset per source is added, and a document is taken once per whole number that its stretch of
the sum crosses. Neighbours in that order are about equally long, so a source's taken words stay
within about one long document of its target. A document is taken at most ceil(rate) <= 3 times.

No window holds a whole source's documents: ranks come from three levels of counts (by size, by the
first two hash digits within a size, by document within those), each bounded by how many sizes or
digits there are, so a source with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A target is at most so many times its source's size.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> source, source_size, target, in double precision.

    Sources weigh 1, 2, 3, 1, 2, 3 ... by code point, null last, and share the sum of all sizes;
    what a source is given above 3 times its size goes to the others by weight, until none is above.
    In ascending order of size over weight the sources at their limit are a prefix, so one pass over
    the (few) sources finds the level at which the rest shares: that of the first source not at its
    limit, which is the greatest among those, for what is taken off after it is more than its share.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    w = w.select(
        "*",
        (F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double").alias("left_words"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double").alias("left_weight"),
    )
    level = F.col("left_words") / F.col("left_weight")
    full = level * F.col("weight") >= (MOST * F.col("source_size")).cast("double")
    w = w.withColumn("level", level).withColumn("open_level", F.max(F.when(~full, level)).over(whole))
    limit = (MOST * F.col("source_size")).cast("double")
    return w.select("source", "source_size", F.when(full, limit).otherwise(F.least(limit, F.col("open_level") * F.col("weight"))).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) from the source's name and the seed: reruns agree."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))), 1, 8)
    return F.conv(h, 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document, and its `carried` columns.

    A null text has size 0 and a null source is a source of its own. Rows with equal ids are
    separate documents, ordered by a hash of their texts, so that reruns take the same ones. If all sizes
    are 0 the targets are 0 and nothing is taken; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"), *carried)
    d = d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("cell", F.substring("h", 1, 2))
    cells = d.groupBy("source", "size", "cell").agg(F.count("*").alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    start = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    size_start = by_size.select("source", "size", F.coalesce(F.sum("n").over(start), F.lit(0)).alias("size_start"))
    within = W.partitionBy("source", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cell_start = cells.select("source", "size", "cell", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("cell_start"))
    r = d.withColumn("row", F.row_number().over(W.partitionBy("source", "size", "cell").orderBy("h", "doc_id", "tie")))
    same = lambda x, y, cols: [x[c].eqNullSafe(y[c]) for c in cols]
    starts = cell_start.join(size_start, same(cell_start, size_start, ["source", "size"])).select(cell_start["source"], cell_start["size"], "cell", (F.col("cell_start") + F.col("size_start")).alias("before"))
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"], "size", "cell", "before", "source_size", "target")
    r = r.join(starts, same(r, starts, ["source", "size", "cell"])).select("doc_id", r["source"], r["size"], "source_size", "target", *carried, (F.col("before") + F.col("row")).alias("rank"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    crossed = F.floor(F.col("rank") * rate + u) - F.floor((F.col("rank") - 1) * rate + u)
    return r.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Each row is carried through the ranking whole and repeated by its own copies, so rows that share
    an id, or have none, are documents of their own.
    """
    taken = mix(docs.withColumn("_row", F.struct(*docs.columns)), seed, carried=("_row",)).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM w
  WINDOW b AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, level * weight >= CAST(3 * source_size AS DOUBLE) AS is_full, max(CASE WHEN NOT level * weight >= CAST(3 * source_size AS DOUBLE) THEN level END) OVER () AS open_level FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE least(CAST(3 * source_size AS DOUBLE), open_level * weight) END AS target,
    CAST(('0x' || substr(md5('mix:' || coalesce('=' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296e0 AS u
  FROM o
), r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM d
), c AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate, r.rank, t.u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT) * size AS taken FROM c
"""
