"""Places in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import written


def placed(df: DataFrame, keys: list[Column | str], name: str = "place", parts: int | None = None, total: str | None = None, total_name: str = "before") -> DataFrame:
    """df with each row's place (from 0) in the order of keys, as a table in that order.

    Rows are dealt over ranges of the keys and numbered within them; the only thing summed up is one
    count for each range, of which there are as many as shuffle partitions (or parts). Keys that end
    with a unique one split any group of rows that share the others. Equal keys are placed anyhow.
    With total, total_name is the sum of that column over all rows before.
    """
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    row = f"_{name}_row"
    # the upper bits are the range's number, the lower 33 the row's within it; the table settles both
    t = written(ranged.sortWithinPartitions(*keys).withColumn(row, F.monotonically_increasing_id()), name)
    part, within = F.shiftright(row, 33), F.col(row).bitwiseAND((1 << 33) - 1)
    counts = t.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.coalesce(F.sum(total) if total else F.lit(0), F.lit(0)).alias("_sum"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")])
    out = t.join(before, part == before["_part"]).withColumn(name, F.col("_n_before") + within)
    if total:
        here = W.partitionBy("_part").orderBy(row).rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn(total_name, F.col("_sum_before") + F.coalesce(F.sum(total).over(here), F.lit(0)))
    return out.drop(row, "_part", "_n_before", "_sum_before")
