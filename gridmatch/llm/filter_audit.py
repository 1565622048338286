"""What five filters remove in each of the 120 orders they can run in.

One pass over the texts turns each document into five failure bits (all but the last are a matter of
the text alone; whether an earlier document has the same text is told by a digest). A second pass
looks the bits up in a table of 32 rows by 120 orders, which holds the step at which a document with
these bits goes, and counts part x order x step x label by np.bincount. Each task hands on one row of
sums for each part and order, which are summed again. Everything else follows from those sums: who
fails a filter is who it removes as the first, and who fails it alone is who it removes as the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, text_bytes, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Labels: bit 0 for quality, bit 1 for toxic.
LABELS = 4
#: Fewest words, least share of distinct words, greatest share of capitals, marks.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
#: Bytes of text and documents handled at once.
SLICE, ROWS = 2 << 20, 4096

_IS_MARK = np.isin(np.arange(256), list(MARKS))


def _lookup() -> np.ndarray:
    """The step (1 to 5) at which a document with these failure bits goes in each order; 0 if it stays."""
    table = np.zeros((1 << STEPS, len(ORDERS)), np.int8)
    for o, order in enumerate(ORDERS):
        for step in range(STEPS, 0, -1):  # an earlier failure takes the place of a later one
            fails = np.arange(1 << STEPS) >> FILTERS.index(order[step - 1]) & 1 == 1
            table[fails, o] = step
    return table


LOOKUP = _lookup()
SUMS = [f"n{step}_{label}" for step in range(STEPS + 1) for label in range(LABELS)]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, the failure bits of A to D, and a digest of each text."""
    for b in batches:
        data, offsets = text_bytes(b.column(2))
        for i, j in in_slices(offsets, SLICE):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            total = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[o])  # noqa: B023, E731
            capitals, points, marks = total((d >= 65) & (d <= 90)), total((d & 0xC0) != 0x80), total(_IS_MARK[d])
            raw, words, distinct, digests = d.tobytes(), [], [], []
            for x, y in zip(o[:-1], o[1:], strict=True):
                w = raw[x:y].split()  # at the bytes 9 to 13 and 32
                words.append(len(w))
                distinct.append(len(set(w)))
                digests.append(xxhash.xxh3_128_digest(raw[x:y]))
            n = np.array(words)
            bits = (n < LEAST_WORDS) * 1 + (100 * np.array(distinct) < DISTINCT * n) * 2 + (100 * capitals > CAPITALS * points) * 4 + (marks > 0) * 8
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(bits.astype(np.int32)), pa.array(digests, pa.binary())], ["doc_id", "part", "bits", "digest"])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and bits (1 for A, 2 for B ... 16 for E) of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text"))
    marked = written(d.mapInArrow(_marked, "doc_id long, part string, bits int, digest binary"), "marked")
    # only texts of several rows have an earlier one; rows of one text meet in sums before the shuffle
    least = marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return marked.join(least, "digest", "left").select("doc_id", "part", (F.col("bits") + F.when(again, 16).otherwise(0)).alias("bits"))


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: for each part and order, how many documents of each label go at each step."""
    parts: dict[str, int] = {}
    sums = np.zeros((0, len(ORDERS), (STEPS + 1) * LABELS), np.int64)
    order = np.arange(len(ORDERS))
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            s = b.slice(i, ROWS)
            named = s.column(0).dictionary_encode()
            number = np.array([parts.setdefault(p, len(parts)) for p in named.dictionary.to_pylist()], np.int64)
            if len(parts) > len(sums):
                sums = np.concatenate((sums, np.zeros((len(parts) - len(sums), *sums.shape[1:]), np.int64)))
            mine, part = np.unique(number[named.indices.to_numpy()], return_inverse=True)
            step = LOOKUP[s.column(1).to_numpy()]
            at = ((part[:, None] * len(ORDERS) + order) * (STEPS + 1) + step) * LABELS + s.column(2).to_numpy()[:, None]
            sums[mine] += np.bincount(at.ravel(), minlength=len(mine) * sums[0].size).reshape(len(mine), *sums.shape[1:])
    for name, k in parts.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(ORDERS)), pa.array(ORDERS), *[pa.array(np.ascontiguousarray(sums[k, :, c])) for c in range(len(SUMS))]], ["part", "filter_order", *SUMS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. A null text
    is empty, a null source is the part with the empty name. A document is good (toxic) if any of the
    labels of its id says so; without an id it has none. Filter E looks for smaller ids: rows without
    an id and rows of one id are no copies of each other. An empty table gives an empty result.
    """
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((flag("quality") + 2 * flag("toxic")).alias("label")).where("label > 0")
    rows = failures(docs).join(marks, "doc_id", "left").select("part", "bits", F.coalesce("label", F.lit(0)).alias("label"))
    schema = "part string, filter_order string, " + ", ".join(f"{c} long" for c in SUMS)
    sums = written(rows.mapInArrow(_removals, schema).groupBy("part", "filter_order").agg(*[F.sum(c).alias(c) for c in SUMS]), "removals")
    of = lambda step, labels: sum((F.col(f"n{step}_{label}") for label in labels), F.lit(0))
    at = [F.struct(F.lit(k).alias("step"), of(k, range(LABELS)).alias("removed"), of(k, (1, 3)).alias("good_lost"), of(k, (2, 3)).alias("toxic_lost"), sum((of(later, range(LABELS)) for later in (0, *range(k + 1, STEPS + 1))), F.lit(0)).alias("kept")) for k in range(1, STEPS + 1)]
    each = sums.select("part", "filter_order", F.explode(F.array(*at)).alias("s")).select("part", "filter_order", "s.*").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    alone = lambda step: F.max(F.when(F.col("step") == step, F.col("removed")))
    by_filter = each.groupBy("part", "letter").agg(alone(1).alias("fails"), alone(STEPS).alias("unique_fails"), F.sum("removed").alias("shapley"))
    out = each.join(by_filter, ["part", "letter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), m AS (
  SELECT part, (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e,
    coalesce(quality, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), g AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a + b + c + d + e AS many, good, toxic, count(*) AS n FROM m GROUP BY ALL
), f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), w AS (
  SELECT filter_order, k AS step, substr(filter_order, k, 1) AS letter, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) t(k)
), v AS (
  SELECT g.*, w.*, fails[letter] = 1 AS fail, len(list_filter(range(1, step), lambda k: fails[substr(filter_order, k, 1)] = 1)) > 0 AS gone FROM g, w
), s AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND many = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fail AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fail AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM v GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""
