"""Approximate nearest neighbours with a hash-prefix forest.

Each of TREES trees gives a vector a hash string of BITS signs of random projections (about the mean
of all vectors). The vectors are dealt out over slices of bounded size; a slice keeps a sorted array
of its strings for each tree, and its vectors once. Queries are a stated set: every slice is asked
all of them, and they stream past it in batches. Searching goes in two steps:

1. Down: in every tree a query descends to the longest prefix that enough strings of the slice share.
   The exact distances of those, over all slices, bound the distance of its k-th neighbour.
2. Up: all trees ascend to one level together, the longest at which a vector within that bound would
   share a prefix in some tree with probability TARGET. Everything under it is compared exactly.

So the level follows the data: neighbours that stand out are found deep down, at little cost. No
vector is copied for a tree, and no task holds more than a slice and a batch of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

TREES, BITS = 24, 48
#: Strings that a descent ends with, at least; chance to meet the k-th neighbour.
ENOUGH, TARGET = 16, 0.9
#: Vectors of a slice: more of them only where there would be over SLICES otherwise, up to MOST.
SLICE, SLICES, MOST = 4096, 64, 65536


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(20240611).standard_normal((dim, TREES * BITS)).astype(np.float32)


def usable(vector: Column) -> Column:
    """No null, not empty, no null or non-finite component, not zero."""
    d = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(d, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(d, lambda x: x != 0), F.lit(False))


def _pack(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in m], pa.binary())], ["vec_id", "v"])

    return run


def _matrix(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _moments(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0).to_pylist(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1] + 1)), pa.array(np.append(m.sum(0), float((m * m).sum())))], ["k", "x"])

    return run


def _best(d: np.ndarray, rep: np.ndarray, k: int) -> np.ndarray:
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return near[np.lexsort((rep[near], d[near]))[:k]]
    return np.lexsort((rep, d))[:k]


class Slice:
    """The sorted strings of a slice in every tree, and its vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, center: np.ndarray):
        self.ids, self.vectors, self.center, self.planes = ids, vectors, center, _planes(len(center))
        strings = self.strings(vectors)
        self.order = np.argsort(strings, 0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(strings, self.order.T, 0).T.copy()

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """vectors x trees"""
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        out = np.empty((len(vectors), TREES), np.int64)
        for i in range(0, len(vectors), 1024):
            m = (vectors[i : i + 1024] - self.center).astype(np.float32)
            out[i : i + 1024] = (m @ self.planes > 0).reshape(len(m), TREES, BITS) @ weights
        return out

    def _range(self, tree: int, h: np.ndarray, shift: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The strings that share all but the last `shift` bits with h."""
        return np.searchsorted(self.sorted[tree], h >> shift << shift), np.searchsorted(self.sorted[tree], ((h >> shift) + 1) << shift)

    def descend(self, tree: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest prefixes that ENOUGH strings share (or all strings)."""
        low, high = np.zeros(len(h), np.int64), np.full(len(h), len(self.ids), np.int64)
        few, many = np.full(len(h), -1), np.full(len(h), BITS)  # shifts that give too few, and enough
        while (many - few > 1).any():
            mid = (few + many) >> 1
            a, b = self._range(tree, h, np.maximum(mid, 0))
            enough = (b - a >= ENOUGH) & (many - few > 1)
            low[enough], high[enough], many[enough] = a[enough], b[enough], mid[enough]
            less = ~enough & (many - few > 1)
            few[less] = mid[less]
        return low, high

    def ask(self, q: np.ndarray, vectors: np.ndarray, levels: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(q, id, distance) of each query's k nearest under its prefixes."""
        h = self.strings(vectors)
        ranges = [self.descend(t, h[:, t]) if levels is None else self._range(t, h[:, t], BITS - levels) for t in range(TREES)]
        out = []
        for i in range(len(q)):
            met = np.zeros(len(self.ids), bool)
            for t in range(TREES):
                met[self.order[t, ranges[t][0][i] : ranges[t][1][i]]] = True
            at = np.flatnonzero(met)
            d = np.sqrt(((self.vectors[at] - vectors[i]) ** 2).sum(1))
            best = _best(d, self.ids[at], k)
            out.append((np.full(len(best), q[i]), self.ids[at[best]], d[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(k: int, center: np.ndarray, kind: str):
    """Rows (slice, asks, id, level, v) sorted by slice and asks: a slice's vectors, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], None
        for b in batches:
            number, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), [True]))) if b.num_rows else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                ids, v = b.column(2).to_numpy()[i:j], _matrix(b.column(4).slice(i, j - i).to_pylist(), kind)
                if number[i] != now:
                    now, held, forest = number[i], [], None
                if not asks[i]:
                    held.append((ids, v))
                elif held or forest:
                    if not forest:
                        forest, held = Slice(*(np.concatenate(x) for x in zip(*held, strict=True)), center), []
                    level = b.column(3).slice(i, j - i)
                    q, rep, d = forest.ask(ids, v, None if level.null_count else level.to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rep), pa.array(d)], ["q", "rep", "d"])

    return run


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows that the forest finds.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
    another length than most, or without an id. Equal vectors are searched once: of each, the k + 1
    smallest ids are kept, which no ranking can go beyond. Ties go to the smaller id. Ids are taken
    as unique; an empty table, or one without queries, gives an empty result.
    """
    spark, out_schema = table.sparkSession, "q long, rep long, d double"
    t = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    usual = t.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = usual["n"] if usual else 1
    element = t.schema["x"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    whole = t.where(F.size("x") == dim).select("vec_id", "is_query", F.transform("x", lambda x: x.cast("float" if element == "float" else "double")).alias("x"))
    packed = whole.select("vec_id", "x").mapInArrow(_pack(kind), "vec_id long, v binary")
    first = packed.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = written(first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asks = whole.where("is_query").select("vec_id", "x").mapInArrow(_pack(kind), "vec_id long, v binary")
    asks = written(asks.withColumnRenamed("vec_id", "query_id").join(classes.select("v", "rep"), "v").select("query_id", F.col("rep").alias("q"), "v"), "queries")

    moments = {r["k"]: r["x"] for r in classes.select("v").mapInArrow(_moments(kind), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    n = max(1, classes.count())
    center = np.array([moments.get(i, 0.0) for i in range(dim)]) / n
    radius = math.sqrt(max(moments.get(dim, 0.0) / n - float((center**2).sum()), 1e-12))
    slices = max(1, min(-(-n // SLICE), max(SLICES, -(-n // MOST))))
    base = classes.select(F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("asks"), F.col("rep").alias("id"), F.lit(None).cast("int").alias("level"), "v")

    def found(queries: DataFrame) -> DataFrame:
        """queries: q, level, v"""
        sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True), F.col("q"), "level", "v")
        dealt = base.union(sent).repartition("slice").sortWithinPartitions("slice", "asks")
        return dealt.mapInArrow(_search(k + 1, center, kind), out_schema)

    once = asks.select("q", "v").dropDuplicates(["q"])
    down = written(found(once.select("q", F.lit(None).cast("int").alias("level"), "v")), "down")
    # the (k + 1)-th nearest, the query itself counted
    far = down.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d", "rep"))).where(F.col("n") == k + 1).select("q", F.col("d").alias("far"))
    own = once.mapInArrow(_norm(center, kind), "q long, r double")
    cos = (F.col("r") ** 2 + radius**2 - F.col("far") ** 2) / (2 * F.col("r") * radius)
    meet = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / math.pi
    wanted = math.log(1 - (1 - target) ** (1 / TREES))
    level = F.when(F.col("far").isNull() | (meet <= 0), 0).when(meet >= 1, BITS).otherwise(F.least(F.lit(BITS), F.floor(F.lit(wanted) / F.log(meet))))
    levels = own.join(far, "q", "left").select("q", F.greatest(F.lit(0), F.coalesce(level.cast("int"), F.lit(0))).alias("level"))

    up = found(once.join(levels, "q").select("q", "level", "v"))
    best = up.unionByName(down).groupBy("q", "rep").agg(F.min("d").alias("d"))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d", "rep"))).where(F.col("n") <= k + 1)
    ids = best.join(classes.select("rep", "ids"), "rep").select("q", "d", F.explode("ids").alias("vec_id"))
    ranked = asks.select("query_id", "q").join(ids, "q").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def _norm(center: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1).to_pylist(), kind) - center
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.sqrt((m * m).sum(1)))], ["q", "r"])

    return run
