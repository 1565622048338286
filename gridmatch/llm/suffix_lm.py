"""Language-model scores by a probabilistic suffix tree.

A text is its words, A-Z lower-cased, each followed by a space, the last by an end symbol; symbols are
the bytes seen in training, one for all others, and the end. Every context of up to DEPTH symbols that
training has is tested, however rare, and is kept if what follows it diverges enough from what follows
its longest proper suffix; the suffixes of kept contexts are kept too.

Next-symbol distributions are smoothed towards the suffix's (Witten-Bell). Counts, tests and
probabilities are tables with a row for each distinct window (a context and the next symbol), joined
to the windows of the contexts' suffixes; how many there are grows with the input, and none of them
reaches the driver but the common ones. A text's score sums its windows' values: common windows are
broadcast, all others are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE, hash_words, in_slices, split_words, text_bytes, written

DEPTH = 5
#: A context is kept if count * divergence from its suffix's distribution is so many nats. Bits a byte
#: of held-out text on sf0.1 by this bound: 60: 2.138, 20: 2.117, 8: 2.112, 3: 2.112, 0: 2.114.
DIVERGENCE = 8.0
#: Words that make up so large a share of all tokens are broadcast (at most 2,000,000 of them, 16
#: bytes each); all others are looked up by a join.
COMMON_SHARE = 5e-7
#: The same for windows (445,461 of 949,979 on check_s, which leaves 1.3 % of all places to the join).
COMMON_WINDOW = 1e-7
#: Bits of a symbol in a window's code, and the symbol of places before a text's start.
BITS = 9
BEFORE = (1 << BITS) - 1
#: Windows that a task counts before it hands them on, and rows it hands on at once.
ROOM = 2_000_000
HANDED = 100_000
#: Bytes whose windows are coded at once.
CODED = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def _stream(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and where each text starts (n + 1 numbers)."""
    word = ~SPACE[data]
    last = word.copy()  # ends of words
    last[:-1] &= ~word[1:]
    edge = offsets[1:][(offsets[1:] > 0) & (offsets[1:] > offsets[:-1])] - 1
    last[edge] |= word[edge]
    size = word.astype(np.int8) + last
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    bounds = at[offsets]
    out = np.full(at[-1], symbol[32], np.int32)
    out[at[:-1][word]] = symbol[_LOWER[data[word]]]
    empty = bounds[1:] == bounds[:-1]
    full = bounds[1:][~empty]
    out[full - 1] = end
    if empty.any():
        out = np.insert(out, bounds[:-1][empty], end)
        bounds = bounds + np.concatenate(([0], np.cumsum(empty)))
    return out, bounds


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes (kind 0) and bytes (kind 1) of each slice of texts."""
    for b in batches:
        data, offsets = text_bytes(b.column(0))
        for i, j in in_slices(offsets):
            d = data[offsets[i] : offsets[j]]
            starts, _ = split_words(d, offsets[i : j + 1] - offsets[i])
            h, n = np.unique(hash_words(d, starts), return_counts=True)
            seen = np.bincount(_LOWER[d], minlength=256)
            k = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(h), len(k)])), pa.array(np.concatenate([h.view(np.int64), k])), pa.array(np.concatenate([n, seen[k]]))], ["kind", "h", "n"])


@dataclass
class Alphabet:
    symbol: np.ndarray
    size: int

    @property
    def end(self) -> int:
        return self.size - 1


def alphabet(seen: list[int]) -> Alphabet:
    """Symbol 0 is any byte not seen; the last one is the end."""
    symbol = np.zeros(256, np.int32)
    known = sorted({32, *seen})
    symbol[known] = np.arange(1, len(known) + 1)
    return Alphabet(symbol, len(known) + 2)


def _windows(data: np.ndarray, offsets: np.ndarray, a: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The code of each symbol and the DEPTH before it, the latest lowest, and where each text starts."""
    x, bounds = _stream(data, offsets, a.symbol, a.end)
    x = x.astype(np.int64)
    code = x.copy()
    early = np.empty(0, np.int64)
    for k in range(1, DEPTH + 1):
        early = np.concatenate((early, (bounds[:-1] + k - 1)[bounds[:-1] + k - 1 < bounds[1:]]))
        old = np.full(len(x), BEFORE, np.int64)
        old[k:] = x[:-k]
        old[early] = BEFORE
        code |= old << (BITS * k)
    return code, bounds


def _count_windows(a: Alphabet):
    """(h, n, m): windows, how often training has them, and how often all texts do."""

    def merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
        by = np.argsort(h)
        h, n = h[by], n[by]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.add.reduceat(n, first)

    def handed(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(h), HANDED):
            c, m = h[i : i + HANDED], n[i : i + HANDED]
            yield pa.RecordBatch.from_arrays([pa.array(c >> 1), pa.array(np.where(c & 1, 0, m)), pa.array(m)], ["h", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            held = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in in_slices(offsets, CODED):
                code, bounds = _windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], a)
                some.append(np.unique(code << 1 | np.repeat(held[i:j], np.diff(bounds)), return_counts=True))
                size += len(some[-1][0])
                if size >= ROOM:
                    some = [merged(some)]
                    size = len(some[0][0])
                    if size >= ROOM // 2:
                        yield from handed(*some[0])
                        some, size = [], 0
        if some:
            yield from handed(*merged(some))

    return run


def grow(texts: DataFrame, a: Alphabet) -> DataFrame:
    """(h, m, worth): all windows of (text, held), how often they occur, and their log10 probability.

    A window of length k + 1 is a context of k symbols and the next one. Rows that share a context or
    a suffix are at most as many as there are symbols.
    """
    windows = written(texts.mapInArrow(_count_windows(a), "h long, n long, m long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "windows")
    levels = [windows.select("h", "n")]
    tail = lambda c, k: F.col(c).bitwiseAND((1 << BITS * k) - 1)
    for k in range(DEPTH, 0, -1):
        levels.insert(0, written(levels[0].groupBy(tail("h", k).alias("h")).agg(F.sum("n").alias("n")), "level"))
    seen = levels[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    p = levels[0].select("h", ((F.col("n") + 1) / F.lit(float(seen + a.size))).alias("p"))
    tested = []
    for k in range(1, DEPTH + 1):
        before = p.select(F.col("h").alias("shorter"), F.col("p").alias("prior"))
        context = F.shiftright("h", BITS)
        w = levels[k].join(before, tail("h", k) == F.col("shorter")).select("h", "n", "prior", context.alias("context"))
        whole = W.partitionBy("context")
        w = w.withColumn("total", F.sum("n").over(whole)).withColumn("kinds", F.sum((F.col("n") > 0).cast("long")).over(whole))
        gain = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("total") / F.col("prior")))
        # a context that reaches over the start, or that training lacks, is none
        real = (F.shiftright("context", BITS * (k - 1)) != BEFORE) & (F.col("total") > 0)
        w = w.select(
            "h",
            "context",
            F.when(real, (F.col("n") + F.col("kinds") * F.col("prior")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("prior")).alias("p"),
            (real & (F.coalesce(F.sum(gain).over(whole), F.lit(0.0)) >= DIVERGENCE)).alias("own"),
        )
        p = written(w, "tested")
        tested.append(p)
    kept: list[DataFrame] = []
    for k in range(DEPTH, 0, -1):
        own = tested[k - 1].where("own").select("context")
        longer = [kept[0].select(tail("context", k).alias("context"))] if kept else []
        kept.insert(0, written((own.union(longer[0]) if longer else own).distinct(), "kept"))
    best = levels[0].select("h", ((F.col("n") + 1) / F.lit(float(seen + a.size))).alias("p"))
    for k in range(1, DEPTH + 1):
        before = best.select(F.col("h").alias("shorter"), F.col("p").alias("prior"))
        stays = kept[k - 1].select(F.col("context").alias("stays"))
        w = tested[k - 1].join(stays, F.col("context") == F.col("stays"), "left").join(before, tail("h", k) == F.col("shorter"))
        best = w.select("h", F.when(F.col("stays").isNotNull(), F.col("p")).otherwise(F.col("prior")).alias("p"))
        best = written(best, "best") if k < DEPTH else best
    # a byte never seen is one of 256
    worth = F.log10("p") - F.when(tail("h", 1) == 0, float(np.log10(256))).otherwise(0.0)
    return written(windows.select("h", "m").join(best, "h").select("h", "m", worth.alias("worth")), "worth")


#: multiplier, shift, keys and values of one table of slots
Slots = tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]


def slotted(keys: np.ndarray, values: np.ndarray) -> list[Slots]:
    """Tables of slots; keys whose slot is taken go to the next table."""
    out, rng = [], np.random.default_rng(9)
    while len(keys):
        bits = (2 * len(keys)).bit_length()
        times, shift = rng.integers(1 << 62, 1 << 63, dtype=np.uint64) | np.uint64(1), np.uint64(64 - bits)
        slot, first = np.unique((keys.view(np.uint64) * times) >> shift, return_index=True)
        k, v = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        k[slot], v[slot] = keys[first], values[first]
        out.append((times, shift, k, v))
        keys, values = np.delete(keys, first), np.delete(values, first)
    return out


def looked_up(tables: list[Slots], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each code, 0 where the tables lack it, and where that is."""
    out, left = np.zeros(len(codes)), np.arange(len(codes))
    for times, shift, k, v in tables:
        c = codes[left]
        slot = (c.view(np.uint64) * times) >> shift
        hit = k[slot] == c
        out[left[hit]] = v[slot[hit]]
        left = left[~hit]
    return out, left


def _score(a: Alphabet, frequent, common):
    """Per text: tokens, its words that `common` holds and their sum, its windows that `frequent` lacks and the others' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, value = common.value
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in in_slices(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, counts = split_words(d, o)
                h = hash_words(d, starts)
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                hit = words[at] == h if len(words) else np.zeros(len(h), bool)
                first = np.concatenate(([0], np.cumsum(counts)))
                hits = np.concatenate(([0], np.cumsum(hit)))
                worth = np.zeros(len(h) + 1)
                worth[:-1][hit] = value[at[hit]]
                some = counts > 0
                base = np.zeros(j - i)
                if some.any():
                    base[some] = np.add.reduceat(worth, first[:-1][some])[: int(some.sum())] if len(h) else 0
                score, lacks = [], []
                for k, m in in_slices(o, CODED):
                    code, bounds = _windows(d[o[k] : o[m]], o[k : m + 1] - o[k], a)
                    each, left = looked_up(frequent.value, code)
                    score.append(np.add.reduceat(each, bounds[:-1]))
                    lacks.append(np.diff(np.searchsorted(left, bounds)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(counts.astype(np.int64) + 1), pa.array(hits[first[1:]] - hits[first[:-1]]), pa.array(base), pa.array(np.concatenate(lacks)), pa.array(np.concatenate(score))],
                    ["doc_id", "key", "n_tokens", "n_common", "common_score", "n_other", "tree_score"],
                )

    return run


def _rare(a: Alphabet, frequent, common):
    """(key, kind, h) of the words that `common` lacks (kind 0) and the windows that `frequent` lacks (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = common.value
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            keys = b.column(2).to_numpy()
            for i, j in in_slices(offsets, CODED):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, counts = split_words(d, o)
                h = hash_words(d, starts)
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                rest = words[at] != h if len(words) else np.ones(len(h), bool)
                code, bounds = _windows(d, o, a)
                _, left = looked_up(frequent.value, code)
                key = np.concatenate((np.repeat(keys[i:j], counts)[rest], np.repeat(keys[i:j], np.diff(np.searchsorted(left, bounds)))))
                kind = np.repeat(np.array([0, 1], np.int32), [len(key) - len(left), len(left)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(np.concatenate((h[rest].view(np.int64), code[left])))], ["key", "kind", "h"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts are empty and consist of their end. Rows that repeat get the same scores. A row without
    an id is scored, but has a null held_out and is not learned from. Without
    training documents every count is 0 and the tree is uniform; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = d.where(~held_out(F.col("doc_id"))).select("text")
    tallied = written(train.mapInArrow(_tally, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), "words")
    ends = train.count()
    counts = tallied.where("kind = 0").select("h", "n")
    words, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, room = words + ends, words + ends + vocabulary + (1 if ends else 0) + 1
    worth = F.log10((F.col("n") + 1) / F.lit(float(room)))
    cut = max(2, int(np.ceil(COMMON_SHARE * max(1, total))))
    common = counts.where(F.col("n") >= cut).select("h", worth.alias("worth")).toArrow()
    h, v = common.column("h").to_numpy().view(np.uint64), common.column("worth").to_numpy()
    by = np.argsort(h)
    known = spark.sparkContext.broadcast((h[by], v[by]))
    a = alphabet([r["h"] for r in tallied.where("kind = 1 and h not in (9, 10, 11, 12, 13)").select("h").collect()])
    windows = grow(d.select("text", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held")), a)
    symbols = windows.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    often = max(2, int(np.ceil(COMMON_WINDOW * symbols)))
    top = windows.where(F.col("m") >= often).select("h", "worth").toArrow()
    frequent = spark.sparkContext.broadcast(slotted(top.column("h").to_numpy(), top.column("worth").to_numpy()))

    keyed = d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    each = keyed.mapInArrow(_score(a, frequent, known), "doc_id long, key long, n_tokens long, n_common long, common_score double, n_other long, tree_score double")
    rare = keyed.mapInArrow(_rare(a, frequent, known), "key long, kind int, h long").groupBy("key", "kind", "h").agg(F.count("*").alias("tf"))
    values = counts.where(F.col("n") < cut).select(F.lit(0).alias("kind"), "h", F.lit(True).alias("is_known"), worth.alias("worth"))
    values = values.union(windows.where(F.col("m") < often).select(F.lit(1), "h", F.lit(True), "worth"))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    rare = rare.join(values, ["kind", "h"], "left").groupBy("key").agg(
        of(0, F.col("tf")).alias("n_rare"), of(0, F.when(F.col("is_known"), F.col("tf")).otherwise(0)).alias("rare_known"), of(0, F.col("tf") * F.coalesce("worth", F.log10(F.lit(1 / float(room))))).alias("rare_score"),
        of(1, F.col("tf")).alias("all_other"), of(1, F.col("tf") * F.col("worth")).alias("other_score"),
    )
    # rows that repeat add up in rare; the row's own number of rare words or windows tells how often
    own = F.col("n_tokens") - 1 - F.col("n_common")
    part = F.when(own > 0, own / F.col("n_rare")).otherwise(F.lit(0.0))
    other = F.when(F.col("n_other") > 0, F.col("other_score") * F.col("n_other") / F.col("all_other")).otherwise(F.lit(0.0))
    end = float(np.log10((ends + 1) / room))
    return each.join(rare, "key", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_common") + F.coalesce(F.round(F.col("rare_known") * part).cast("long"), F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce(F.col("rare_score") * part, F.lit(0.0)) + F.lit(end)).alias("base_score"),
        (F.col("tree_score") + other).alias("score"),
    )
