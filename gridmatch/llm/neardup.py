"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of 5-word shingles gets a signature of 40 symbols of 16 bits (b-bit MinHash). The
signature is split into 10 chunks of 4 symbols. Two signatures that differ in at most 19 symbols
must, by pigeonhole, have a chunk with at most one differing symbol; each chunk is indexed under its
4 variants with one symbol left out, so every pair under that distance meets under some key.

From keys to components without all pairs of a group:

1. Documents with equal shingle sets collapse to one numbered set.
2. Each key pairs its sets with the key's smallest number only. Pairs with near signatures are
   confirmed on the full shingle sets, and the components of the confirmed links are found.
3. Keys that still hold two or more components compare documents across components. Both sides are
   cut into blocks, so a group is one block against one, of bounded size; a bottom-k sketch sorts out
   most pairs there, before any is handed on. What it lets through is confirmed on full sets, and the
   components are found anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, in_slices, mix, runs, split_words, text_bytes, written

SHINGLE = 5
#: Two sets are linked if 100 * intersection >= SIMILAR * union.
SIMILAR = 75
CHUNKS, PER_CHUNK, SYMBOLS = 10, 4, 40
#: Most differing symbols of a pair that is looked at further. 19 are sure to meet; a pair of
#: similarity 0.75 differs in 10 +- 2.7, so what meets is kept up to 24.
MAX_DISTANCE = 24
#: Shingles in the bottom-k sketch. Its similarity has a deviation of 0.027 at most; 0.13 is let by.
SKETCH, SKETCH_MARGIN = 256, 0.13
#: Bytes of text hashed at once.
SLICE = 2 << 20
#: Documents of one key on either side of a group, and pairs that a task compares at once.
BLOCK, PAIRS = 512, 100_000

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text; fewer words are one."""
    starts, counts = split_words(data, offsets)
    w = hash_words(data, starts)
    first = np.concatenate(([0], np.cumsum(counts)))
    h = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        h = mix(h ^ w[i : len(w) - SHINGLE + 1 + i]) + np.uint64(i)
    out = []
    for a, n in zip(first, counts, strict=False):
        if n >= SHINGLE:
            s = np.sort(h[a : a + n - SHINGLE + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            x = np.full(min(n, 1), n + 1, np.uint64)
            for v in w[a : a + n]:
                x = mix(x ^ v) + np.uint64(n)
            out.append(x)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each set and each of 40 hash functions, 16 bits of the least hash of the set."""
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    every = np.concatenate(sets)
    return np.stack([(np.minimum.reduceat(every * m + a, first) >> np.uint64(20)).astype(np.uint16) for m, a in zip(_MULT, _ADD, strict=True)], 1)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The 40 keys of each signature: chunk, symbol left out, the three others."""
    s = sig.astype(np.int64).reshape(len(sig), CHUNKS, PER_CHUNK)
    keys = []
    for c in range(CHUNKS):
        for p in range(PER_CHUNK):
            x, y, z = (s[:, c, q] for q in range(PER_CHUNK) if q != p)
            keys.append(((c * PER_CHUNK + p) << 48) | (x << 32) | (y << 16) | z)
    return np.stack(keys, 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in in_slices(offsets, SLICE):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            some = [s for s in sets if len(s)]
            sig = iter(signatures(some) if some else [])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([np.sort((mix(s) >> np.uint64(32)).astype(np.uint32))[:SKETCH].tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_hash", "sig", "sketch"],
            )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = chunk_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), SYMBOLS))], ["key", "rep"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x != y).sum(1) <= MAX_DISTANCE))


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in in_slices(offsets, SLICE):
            sets = [s.tobytes() for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["set_hash", "shingles"])


def _confirm(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= similar * (len(p) + len(q) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _sketches_near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sketches, one a row, leave it open that sets of n and m shingles are linked.

    Rows are sorted; places beyond a set's size hold values above 2^32, no two alike in x and y.
    """
    both = np.sort(np.concatenate((x, y), 1), 1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(~twice, 1)  # of distinct values
    whole = np.maximum(n, m) <= SKETCH
    limit = np.where(whole, 2 * SKETCH, np.minimum(np.minimum(n, m), SKETCH))
    common = (twice & (rank <= limit[:, None])).sum(1)
    union = np.where(whole, n + m - common, limit)
    return common >= union * (SIMILAR / 100 - np.where(whole, 0.01, SKETCH_MARGIN))


def _padded(sketches: list[bytes], pad: int) -> np.ndarray:
    out = np.tile(np.arange(SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64((1 << 32) + pad), (len(sketches), 1))
    for row, s in zip(out, sketches, strict=True):
        v = np.frombuffer(s, np.uint32)
        row[: len(v)] = v
    return out


def _pairs_across(key, stray, home, rep, comp, n, sig, sketch, cuts) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a guest and a home row of one group whose components differ and whose sizes, signatures and sketches are near."""
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    homes = np.bincount(group[home], minlength=len(cuts) - 1)  # they come first in each group
    guests = np.flatnonzero(~home)
    many = homes[group[guests]]
    a, b = [], []
    for i, j in in_slices(np.concatenate(([0], np.cumsum(many))), PAIRS):
        x, y = np.repeat(guests[i:j], many[i:j]), runs(cuts[group[guests[i:j]]], many[i:j])
        # two strays meet twice: once is enough
        may = (comp[x] != comp[y]) & (~stray[y] | (rep[x] > rep[y])) & (np.minimum(n[x], n[y]) * 100 >= SIMILAR * np.maximum(n[x], n[y]))
        x, y = x[may], y[may]
        same = sig[x] == sig[y]
        near = SYMBOLS - same.sum(1) <= MAX_DISTANCE
        x, y, by = x[near], y[near], same[near].reshape(-1, CHUNKS, PER_CHUNK)
        # a pair is taken under the first key it shares
        chunk = (by.sum(2) >= PER_CHUNK - 1).argmax(1)
        first = chunk * PER_CHUNK + by[np.arange(len(x)), chunk].argmin(1) == key[x] >> 48
        x, y = x[first], y[first]
        for k in range(0, len(x), 2048):
            p, q = x[k : k + 2048], y[k : k + 2048]
            near = _sketches_near(_padded(sketch[p], 0), _padded(sketch[q], 1), n[p], n[q])
            a.append(np.minimum(rep[p], rep[q])[near])
            b.append(np.maximum(rep[p], rep[q])[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows that are sorted by key and blocks, home rows first. A group has 2 * BLOCK rows at most."""

    def found(t: pa.Table) -> pa.RecordBatch:
        key, hb, gb, stray, home, rep, comp, n = (t.column(c).to_numpy() for c in range(8))
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (hb[1:] != hb[:-1]) | (gb[1:] != gb[:-1]), [True])))
        sig = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        sketch = np.array([*t.column(9).to_pylist(), None], object)[:-1]
        a, b = _pairs_across(key, stray, home, rep, comp, n.astype(np.int64), sig, sketch, cuts)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        # the last group may go on in the next batch
        last = np.ones(t.num_rows, bool)
        for c in range(3):
            v = t.column(c).to_numpy()
            last &= v == v[-1]
        end = t.num_rows - int(last[::-1].argmin() if not last.all() else t.num_rows)
        if end:
            yield found(t.slice(0, end))
        rest = t.slice(end)
    if rest is not None and rest.num_rows:
        yield found(rest)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over edges (a, b), by alternating large and small stars.

    Each round only shuffles edges by one end, and takes minima before the shuffle. Rounds grow with
    the logarithm of the component size.
    """
    now, before = written(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("b"), F.col("m").alias("a")), F.struct(F.col("lo").alias("b"), F.col("m").alias("a")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("b").alias("id"), F.col("a").alias("comp"))
        before = state


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, in percent."""
    x, y = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(similar), "a long, b long")


def numbered_sets(having: DataFrame) -> DataFrame:
    """set_hash, least, rep: distinct sets, their least doc_id, and a number that is settled when the table is written."""
    return written(having.groupBy("set_hash").agg(F.min("doc_id").alias("least")).withColumn("rep", F.monotonically_increasing_id()), "sets")


def by_document(signed: DataFrame, every: DataFrame, same: DataFrame, comps: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of all rows, from the components (id, comp) of sets by number.

    A component's name is the least id of any of its sets. A row without words is where its id's
    other texts are, if it has any; a row without an id has no component.
    """
    named = same.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "least", F.coalesce("comp", "rep").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    size = F.col("n_shingles").cast("long").alias("n_shingles")
    out = every.join(named.join(least, "comp").select("rep", "component_id"), "rep").select("doc_id", size, "component_id")
    bare = signed.where("doc_id is not null and set_hash is null").select("doc_id")
    placed = out.join(bare.distinct(), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    bare = bare.join(placed, "doc_id", "left").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = signed.where("doc_id is null").select("doc_id", size, F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(bare).unionByName(lost)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the near-duplicate component of every row.

    A null or empty text, or one without words, has an empty set and is a component of its own.
    Rows that repeat an id are one document with the texts of all of them: what is linked to any of
    them is linked to all. Rows without an id have no component (null), link nothing and are kept.
    An empty table gives an empty result. Ids are whole numbers; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign, "doc_id long, n_shingles int, set_hash binary, sig binary, sketch binary"), "signed")
    having = signed.where("doc_id is not null and set_hash is not null")
    same = numbered_sets(having)
    numbered = having.select("doc_id", "n_shingles", "set_hash", "sig", "sketch").join(same, "set_hash")
    every = written(numbered.select("doc_id", "n_shingles", "rep", "least"), "classes")
    # one row of each set stands for it: equal sets have equal signatures
    reps = written(numbered.where("doc_id = least").dropDuplicates(["rep"]).select("rep", "n_shingles", "sig", "sketch"), "reps")

    keys = reps.select("rep", "sig").mapInArrow(_index, "key long, rep long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
    held = written(keys.join(shared, "key"), "held")

    pairs = held.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    x, y = (reps.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    pairs = pairs.join(x, "a").join(y, "b").where(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))
    pairs = pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long")

    # the texts of the sets that share a key: of each, those of the rows with its least id
    met = held.select("rep").distinct().join(same, "rep").select("rep", "set_hash", F.col("least").alias("doc_id"))
    sets = texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(whole_sets, "set_hash binary, shingles binary")
    sets = written(sets.dropDuplicates(["set_hash"]).join(met.select("rep", "set_hash"), "set_hash").select("rep", "shingles"), "sets")
    links = confirmed(pairs, sets)
    # texts of one id go together
    several = every.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last").select("doc_id", "a")
    links = written(links.unionByName(every.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()), "links")
    comps = components(links)

    held = held.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # the leader's component is the main one of its key; the others are strays
    main = held.where("rep = leader").select("key", F.col("comp").alias("main"))
    marked = held.join(main, "key").withColumn("stray", F.col("comp") != F.col("main"))
    mixed = marked.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("stray").cast("long")).alias("strays")).where("strays > 0")
    left = marked.select("key", "rep", "comp", "stray").join(mixed, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    left = left.withColumn("guests", F.ceil(F.col("strays") / BLOCK).cast("int"))
    block = lambda c, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    homes = left.select("key", "rep", "comp", "stray", block("blocks", 1).alias("hb"), each("guests").alias("gb"), F.lit(True).alias("home"))
    guests = left.where("stray").select("key", "rep", "comp", "stray", each("blocks").alias("hb"), block("guests", 2).alias("gb"), F.lit(False).alias("home"))
    placed = homes.unionByName(guests).join(reps, "rep")
    dealt = placed.select("key", "hb", "gb", "stray", "home", "rep", "comp", "n_shingles", "sig", "sketch").repartition("key", "hb", "gb").sortWithinPartitions("key", "hb", "gb", F.desc("home"))
    more = dealt.mapInArrow(_across, "a long, b long").distinct()
    again = written(confirmed(more, sets), "links")
    out = by_document(signed, every, same, components(links.unionByName(again)))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
