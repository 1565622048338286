"""Exact Jaccard join of 5-word shingle sets, filtered by prefixes under several token orders.

Two sets whose similarity is t or more share a token among the first few under any order of all
tokens; a candidate must do so under each of four.

1. By hash: a set of n tokens keeps its first n - ceil(t n) + l(n) tokens, with l(n) = n / 6. Two
   linked sets share l tokens or more of what they keep (the l-th token they share can't come later
   in either), so a set of which fewer than l(ceil(t n)) kept tokens occur anywhere else has no
   partner at all. This alone ends most sets, before any pair is looked at.
2. By rarity: of what a set keeps, tokens of no other set first, then rarer ones first. The first
   kept - l + 1 share a token again; the ones that occur elsewhere become join keys.
3., 4. By two more hashes of the tokens, with those of no other set first, as far.

Occurrences are counted in one shuffle of the kept tokens: packed by token range into buckets of
bounded size. A token that a flush of a task holds CAPPED times or more ranks as frequent, so its
sets stay where they are and only a notice goes to its bucket; no bucket takes more than CAPPED - 1
sets of one token from a flush.

From keys to components without all pairs of a key: sets that are equal are one; each key pairs its
sets with one leader, and after those links are known only keys that still hold several components
compare sets across them, block against block. The leader is the set with the least share of tokens
that no other set has: of copies that were each changed elsewhere, the original, which more of them
are linked to than to each other. A pair is handed on if its sizes, a parity bitmap of the whole sets
(a bound on how much they differ) and orders 3 and 4 allow a link; every link is confirmed on the
whole sets. A pair that shares many keys is left to the least of them that both sets list among their
FIRST least, so it is handed on about once and not once a key. All filters are exact: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, mix, text_bytes, written
from .neardup import by_document, components, confirmed, numbered_sets, shingle_sets, whole_sets

#: Two sets are linked if 100 * intersection >= SIMILAR * union.
SIMILAR = 80
#: Bits of the parity bitmap of a set, and of its folded form, which goes with every key.
BITS, FOLDED = 2048, 512
#: Kept tokens of a bucket and of a flush; occurrences from which a token ranks as frequent.
BUCKET, FLUSH, CAPPED = 500_000, 4_000_000, 64
#: Bytes of text hashed at once.
SLICE = 2 << 20
#: Sets of one key on either side of a group, and pairs that a task compares at once.
BLOCK, PAIRS = 512, 50_000
#: Least keys of a set that go with it, and what fills the list of a set with fewer: no key is above it.
FIRST, NO_KEY = 8, np.int64(2**63 - 1)

_ORDERS = [np.uint64(v) for v in np.random.default_rng(20250311).integers(1, 2**63, 3, dtype=np.uint64)]


def needed(n, similar: int = SIMILAR):
    """Tokens that a set of n shares with a linked one at least."""
    return (similar * n + 99) // 100


def margin(n):
    return np.maximum(1, n // 6)


def kept(n, similar: int = SIMILAR):
    """How many tokens of n a set keeps by hash."""
    return np.minimum(n, n - needed(n, similar) + margin(n))


def sure(n, similar: int = SIMILAR):
    """How many of the tokens it keeps a set of n has in common with what a linked set keeps."""
    return margin(needed(n, similar))


def ranked(tokens: np.ndarray, order: int) -> np.ndarray:
    """The places of tokens in one of three orders by hash."""
    return mix(tokens ^ _ORDERS[order])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in in_slices(offsets, SLICE):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "n_shingles", "set_hash"])


def parity(s: np.ndarray) -> bytes:
    """For each of BITS classes of tokens, whether the set has an odd number of them."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8).tobytes()


def folded(bits: bytes) -> bytes:
    """The parity bitmap of fewer classes: each is several of the others."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(BITS // FOLDED, -1)).tobytes()


def _keeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set_hash, n, parity bitmap and kept tokens (mixed, so that they spread over all values) of each text that has words."""
    for b in batches:
        data, offsets = text_bytes(b.column(0))
        for i, j in in_slices(offsets, SLICE):
            sets = [s for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([parity(s) for s in sets], pa.binary()), pa.array([mix(s[: kept(len(s))]).tobytes() for s in sets], pa.binary()),
                ],
                ["set_hash", "n", "bits", "tokens"],
            )


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte: high bytes, which hardly change, come together for the compressor."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _postings(buckets: int):
    """Rows (bucket, direct, tokens, reps) of (rep, tokens): occurrences by bucket; those of frequent tokens directly."""

    def packed(token: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        by = np.argsort(token, kind="stable")
        token, rep = token[by], rep[by]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(first, len(token)))
        often = np.repeat(size >= CAPPED, size)
        names, rows = ["bucket", "direct", "tokens", "reps"], ([], [], [], [])

        def add(bucket: int, direct: bool, t: np.ndarray, r: np.ndarray) -> None:
            for column, v in zip(rows, (bucket, direct, _planes(np.diff(t, prepend=np.uint64(0))), _planes(r)), strict=True):
                column.append(v)

        notices = token[first[size >= CAPPED]]  # a rep of -1 says that the token is frequent
        t, r = np.concatenate((token[~often], notices)), np.concatenate((rep[~often], np.full(len(notices), -1)))
        by = np.argsort(t, kind="stable")
        t, r = t[by], r[by]
        bucket = (t >> np.uint64(32)).astype(np.int64) * buckets >> 32
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(t) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            add(int(bucket[i]), False, t[i:j], r[i:j])
        t, r = token[often], rep[often]
        for i in range(0, len(t), 50_000):
            add(int((int(t[i]) ^ int(r[i])) % buckets), True, t[i : i + 50_000], r[i : i + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, rep, many = [], [], 0
        for b in batches:
            for r, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = np.frombuffer(t.as_buffer(), np.uint64)
                token.append(t)
                rep.append(np.full(len(t), r))
                many += len(t)
                if many >= FLUSH:
                    yield from packed(np.concatenate(token), np.concatenate(rep))
                    token, rep, many = [], [], 0
        if many:
            yield from packed(np.concatenate(token), np.concatenate(rep))

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, token, seen) of the tokens of several sets, from rows sorted by bucket; seen is CAPPED at most."""

    def found(token: np.ndarray, rep: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(token), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(rep[i : i + 100_000]), pa.array(token[i : i + 100_000].view(np.int64)), pa.array(seen[i : i + 100_000].astype(np.int32))], ["rep", "token", "seen"])

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(token, kind="stable")
        token, rep = token[by], rep[by]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        weight = np.add.reduceat(np.where(rep < 0, CAPPED, 1), first)
        seen = np.minimum(np.repeat(weight, np.diff(np.append(first, len(token)))), CAPPED)
        yield from found(*(v[(seen > 1) & (rep >= 0)] for v in (token, rep, seen)))

    now, parts = None, []
    for b in batches:
        for bucket, direct, t, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t, r = np.cumsum(_values(t, np.uint64), dtype=np.uint64), _values(r, np.int64)
            if direct:
                yield from found(t, r, np.full(len(t), CAPPED))
                continue
            if bucket != now and parts:
                yield from counted(parts)
                parts = []
            now = bucket
            parts.append((t, r))
    if parts:
        yield from counted(parts)


def least_keys(keys: np.ndarray) -> bytes:
    """The FIRST least keys of a set, in a list of that length."""
    return np.append(np.sort(keys)[:FIRST], np.full(max(0, FIRST - len(keys)), NO_KEY)).tobytes()


def met_before(key: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets, by their lists of least keys, meet under a key below this one."""
    return ((x[:, :, None] == y[:, None, :]) & (x < key)[:, :, None]).any((1, 2))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n, share of tokens of no other set, bits, folded bits, keys by rarity, the least of them, and the prefixes by two hashes, of the sets that may have a partner."""
    for b in batches:
        out: list[list] = [[] for _ in range(9)]
        for rep, n, bits, tokens, seen in zip(*(b.column(k) for k in range(5)), strict=True):
            t, s = tokens.values.to_numpy().view(np.uint64), seen.values.to_numpy()
            least = int(sure(n.as_py()))
            if len(t) < least:
                continue
            first = len(t) - least + 1  # before them come the tokens of no other set
            keys = t[np.lexsort((ranked(t, 0), s))[:first]].view(np.int64)
            lone = 1 - len(t) / int(kept(n.as_py()))
            more = [np.sort(np.sort(ranked(t, k))[:first] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for k in (1, 2)]
            for column, v in zip(out, (rep.as_py(), n.as_py(), lone, bits.as_py(), folded(bits.as_py()), keys.tolist(), least_keys(keys), *more), strict=True):
                column.append(v)
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["rep", "n", "lone", "bits", "few", "keys", "first", "by_two", "by_three"])


def possible(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Whether sizes and parity bitmaps (rows of 64-bit words) leave it open that sets are linked.

    Sets that differ in d tokens share (n + m - d) / 2 of (n + m + d) / 2, and d is at least the
    number of classes that are odd in one set only.
    """
    may = np.minimum(n, m) * 100 >= similar * np.maximum(n, m)
    out = np.zeros(len(n), bool)
    differ = np.bitwise_count(x[may] ^ y[may]).sum(1, dtype=np.int64)
    out[may] = (100 + similar) * differ <= (100 - similar) * (n[may] + m[may])
    return out


def _meet(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Whether sorted prefixes have a token in common, pair by pair."""
    out = np.zeros(len(x), bool)
    for k, (p, q) in enumerate(zip(x, y, strict=True)):
        p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
        at = np.searchsorted(p, q)
        out[k] = bool((p[np.minimum(at, len(p) - 1)] == q).any())
    return out


def _words(bits: list[bytes], many: int = BITS) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, many // 64)


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""
    for b in batches:
        if b.num_rows:
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array(possible(n, m, _words(b.column(4).to_pylist()), _words(b.column(5).to_pylist()))))


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose prefixes meet under both other orders."""
    for b in batches:
        keep = np.arange(b.num_rows)
        for k in (2, 4):
            keep = keep[_meet(*(b.column(c).take(pa.array(keep)).to_pylist() for c in (k, k + 1)))]
        yield b.select([0, 1]).take(pa.array(keep))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows sorted by key and blocks; a group has about 2 * BLOCK rows. Only sizes, folded bitmaps and least keys are looked at."""

    def compared(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, (home, stray, rep, comp, n) = t.column(0)[0].as_py(), (t.column(c).to_numpy() for c in range(3, 8))
        bits, n = _words(t.column(8).to_pylist(), FOLDED), n.astype(np.int64)
        first = np.frombuffer(b"".join(t.column(9).to_pylist()), np.int64).reshape(-1, FIRST)
        guests, homes, a, b = np.flatnonzero(~home), np.flatnonzero(home), [], []
        for i, j in in_slices(np.arange(len(guests) + 1) * len(homes), PAIRS):
            x, y = np.repeat(guests[i:j], len(homes)), np.tile(homes, j - i)
            may = (comp[x] != comp[y]) & (~stray[y] | (rep[x] > rep[y]))  # two strays meet twice: once is enough
            x, y = x[may], y[may]
            near = possible(n[x], n[y], bits[x], bits[y])
            x, y = x[near], y[near]
            now = ~met_before(key, first[x], first[y])
            a.append(np.minimum(rep[x], rep[y])[now])
            b.append(np.maximum(rep[x], rep[y])[now])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2

    def found(t: pa.Table) -> pa.RecordBatch:
        """Of a batch's groups, each pair once."""
        keys = [t.column(c).to_numpy() for c in range(3)]
        cuts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], 0), [True])))
        a, b = (np.concatenate(v) for v in zip(*(compared(t.slice(i, j - i)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        both = np.unique(np.stack((a, b), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(2)], ["a", "b"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        last = np.all([(k := t.column(c).to_numpy()) == k[-1] for c in range(3)], 0)  # this group may go on
        end = 0 if last.all() else t.num_rows - int(last[::-1].argmin())
        if end:
            yield found(t.slice(0, end))
        rest = t.slice(end)
    if rest is not None and rest.num_rows:
        yield found(rest)


def _leaders(held: DataFrame) -> DataFrame:
    """key, n and leader of each key that several sets have: the set with the least share of tokens of its own, and of those the least rep."""
    return held.groupBy("key").agg(F.count("*").alias("n_key"), F.min(F.struct("lone", "rep")).alias("best")).where("n_key > 1").select("key", "n_key", F.col("best.rep").alias("leader"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: which documents are linked by sets of similarity 0.8 or more.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows that
    repeat an id are one document with the texts of all of them. Rows without an id link nothing and
    have no component. An empty table gives an empty result. Ids are whole numbers; other columns are
    ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sized, "doc_id long, n_shingles int, set_hash binary"), "sized")
    having = signed.where("doc_id is not null and set_hash is not null")
    same = numbered_sets(having)
    every = written(having.join(same, "set_hash").select("doc_id", "n_shingles", "rep", "least"), "classes")

    # what sets keep by hash; equal texts fall together before they are told apart by token
    some = texts.where("doc_id is not null").select("text").mapInArrow(_keeps, "set_hash binary, n int, bits binary, tokens binary")
    sets = written(some.dropDuplicates(["set_hash"]).join(same, "set_hash").select("rep", "n", "bits", "tokens"), "kept")
    many = sets.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()[0] // 8
    buckets = max(8, -(-many // BUCKET))
    posted = sets.select("rep", "tokens").mapInArrow(_postings(buckets), "bucket long, direct boolean, tokens binary, reps binary")
    repeated = posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "rep long, token long, seen int")
    lists = repeated.groupBy("rep").agg(F.collect_list(F.struct("token", "seen")).alias("t"))  # a set's own tokens
    joined = lists.join(sets.select("rep", "n", "bits"), "rep").where(F.size("t") >= F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * SIMILAR + 99) / 100) / 6)))
    reps = joined.select("rep", "n", "bits", F.col("t.token").alias("tokens"), F.col("t.seen").alias("seen")).mapInArrow(_prefixes, "rep long, n int, lone double, bits binary, few binary, keys array<long>, first binary, by_two binary, by_three binary")
    reps = written(reps, "reps")

    held = reps.select("rep", "lone", F.explode("keys").alias("key"))
    held = written(held.select("key", "rep").join(_leaders(held), "key"), "held")
    pairs = held.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()

    def near(pairs: DataFrame) -> DataFrame:
        """Those that the other filters let pass: first the small ones, then the prefixes."""
        for names, passes in ((("n", "bits"), _allowed), (("by_two", "by_three"), _meeting)):
            x, y = (reps.select(F.col("rep").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in names]) for c in "ab")
            pairs = pairs.join(x, "a").join(y, "b").select("a", "b", *[f"{v}_{c}" for v in names for c in "ab"]).mapInArrow(passes, "a long, b long")
        return pairs

    pairs = near(pairs)

    met = held.select("rep").distinct().join(same, "rep").select("rep", "set_hash", F.col("least").alias("doc_id"))
    whole = texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(whole_sets, "set_hash binary, shingles binary")
    whole = written(whole.dropDuplicates(["set_hash"]).join(met.select("rep", "set_hash"), "set_hash").select("rep", "shingles"), "whole")
    several = every.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last").select("doc_id", "a")
    one_id = every.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    links = written(confirmed(pairs, whole, SIMILAR).unionByName(one_id), "links")

    held = held.select("key", "rep", "leader").join(components(links).withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    main = held.where("rep = leader").select("key", F.col("comp").alias("main"))
    held = held.join(main, "key").withColumn("stray", F.col("comp") != F.col("main"))
    open_ = held.groupBy("key").agg(F.count("*").alias("n_key"), F.sum(F.col("stray").cast("long")).alias("strays")).where("strays > 0")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    left = held.select("key", "rep", "comp", "stray").join(open_, "key").withColumns({"blocks": parts("n_key"), "guests": parts("strays")})
    place = lambda c, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    homes = left.select("key", place("blocks", 1).alias("hb"), each("guests").alias("gb"), F.lit(True).alias("home"), "stray", "rep", "comp")
    guests = left.where("stray").select("key", each("blocks").alias("hb"), place("guests", 2).alias("gb"), F.lit(False).alias("home"), "stray", "rep", "comp")
    placed = homes.unionByName(guests).join(reps.select("rep", "n", "few", "first"), "rep")
    dealt = placed.select("key", "hb", "gb", "home", "stray", "rep", "comp", "n", "few", "first").repartition("key", "hb", "gb").sortWithinPartitions("key", "hb", "gb")
    more = near(dealt.mapInArrow(_across, "a long, b long").distinct())
    final = components(links.unionByName(confirmed(more, whole, SIMILAR)))
    return by_document(signed, every, same, final)
