"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a slice are cut into chunks (a run of word marks and what follows, where no piece
crosses). The distinct chunks are joined into one text, which is indexed by a suffix array as deep as
the longest piece. Every piece of the vocabulary finds its occurrences as one range of the array by
binary search. The ranges give the edges of a lattice; sorted by the position where they end, they
are relaxed from left to right. Nothing is remembered from slice to slice but which neighbours go
together, and that is bounded by PAIRS, so a worker's memory follows from the size of a slice.

The vocabulary is BPE, whose segmentation is no shortest path, but it is local: a sequence of pieces
is the segmentation of its text if and only if every two neighbours are that of theirs. So an edge
relaxes its end if the piece that ends at its start goes with it, and exactly one edge does. Runs of
several word marks tie in score, which that rule does not cover; those chunks are merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, mix, runs, text_bytes

MARK = "▁"
#: Pairs of neighbours a worker remembers, bytes of text in a slice, characters indexed at once.
PAIRS, TOGETHER, INDEXED = 1_000_000, 2 << 20, 300_000
_SEPARATOR = 0x110000

_models: dict[str, object] = {}
_letter: list[np.ndarray] = []


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _letters() -> np.ndarray:
    """Which code points are letters as [^\\W\\d_] has them."""
    if not len(_letter):
        every = np.zeros(0x110000, bool)
        for i in range(0, len(every), 1 << 14):
            every[[ord(c) for c in re.findall(r"[^\W\d_]", "".join(map(chr, range(i, i + (1 << 14)))))]] = True
        _letter.append(every)
    return _letter[0]


def distinct(x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One chunk of each kind, and each chunk's kind. Chunks are hashed, then compared with their kind."""
    hashes = np.empty(len(begin), np.uint64)
    for i, j in in_slices(np.append(begin, len(x)), 1 << 19):
        b, part = begin[i:j] - begin[i], x[begin[i] : begin[i] + int(size[i:j].sum())].astype(np.uint64)
        place = (np.arange(len(part)) - np.repeat(b, size[i:j])).astype(np.uint64)
        hashes[i:j] = np.add.reduceat(mix(part + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), b)
    _, own, kind = np.unique(hashes, return_index=True, return_inverse=True)
    # equal hashes of different chunks: each such chunk becomes a kind of its own
    odd = np.flatnonzero(size != size[own[kind]])
    for i, j in in_slices(np.append(begin, len(x)), 1 << 19):
        at, n = begin[i:j], np.minimum(size[i:j], size[own[kind[i:j]]])
        differs = x[runs(at, n)] != x[runs(begin[own[kind[i:j]]], n)]
        if differs.any():
            odd = np.union1d(odd, i + np.unique(np.repeat(np.arange(j - i), n)[differs]))
    kind[odd] = len(own) + np.arange(len(odd))
    return np.concatenate((own, odd)), kind


class Pieces:
    """A vocabulary, and encoding and decoding with it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.unknown = sp.unk_id()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.score = {sp.id_to_piece(i): (sp.get_score(i), i) for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.text = [""] * len(every)
        self.raw = [b""] * len(every)
        for piece, (_, i) in self.score.items():
            self.text[i], self.raw[i] = piece, piece.encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.raw_size = np.array([len(r) for r in self.raw])
        self.raw_start, self.raw_pool = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(self.raw), np.uint8)
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        ids = sorted(i for _, i in self.score.values())
        self.known = np.array([i for i in ids if self.merge(self.text[i]) == [self.text[i]]], np.int32)
        self.size = np.array([len(self.text[i]) for i in self.known], np.int32)
        self.deep = int(self.size.max())
        self.codes = np.full((len(self.known), self.deep), -1, np.int32)
        for row, i in enumerate(self.known):
            self.codes[row, : self.size[row]] = [ord(c) for c in self.text[i]]
        self.edges = {int(i): (self._grown(self.text[i], -1), self._grown(self.text[i], 0)) for i in self.known}
        # where no piece of this vocabulary crosses: around line ends, and between a letter and a mark
        inner = "".join(p for p in self.score if len(p) > 1)
        marks = "".join(c for c in ".,!?;:" if not any(re.search(f"[^\\W\\d_]{re.escape(c)}", p) for p in self.score))
        self.lines, self.marks = "\n" not in inner, np.array([ord(c) for c in marks], np.uint32)
        self.pairs, self.pairs_go = np.array([-1], np.int64), np.array([False])
        self.fresh: dict[int, bool] = {}

    def merge(self, text: str, without: set[str] = frozenset()) -> list[str]:
        """BPE by definition: the best-scored neighbours merge first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (found := self.score.get(parts[i] + parts[j])) and parts[i] + parts[j] not in without:
                heapq.heappush(queue, (-found[0], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, whole = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            if p in self.score:
                out.append(self.score[p][1])
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def cut(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where chunks start in marked texts, which start at `first`."""
        begins = np.zeros(len(x), bool)
        begins[first] = True
        mark = x == ord(MARK)
        if self.cuts:
            begins[1:] |= mark[1:] & ~mark[:-1]
        if self.lines:
            line = x == 10
            begins |= line
            begins[1:] |= line[:-1]
        if len(self.marks):
            at = np.flatnonzero(np.isin(x[1:], self.marks)) + 1
            begins[at[_letters()[x[at - 1]]]] = True
        return np.flatnonzero(begins)

    def occurrences(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row of the piece) of every occurrence of every piece in x."""
        n = len(x)
        letters, code = np.unique(x, return_inverse=True)
        bits = int(len(letters)).bit_length()
        wide = min(self.deep, 62 // bits)  # letters that one key holds
        code = np.concatenate((code.astype(np.int64) + 1, np.zeros(self.deep, np.int64)))  # 0: past the end
        key = np.zeros(n, np.int64)
        for j in range(wide):
            key = key << bits | code[j : n + j]
        order = np.argsort(key)
        first_key = key[order]
        h = wide
        while h < self.deep:  # order by twice as many characters, until as many as the longest piece has
            step = np.zeros(n, np.int64)
            step[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            key = rank * (n + 1) + np.concatenate((rank[h:], np.full(min(h, n), -1, np.int64))) + 1
            order = np.argsort(key)
            h *= 2
        # a piece's first letters by binary search among the keys, the rest of the longer ones among the suffixes
        at = np.minimum(np.searchsorted(letters, self.codes), len(letters) - 1)
        inside = np.arange(self.deep) < self.size[:, None]
        rows = np.flatnonzero(((letters[at] == self.codes) | ~inside).all(1))
        mine = np.where(inside[rows], at[rows].astype(np.int64) + 1, 0)
        low = np.zeros(len(rows), np.int64)
        for j in range(wide):
            low = low << bits | mine[:, j]
        first = np.searchsorted(first_key, low)
        last = np.searchsorted(first_key, low + (np.int64(1) << bits * (wide - np.minimum(self.size[rows], wide)).astype(np.int64)))
        longer = np.flatnonzero((self.size[rows] > wide) & (first < last))
        if len(longer):
            some = [self._bound(code, order, mine[longer], self.size[rows[longer]], wide, first[longer], last[longer], above) for above in (False, True)]
            first[longer], last[longer] = some
        count = last - first
        row = np.repeat(rows.astype(np.int32), count)
        place = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return order[place].astype(np.int32), row

    @staticmethod
    def _bound(code: np.ndarray, order: np.ndarray, mine: np.ndarray, size: np.ndarray, known: int, low: np.ndarray, high: np.ndarray, above: bool) -> np.ndarray:
        """The first suffix in [low, high) not below (above: beyond) each piece; its first letters agree."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            sign = np.zeros(len(low), np.int8)  # of suffix - piece
            for k in range(known, mine.shape[1]):
                on = np.flatnonzero((sign == 0) & (k < size))
                if not len(on):
                    break
                sign[on] = np.sign(code[at[on] + k] - mine[on, k])
            less = (sign < 0) | ((sign == 0) & above)
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low

    def _grown(self, text: str, side: int) -> list[tuple[str, float]] | None:
        """How the piece at one edge of a piece grew: each with the score of what it merged into.

        None if a part scores no better than the whole, so that merges don't follow the scores.
        """
        out, until = [], float("-inf")
        while True:
            out.append((text, until))
            if len(text) == 1:
                return out
            parts = self._last_two(text)
            if any(len(x) > 1 and self.score[x][0] <= self.score[text][0] for x in parts):
                return None
            text, until = parts[side], self.score[text][0]

    def _last_two(self, text: str) -> list[str]:
        """The two parts that merge into a piece at last."""
        return self.merge(text, {text})

    def _pair(self, left: int, right: int) -> bool:
        """Whether no piece across the border forms before those at its sides have grown on.

        The best score merges first, and of equals the leftmost: the left side's own merge wins
        against one across, which wins against the right side's.
        """
        before, after = self.edges[left][0], self.edges[right][1]
        if before is None or after is None:
            return self.merge(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        for a, grows in before:
            for b, grows_too in after:
                across = self.score.get(a + b)
                if across and across[0] > grows and across[0] >= grows_too:
                    return False
        return True

    def goes(self, codes: np.ndarray) -> np.ndarray:
        """Whether the pieces left << 32 | right are the segmentation of their joined text."""
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        out = self.pairs_go[at]
        lost = np.flatnonzero(self.pairs[at] != codes)
        if len(lost):
            some, back = np.unique(codes[lost], return_inverse=True)
            found = []
            for c in some.tolist():
                ok = self.fresh.get(c)
                if ok is None:
                    ok = self.fresh[c] = self._pair(c >> 32, c & 0xFFFFFFFF)
                found.append(ok)
            out[lost] = np.array(found, bool)[back]
        return out

    def settle(self) -> None:
        """Adds fresh pairs to the sorted ones; beyond PAIRS they start anew."""
        if self.fresh:
            codes, go = np.array(list(self.fresh), np.int64), np.array(list(self.fresh.values()), bool)
            if len(self.pairs) + len(codes) <= PAIRS:
                codes, go = np.concatenate((self.pairs, codes)), np.concatenate((self.pairs_go, go))
            by = np.argsort(codes)
            self.pairs, self.pairs_go, self.fresh = codes[by], go[by], {}

    def segment(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks of text (none with a run of marks), and how many each has."""
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int32)
        x = np.full(int(size.sum()) + len(size), _SEPARATOR, np.int32)
        place = runs(start, size)
        x[place] = text[runs(begin, size)]
        size = size.astype(np.int32)
        at, row = self.occurrences(x)
        # a character that is no piece of its own is an edge too
        single = np.zeros(len(x), bool)
        single[at[self.size[row] == 1]] = True
        single[start + size] = True
        odd = np.flatnonzero(~single).astype(np.int32)
        at = np.concatenate((at, odd))
        end = np.concatenate((at[: len(row)] + self.size[row], odd + 1))
        piece = np.concatenate((self.known[row], np.full(len(odd), -1, np.int32)))
        first = start[np.searchsorted(start, at, "right") - 1]
        reach = end - first
        order = np.argsort(reach.astype(np.uint16) if int(size.max()) < 1 << 16 else reach, kind="stable")
        at, end, piece, first = at[order], end[order], piece[order], first[order]
        cut = np.searchsorted(end - first, np.arange(int(size.max()) + 2))
        last = np.full(len(x) + 1, -2, np.int32)  # the piece that ends here: -2 none yet, -1 an odd character
        came = np.zeros(len(x) + 1, np.int32)
        for k in range(1, len(cut) - 1):
            s = slice(cut[k], cut[k + 1])
            a, e, p, f = at[s], end[s], piece[s], first[s]
            ok = (a == f) | (last[a] == -1) | ((last[a] > -2) & (p == -1))
            ask = np.flatnonzero(~ok & (last[a] > -1))
            if len(ask):
                ok[ask] = self.goes(last[a[ask]].astype(np.int64) << 32 | p[ask])
            last[e[ok]] = p[ok]
            came[e[ok]] = a[ok]
        steps, begins = [], []
        now, who = start + size, start
        while len(now):
            steps.append(last[now])
            now = came[now]
            begins.append(now)
            on = now > who
            now, who = now[on], who[on]
        begins, pieces = np.concatenate(begins), np.concatenate(steps)
        by = np.argsort(begins)
        begins, pieces = begins[by], pieces[by]
        many = np.ones(len(pieces), np.int64)
        odd = np.flatnonzero(pieces < 0)
        spelled = [self.ids_of([chr(c)]) for c in x[begins[odd]].tolist()]
        many[odd] = [len(v) for v in spelled]
        ids = np.repeat(pieces, many)
        for k, v in zip((np.cumsum(many) - many)[odd].tolist(), spelled, strict=True):
            ids[k : k + len(v)] = v
        bounds = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(begins, np.append(start, len(x)))]
        return ids, np.diff(bounds)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts in a row, and where each text's begin (n + 1 numbers)."""
        # every text that is not empty begins with a mark; spaces are marks
        letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        some = np.flatnonzero(np.diff(offsets) > 0)
        if not len(some):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        plain = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        x = np.insert(plain, letters[some], 32)
        x[x == 32] = ord(MARK)
        first = letters[some] + np.arange(len(some))
        begin = self.cut(x, first)
        size = np.diff(begin, append=len(x))
        own, chunk = distinct(x, begin, size)
        # runs of marks are merged directly, all others found in the index
        b, n = begin[own], size[own]
        inner = np.concatenate(([0], np.cumsum(x == ord(MARK))))
        tied = inner[b + n] - inner[np.minimum(b + 1, b + n)] > 0
        pool, many = [], np.zeros(len(own), np.int64)
        order = np.concatenate((np.flatnonzero(~tied), np.flatnonzero(tied)))
        rest = order[: int((~tied).sum())]
        ends = np.cumsum(n[rest] + 1)
        i = 0
        while i < len(rest):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + INDEXED)))
            ids, many[rest[i:j]] = self.segment(x, b[rest[i:j]], n[rest[i:j]])
            pool.append(ids)
            self.settle()
            i = j
        for k in order[len(rest) :].tolist():
            ids = self.ids_of(self.merge("".join(map(chr, x[b[k] : b[k] + n[k]].tolist()))))
            pool.append(np.array(ids, np.int32))
            many[k] = len(ids)
        at = np.empty(len(own), np.int64)
        at[order] = np.cumsum(many[order]) - many[order]
        out = np.concatenate(pool)[runs(at[chunk], many[chunk])]
        # a text's ids begin where those of its first chunk do
        sums = np.concatenate(([0], np.cumsum(many[chunk])))
        text_at = letters[:-1] + np.searchsorted(some, np.arange(len(offsets) - 1))
        bounds = sums[np.searchsorted(begin, np.append(text_at, len(x)))]
        return out, bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        ids, bounds = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        data = ids.astype("<i4").tobytes()
        return [data[4 * i : 4 * j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def decode_ids(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text that each stretch of ids spells."""
        many = self.raw_size[ids]
        data = self.raw_pool[runs(self.raw_start[ids], many)].tobytes()
        at = np.concatenate(([0], np.cumsum(many)))[bounds].tolist()
        texts = (data[i:j].decode("utf-8", "replace").replace(MARK, " ") for i, j in zip(at, at[1:], strict=False))
        return [t[1:] if t[:1] == " " else t for t in texts]

    def decode(self, ids: bytes) -> str:
        v = np.frombuffer(ids, "<i4")
        return self.decode_ids(v, np.array([0, len(v)]))[0]


def encoded(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of each text as a binary column of 32-bit integers (null text: no ids).

    Rows are encoded one by one; a column of that name gives way. An empty table stays empty.
    """
    path = path or model_path()
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            data, offsets = text_bytes(b.column(at))
            for i, j in in_slices(offsets, TOGETHER):
                ids, bounds = model.encode_bytes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids.astype("<i4"))])
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, made.cast(pa.binary())], [*b.schema.names, out_col])

    return docs.mapInArrow(run, docs.withColumn(out_col, F.lit(b"")).schema)


def decoded(docs: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the text that the ids spell (null ids: empty). A column of that name gives way."""
    path = path or model_path()
    docs = docs.drop(out_col)
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            ids = [np.frombuffer(v or b"", "<i4") for v in b.column(at).to_pylist()]
            texts = model.decode_ids(np.concatenate(ids), np.cumsum([0, *map(len, ids)])) if ids else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    return docs.mapInArrow(run, docs.withColumn(out_col, F.lit("")).schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_bytes, decoded_sha256, round_trip of every document.

    Texts are encoded and their ids decoded in the same task, so one worker holds the vocabulary.
    """
    path = path or model_path()
    schema = "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in in_slices(offsets, TOGETHER):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, bounds = model.encode_bytes(d, o)
                rows = []
                for k, text in enumerate(model.decode_ids(ids, bounds)):
                    raw = text.encode()
                    rows.append((zlib.crc32(ids[bounds[k] : bounds[k + 1]].astype("<i4").tobytes()), hashlib.sha256(raw).hexdigest(), raw == d[o[k] : o[k + 1]].tobytes()))
                crc, sha, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(np.diff(o)), pa.array(sha), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
