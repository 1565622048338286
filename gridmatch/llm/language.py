"""Language ID of mixed-language text: script ranges, word scores, Viterbi with a switching penalty.

A word's scripts narrow its candidate languages to those whose training letters use them. Each
candidate gets the log-likelihood of the word's byte n-grams, and the best path through a text, where
every change of language costs a penalty, labels its spans. The language that labels most letters is
the text's; its share of them is the score.

Long texts are cut into stretches that are solved in step for every entry language and then joined
(max-plus products), so the path is exact and a long text costs no more steps than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, hash_words, in_slices, runs, split_words, text_bytes

#: Labelled documents of each language that the model is fitted on, about; all if there are fewer.
TRAIN_ROWS = 5_000
#: Bytes of text labelled at once.
SLICE = 1 << 19
GRAMS, HASH_BITS = (1, 2, 3, 4), 16
#: What a change of language costs, in nats, and the words of a stretch.
PENALTY, STRETCH = 12.0, 256
#: A script is a language's if so large a share of its letters is in it.
SCRIPT_SHARE = 0.005

#: The starts of script ranges by code point, and their names.
SCRIPTS = [(0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "SouthEast"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x2C00, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7A4, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other")]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index("Common"), *[SCRIPT_NAMES.index(n) for _, n in SCRIPTS]])

#: Bytes as the n-grams see them: A-Z as a-z, what is no letter as a space.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    """Null without an id: such a row is labelled, but not learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _scripts_of(data: np.ndarray) -> np.ndarray:
    """The script of each character, at its first byte; -1 elsewhere and where no letter can be."""
    out = np.full(len(data), -1, np.int8)
    ascii_letter = (_SEEN[data] != 32) & (data < 128)
    out[ascii_letter] = SCRIPT_NAMES.index("Latin")
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        far = np.concatenate([data, np.full(3, 0x80, np.uint8)]).astype(np.int64)
        a, b, c, d = far[lead], far[lead + 1] & 63, far[lead + 2] & 63, far[lead + 3] & 63
        code = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        s = _SCRIPT[np.searchsorted(_STARTS, code, "right")]
        out[lead] = np.where(s == SCRIPT_NAMES.index("Common"), -1, s)
        out[lead[code == 0xD7]] = out[lead[code == 0xF7]] = -1
    return out


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of every word with a space before and after, and the word each belongs to."""
    size = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(at[-1]) - at[word]
    src = np.clip(starts[word] + place - 1, 0, max(0, len(data) - 1))
    seen = np.where((place == 0) | (place == size[word] - 1), 32, _SEEN[data[src]] if len(data) else 32).astype(np.uint32)
    out, owner = [], []
    for n in GRAMS:
        if len(seen) < n:
            continue
        h = np.full(len(seen) - n + 1, n * 40503, np.uint32)
        for i in range(n):
            h = (h ^ seen[i : len(seen) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = (place[: len(h)] + n <= size[word[: len(h)]]) & ~((seen[: len(h)] == 32) & (n == 1))
        out.append(h[inside] & np.uint32((1 << HASH_BITS) - 1))
        owner.append(word[: len(h)][inside])
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.empty(0, np.uint32), np.empty(0, np.int64))


def _ends(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each word ends."""
    stop = SPACE[data].copy()
    breaks = np.union1d(np.flatnonzero(stop), offsets)
    return breaks[np.searchsorted(breaks, starts, "right")]


def _letters(starts: np.ndarray, ends: np.ndarray, script: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(script >= 0)))
    return total[ends] - total[starts]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        data, offsets = text_bytes(b.column(0))
        for i, j in in_slices(offsets, SLICE):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, n = split_words(d, o)
            if not len(starts):
                continue
            ends, script = _ends(d, o, starts), _scripts_of(d)
            keep = _letters(starts, ends, script) > 0
            of = np.repeat(np.arange(j - i), n)[keep]
            gram, owner = _grams(d, starts[keep], ends[keep])
            of_byte = np.repeat(np.arange(j - i), np.diff(o))
            for lang in set(langs[i:j]):
                mine = langs[i:j] == lang
                c = counts.setdefault(lang, np.zeros((1 << HASH_BITS) + len(SCRIPT_NAMES), np.int64))
                c[: 1 << HASH_BITS] += np.bincount(gram[mine[of[owner]]], minlength=1 << HASH_BITS)
                s = script[mine[of_byte]]
                c[1 << HASH_BITS :] += np.bincount(s[s >= 0], minlength=len(SCRIPT_NAMES))
    for lang, c in counts.items():
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c[k])], ["lang", "k", "n"])


@dataclass
class Model:
    langs: list[str]
    #: n-gram -> log-likelihood of each language
    table: np.ndarray
    #: script -> which languages use it
    uses: np.ndarray
    #: the language of most training text
    usual: int


def train(docs: DataFrame, rows: int = TRAIN_ROWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fits a model on about `rows` labelled documents of each language, chosen by a hash.

    A language with fewer is learned from all of its documents, so none is lost at any size. Languages
    are taken as few: the tallies gathered are bounded by languages times 2^16 n-grams. Without
    labelled rows the model knows no language, and every text is `und`.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    big = {lang: n for lang, n in sizes.items() if n > rows}
    if big:
        most = F.create_map(*[F.lit(v) for lang, n in big.items() for v in (lang, int(rows / n * 2.0**63))])
        h = F.xxhash64("doc_id", "text").bitwiseAND((1 << 63) - 1)
        known = known.where(h < F.coalesce(most[F.col("lang")], F.lit((1 << 63) - 1)))
    tallies = known.select("text", "lang").mapInArrow(_tally, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), (1 << HASH_BITS) + len(SCRIPT_NAMES)))
    if tallies.num_rows:
        counts[np.searchsorted(langs, tallies.column("lang").to_pylist()), tallies.column("k").to_numpy()] = tallies.column("n").to_numpy()
    grams, scripts = counts[:, : 1 << HASH_BITS], counts[:, 1 << HASH_BITS :]
    p = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * (1 << HASH_BITS)))
    uses = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(1, keepdims=True))
    if not langs:
        return Model([], p.T.astype(np.float32), uses.T, -1)
    return Model(langs, (p - p.mean(0)).T.astype(np.float32).copy(), uses.T.copy(), int(scripts.sum(1).argmax()))


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, script: np.ndarray, model: Model) -> np.ndarray:
    """Log-likelihoods, words x languages; 0 for words without letters."""
    n, many = len(starts), len(model.langs)
    out = np.zeros((n, many), np.float32)
    gram, owner = _grams(data, starts, ends)
    if not len(gram):
        return out
    order = np.argsort(owner, kind="stable")
    gram, owner = gram[order], owner[order]
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    for k in range(many):
        out[owner[begins], k] = np.add.reduceat(model.table[:, k][gram], begins)
    word, seen = np.repeat(np.arange(n), ends - starts), script[runs(starts, ends - starts)]
    word, seen = word[seen >= 0], seen[seen >= 0]
    allowed = np.ones((n, many), bool)
    for s in np.unique(seen):
        if model.uses[s].any():  # a script that no language was seen in says nothing
            allowed[word[seen == s]] &= model.uses[s]
    some = allowed.any(1)
    out[some] = np.where(allowed[some], out[some], out[some] - 50)
    out[np.bincount(word, minlength=n) == 0] = 0
    return out


def best_paths(scores: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word; counts are the words of each text."""
    many = scores.shape[1]
    if many == 1 or not len(scores):
        return np.zeros(len(scores), np.int8)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    pieces = -(-counts // STRETCH)
    text_of = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[text_of] + number * STRETCH
    size = np.minimum(STRETCH, counts[text_of] - number * STRETCH)
    by = np.argsort(-size, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    base = np.cumsum(pieces) - pieces
    long = np.flatnonzero(pieces > 1)
    entry = np.zeros((len(by), many), np.float32)
    if len(long):
        # what each entry language of a stretch is worth at each exit language
        part = by[pieces[text_of[by]] > 1]
        through = np.where(np.eye(many, dtype=bool), 0.0, -penalty)[None].repeat(len(part), 0).astype(np.float32)
        for t in range(int(size[part[0]])):
            n = int(np.searchsorted(-size[part], -t, "left"))  # stretches longer than t
            v = through[:n]
            if t:
                v = np.maximum(v, v.max(2, keepdims=True) - penalty)
            through[:n] = v + scores[start[part[:n]] + t][:, None, :]
        at = {p: i for i, p in enumerate(part.tolist())}
        for k in long:
            v = np.zeros(many, np.float32)
            for p in range(base[k], base[k] + pieces[k]):
                entry[p] = v
                v = (v[:, None] + through[at[p]]).max(0)
                v -= v.max()
    s_start, s_size = start[by], size[by]
    live = np.searchsorted(-s_size, -np.arange(int(s_size[0])), "left")
    row = np.concatenate(([0], np.cumsum(live)))  # a word's row: row[its place in the stretch] + the stretch's place
    kind = np.int8 if many < 128 else np.int16
    back, v, every = np.empty((row[-1], many), kind), entry[by], np.arange(many)
    for t, n in enumerate(live.tolist()):
        top = v[:n].argmax(1)[:, None]
        jump = np.take_along_axis(v[:n], top, 1) - penalty
        stay = v[:n] >= jump
        back[row[t] : row[t] + n] = np.where(stay, every, top)
        v[:n] = np.where(stay, v[:n], jump) + scores[s_start[:n] + t]
    # backwards from every exit language at once; then the exits are chained from a text's end
    now = np.repeat(every[None].astype(kind), len(by), 0)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        before = np.take_along_axis(back[row[t] : row[t] + n], now[:n], 1)
        back[row[t] : row[t] + n] = now[:n]
        now[:n] = before
    state = v[place].argmax(1)
    for k in long:
        for p in range(base[k] + pieces[k] - 1, base[k], -1):
            state[p - 1] = now[place[p], state[p]]
    of = np.repeat(np.arange(len(by)), size)
    return back[row[np.arange(len(scores)) - start[of]] + place[of], state[of]]


def label(batch: pa.RecordBatch, model: Model) -> tuple[list[str], list[float], list[str]]:
    """Language, score and spans ("lang:first word-last word") of each text in column 0."""
    names, values, spans = [], [], []
    data, offsets = text_bytes(batch.column(0))
    if not model.langs:
        return ["und"] * batch.num_rows, [0.0] * batch.num_rows, [""] * batch.num_rows
    for i, j in in_slices(offsets, SLICE):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, counts = split_words(d, o)
        ends, script = _ends(d, o, starts), _scripts_of(d)
        _, own, kind = np.unique(hash_words(d, starts), return_index=True, return_inverse=True)  # equal words score alike
        path = best_paths(word_scores(d, starts[own], ends[own], script, model)[kind], counts)
        letters = _letters(starts, ends, script)
        first = np.concatenate(([0], np.cumsum(counts)))
        plain = np.concatenate(([0], np.cumsum((d < 128) & (_SEEN[d] != 32))))[o]
        for k in range(j - i):
            p, w = path[first[k] : first[k + 1]], letters[first[k] : first[k + 1]]
            if plain[k] == plain[k + 1] and not any(c.isalpha() for c in d[o[k] : o[k + 1]].tobytes().decode("utf-8")):
                names.append("und")
                values.append(0.0)
                spans.append("")
                continue
            if not w.any():  # letters of scripts that aren't told apart
                names.append(model.langs[model.usual])
                values.append(0.0)
                spans.append("")
                continue
            share = np.bincount(p, w, minlength=len(model.langs))
            best = int(share.argmax())
            names.append(model.langs[best])
            values.append(float(share[best] / w.sum()))
            cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            spans.append(",".join(f"{model.langs[p[a]]}:{a}-{b - 1}" for a, b in zip(cut, [*cut[1:], len(p)], strict=True)))
    return names, values, spans


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """The rows of docs with lang_pred, score and spans (or other names for them).

    Null texts and texts without a letter are `und` with score 0. Rows are labelled one by one from
    their text alone; equal texts agree. Columns of docs with these names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.StringType()), strict=True))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, values, spans = label(pa.record_batch([b.column(at)], ["text"]), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(values, pa.float64()), pa.array(spans, pa.string())], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)
