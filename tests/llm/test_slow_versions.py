"""Whole queries against slow versions in plain Python: languages with held-out documents, and the pipeline row by row."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmatch.llm import forest, jpeg, language, mixing, personal, pieces, queries, secrets, suffix_lm, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {
    "en": "the and was of to in that it for with on as at by from".split(),
    "de": "der und ist nicht über groß schön für mit auf dem eine sich".split(),
    "fr": "le la les des où être français été dans pour sur avec une".split(),
    "ru": "и в не на что быть он это как по но они мы этот который".split(),
}


@pytest.fixture(scope="module")
def rows():
    g = random.Random(17)
    out = []
    for i in range(260):
        lang = g.choice(list(VOCABULARY))
        text = " ".join(g.choice(VOCABULARY[lang]) for _ in range(g.choice([1, 3, 20, 60, 300])))
        if i % 6 == 0:  # another language in the middle
            text += " " + " ".join(g.choice(VOCABULARY[g.choice(list(VOCABULARY))]) for _ in range(40)) + " " + text
        if i % 7 == 0:
            text += g.choice([" mail a.b@c.example", " at 10.0.0.7", " call +1 (385) 555-1563", " card 4111 1111 1111 1111"])
        out.append((i, text, None if i % 9 == 4 else lang, None if i % 13 == 3 else f"s{i % 3}", len(text)))
    out += [(300 + k, t, "en", "s0", 1) for k, t in enumerate([None, "", " \n ", "12 34 !!", "😀 …", "日本語 文字", out[3][1], out[3][1] + " end", out[20][1], "x " * 5000])]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    return str(at)


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def script(char):
    """A letter's script; None for what is none."""
    code = ord(char)
    if code < 128:
        return "Latin" if char.isalpha() else None
    if code in (0xD7, 0xF7):
        return None
    name = language.SCRIPTS[bisect.bisect([s for s, _ in language.SCRIPTS], code) - 1][1]
    return None if name == "Common" else name


def grams(word):
    """Hashed n-grams of a word between two spaces; what is no letter is a space."""
    seen = [32, *(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in word.encode()), 32]
    out = []
    for n in language.GRAMS:
        for k in range(len(seen) - n + 1):
            if n == 1 and seen[k] == 32:
                continue
            h = n * 40503
            for b in seen[k : k + n]:
                h = ((h ^ b) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h & ((1 << language.HASH_BITS) - 1))
    return out


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


class SlowLanguage:
    def __init__(self, rows):
        counts, scripts = {}, {}
        for _, text, lang, *_ in rows:
            if text is None or lang is None:
                continue
            c, s = counts.setdefault(lang, Counter()), scripts.setdefault(lang, Counter())
            for w in split(text):
                found = [x for x in map(script, w) if x]
                s.update(found)
                if found:
                    c.update(grams(w))
        self.langs = sorted(counts)
        size = 1 << language.HASH_BITS
        self.log = {x: [math.log((counts[x][h] + 0.1) / (sum(counts[x].values()) + 0.1 * size)) for h in range(size)] for x in self.langs}
        self.uses = {x: {n for n in scripts[x] if scripts[x][n] >= max(1, language.SCRIPT_SHARE * sum(scripts[x].values()))} for x in self.langs}
        self.usual = max(self.langs, key=lambda x: sum(scripts[x].values()))

    def word(self, w):
        letters = [s for s in map(script, w) if s]
        if not letters:
            return [0.0] * len(self.langs)
        mean = [sum(self.log[x][h] for x in self.langs) / len(self.langs) for h in grams(w)]
        out = [sum(self.log[x][h] - m for h, m in zip(grams(w), mean, strict=True)) for x in self.langs]
        allowed = [all(s in self.uses[x] or not any(s in u for u in self.uses.values()) for s in letters) for x in self.langs]
        return [v if a else v - 50 for v, a in zip(out, allowed, strict=True)] if any(allowed) else out

    def label(self, text):
        """Language, and its share of the letters."""
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        words = split(text)
        letters = [sum(script(c) is not None for c in w) for w in words]
        if not sum(letters):
            return self.langs[self.langs.index(self.usual)], 0.0
        best, back = [0.0] * len(self.langs), []
        for n, w in enumerate(words):
            top = max(range(len(best)), key=lambda k: best[k])
            from_ = [k if n == 0 or best[k] >= best[top] - language.PENALTY else top for k in range(len(best))]
            best = [(best[k] if at == k else best[at] - language.PENALTY) + s for (k, at), s in zip(enumerate(from_), self.word(w), strict=True)]
            back.append(from_)
        path = [max(range(len(best)), key=lambda k: best[k])]
        for f in reversed(back[1:]):
            path.append(f[path[-1]])
        share = Counter()
        for k, n in zip(reversed(path), letters, strict=True):
            share[k] += n
        top = max(share, key=lambda k: (share[k], -k))
        return self.langs[top], share[top] / sum(letters)


def test_languages_of_held_out_documents(spark, rows, folder):
    slow = SlowLanguage([r for r in rows if not held(r[0], 5, 0)])
    got = {r["doc_id"]: r for r in queries.op5_language_spans(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, text, *_ in rows:
        lang, score = slow.label(text)
        assert (got[i]["held_out"], got[i]["lang_pred"]) == (held(i, 5, 0), lang), text
        assert got[i]["score"] == pytest.approx(score, abs=0.02)
    right = [got[i]["lang_pred"] == lang for i, text, lang, *_ in rows if lang and held(i, 5, 0) and i < 300 and i % 6]
    assert sum(right) >= 0.95 * len(right)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def luhn(d):
    return sum(x - 9 * (x > 9) for i, c in enumerate(reversed(d)) for x in [int(c) * (1 + i % 2)]) % 10 == 0


def redacted(x):
    spans = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    spans += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    spans += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    out, at = "", 0
    for s, e, kind in sorted(spans, key=lambda v: (v[0], -v[1])):
        if s >= at:
            out += x[at:s] + f"[{kind}]"
        at = max(at, e)
    return out + x[at:]


def copies(docs, seed="mix"):
    """How often the mix takes each (id, text, source), one source after the other."""
    size = {i: len((t or "").encode().split()) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(sources)}, {}, set(sources)
    left = float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in full}
        left, open_ = left - sum(3 * total[s] for s in full), open_ - full
    out = Counter()
    for s in sources:
        u = int(hashlib.md5(f"{seed}:{'null' if s is None else '=' + s}".encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / total[s] if total[s] else 0.0
        mine = sorted((i for i, _, x in docs if x == s), key=lambda i: (size[i], hashlib.md5(str(i).encode()).hexdigest()))
        for rank, i in enumerate(mine, 1):
            out[i] = math.floor(rank * rate + u) - math.floor((rank - 1) * rate + u)
    return out


def test_pipeline_row_by_row(spark, rows, folder):
    from sentencepiece import SentencePieceProcessor

    import corpus_pipeline as cp

    slow = SlowLanguage([r for r in rows if not held(r[0], 5, 0)])
    known = [r for r in rows if (found := slow.label(r[1]))[0] != "und" and found[1] >= cp.LEAST_SHARE]
    assert any(r[1] and split(r[1]) for r in rows if r not in known)
    comp, sets = {r[0]: r[0] for r in known}, {r[0]: shingles(r[1]) for r in known}
    for _ in range(6):
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    first = [r for r in known if comp[r[0]] == r[0]]
    assert len(first) < len(known)
    clean = {r[0]: redacted(r[1]) for r in first}
    assert sum(clean[r[0]] != r[1] for r in first) > 10
    times = copies([(r[0], clean[r[0]], r[3]) for r in first])
    sp = SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter()
    for i, text in clean.items():
        ids = sp.encode(text)
        want[i, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), len(text.encode())] += times[i]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["n_bytes"]) for r in cp.run(spark, folder).collect())
    assert got == +want and max(got.values()) > 1


def test_extra_columns_and_lost_ids(spark):
    """Columns with the names that operators use inside, null and repeated ids: each row is answered, none crashes."""
    texts = ["some words password=abcdef12345 and more", None, "", "same", "same", "a.b@c.de x"]
    clash = ["key", "spans", "score", "bits", "media", "size", "h", "tokens", "_row", "rank"]
    t = spark.createDataFrame([(None if k == 2 else 7 if k > 3 else k, x, "en", "s", *clash) for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))
    assert secrets.scan(t, secrets.train(t)).count() == personal.report(t).count() == pieces.digests(t).count() == mixing.mix(t).count() == token_files.token_files(t).count() == len(texts)
    assert jpeg.media_features(jpeg.media_column(t.drop("media"))).count() == len(texts)
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_files.token_files(t).collect())
    assert starts[0][2] is None and all(a + n == b for (a, n, _), (b, *_) in zip(starts, starts[1:]))
    scored = suffix_lm.score(t).collect()
    assert len(scored) == len(texts) and [r["held_out"] for r in scored if r["doc_id"] is None] == [None] and all(r["score"] < 0 for r in scored)
    v = spark.createDataFrame([(i, [float(i), 1.0], "x", 1.0) for i in range(30)], "vec_id long, embedding array<float>, rank string, score double")
    assert forest.nearest(v, F.col("vec_id") % 10 == 0).count() == 30
