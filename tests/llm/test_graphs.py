"""Learned patterns of personal data against a slow version of the whole graph; the forest over many slices."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from gridmatch.llm import forest, personal


def slow_spans(texts):
    """Context spans of every text, from seeds found by the library's own patterns."""

    def seeds(t):
        out = [(m.start(), m.end()) for m in regex.finditer(personal.EMAIL, t)]
        out += [(m.start(), m.end()) for m in regex.finditer(personal.IP, t) if all(int(p) < 256 for p in m[0].split("."))]
        return out + [(m.start(), m.end()) for m in regex.finditer(personal.PHONE, t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]

    def first(pattern, t):
        m = regex.search(pattern, t)
        return m[1].lower() if m else ""

    seen, words = [], Counter()  # text, start, end, token, seed, patterns
    for n, t in enumerate(texts):
        words.update(w for w in t.lower().split() if len(w) <= 40)
        base, hits = seeds(t), [(m.start(), m.end()) for m in regex.finditer(personal.IDENTIFIER, t)]
        for k, (s, e) in enumerate(hits):
            before = t[hits[k - 2][1] if k > 1 else 0 : s][-personal.AROUND :]
            after = t[e : hits[k + 2][0] if k + 2 < len(hits) else len(t)][: personal.AROUND]
            one, two, right = first(personal.LEFT, before), first(personal.SECOND, before), first(personal.RIGHT, after)
            stands = [("l", one, "")] * (one != "") + [("r", right, "")] * (right != "") + [("ll", two, one)] * (one != "" and two != "") + [("lr", one, right)] * (one != "" and right != "")
            seen.append((n, s, e, t[s:e], any(a < e and b > s for a, b in base), stands))
    places, members, seed = Counter(), {}, {}
    for _, _, _, token, is_seed, stands in seen:
        for p in stands:
            places[p] += 1
            members.setdefault(p, set()).add(token)
            seed[p, token] = seed.get((p, token), False) or is_seed
    good = set()
    for p, tokens in members.items():
        rarest = min(words[p[1]] or places[p], (words[p[2]] or places[p]) if p[2] else math.inf)
        if len(tokens) >= personal.SUPPORT and places[p] >= personal.SPECIFIC * rarest:
            good.add(p)
    known = {t for p in good for t in members[p] if seed[p, t]}
    trust = {t: float(t in known) for p in good for t in members[p]}

    def scored():
        return {p: (sum(trust[t] for t in members[p]), sum(trust[t] for t in members[p]) / len(members[p])) for p in good}

    for _ in range(personal.ROUNDS):
        score = scored()
        doubt = dict.fromkeys(trust, 1.0)
        for p in good:
            g, c = score[p]
            for t in members[p]:
                doubt[t] *= max(1e-6, 1 - (c if g >= personal.SUPPORT and c >= personal.LENDS else 0))
        trust = {t: 1.0 if t in known else 1 - d for t, d in doubt.items()}
    sure = {p for p, (g, c) in scored().items() if g >= personal.SUPPORT and c >= personal.CONFIDENCE}
    out = [set() for _ in texts]
    for n, s, e, _, is_seed, stands in seen:
        if not is_seed and sure & set(stands):
            out[n].add((s, e))
    return out, sure


@pytest.mark.parametrize("noise", [0.0, 0.3, 0.6])
def test_contexts_as_the_slow_graph(spark, noise):
    g = random.Random(int(noise * 10))
    common = "the of and to in that it was for on with as".split()
    fill = lambda n: " ".join(g.choice(common) for _ in range(n))
    kinds = ["contact", "reach us", "server", "from", "member no", "ref"]
    texts = []
    for i in range(500):
        kind = g.choice(kinds)
        value = f"u{g.randint(0, 150)}@mail.org" if g.random() < 0.4 else f"10.0.{g.randint(0, 9)}.{g.randint(0, 99)}" if g.random() < 0.4 else f"K{g.randint(10**4, 10**4 + 200)}"
        if g.random() < noise:
            value, kind = f"{g.randint(1, 400)}", g.choice([*kinds, "chapter", "the"])
        texts.append(f"{fill(g.randint(0, 9))} {kind} {value} {g.choice(['now', 'today', ''])} {fill(g.randint(0, 9))}")
        if i % 5 == 0:
            texts[-1] += f" {g.choice(kinds)} K{g.randint(10**4, 10**4 + 200)} and {kind} K{g.randint(10**4, 10**4 + 200)} or 5 x2"
    texts += ["", "7", "contact 7", "a@b.org 7 8 9", fill(400)]
    want, sure = slow_spans(texts)
    got = {r["doc_id"]: r["spans"] for r in personal.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for n, t in enumerate(texts):
        mine = {tuple(map(int, s.split(":")[1:])) for s in got[n].split(",") if s.startswith("context")}
        assert mine == want[n], t
    assert sure and any(want)


def test_forest_over_many_slices(spark, monkeypatch):
    """Clustered and plain vectors in 20 slices: recall of 0.9 against brute force, every score exact, no query lost."""
    monkeypatch.setattr(forest, "SLICE", 100)
    g = np.random.default_rng(7)
    centres = g.standard_normal((40, 24)) * 3
    v = np.concatenate((centres[g.integers(0, 40, 1500)] + g.standard_normal((1500, 24)), g.standard_normal((500, 24)))).astype(np.float32)
    v[900] = v[100]
    t = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in forest.nearest(t, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q in range(0, 2000, 50):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-9 for _, i, s in mine)
        hits.append(len({i for _, i, _ in mine} & set(want)) / 10)
    assert np.mean(hits) >= 0.9
