"""The shingle join against comparing all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridmatch.llm import ngram_join as J
from gridmatch.llm.neardup import SHINGLE


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def expected(rows):
    sets, comp = [shingles(t) for _, t in rows], {i: i for i, _ in rows if i is not None}
    pairs = [(i, j) for a, (i, _) in enumerate(rows) for b, (j, _) in enumerate(rows[:a]) if None not in (i, j) and (i == j or sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))]
    for _ in range(30):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted(((i, len(s), comp.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


@pytest.fixture(scope="module")
def rows():
    g = random.Random(21)
    prose = lambda n: [g.choice("abcdefghijklmnopqrstuvwxyz") + str(g.randint(0, 400)) for _ in range(n)]
    out, line = [], prose(30)
    for n in (6, 12, 40, 60, 90, 150, 400):
        base = prose(n)
        for k in range(9):  # near copies on both sides of the threshold, and chains of them
            w = list(base)
            for _ in range(k * max(1, n // 120)):
                w[g.randrange(n)] = g.choice("xyz") + str(g.randint(0, 9))
            out.append(" ".join(w))
            base = w if k % 2 else base
    out += [" ".join(prose(20) + line + prose(g.randint(0, 9))) for _ in range(150)]  # a passage that many share
    out += [" ".join(line + prose(g.randint(0, 8))) for _ in range(90)]
    out += ["one two", "ONE  two", "one", "a b c d", "a b c d e", "a b c d e f", None, "", " \n", " ".join(prose(9000))]
    out += [out[-1] + " more", "same text many times over and over again"] + ["same text many times over and over again"] * 80
    g.shuffle(out)
    return [*enumerate(out), (3, out[50]), (3, out[90]), (3, None), (None, out[0]), (None, None), (7, out[7]), (7, out[7])]


def test_components(spark, rows):
    t = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, rep int, key string").repartition(3)
    assert sorted((tuple(r) for r in J.similar_documents(t).collect()), key=repr) == expected(rows)
    assert J.similar_documents(t.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    assert sorted((tuple(r) for r in J.similar_documents(none).collect()), key=repr) == [(1, 0, 1), (2, 0, 2), (None, 1, None)]


def test_filters_lose_no_link(rows):
    """Linked sets of any size: enough kept tokens in common, prefixes meet, bitmaps and sizes allow them."""
    g = np.random.default_rng(6)
    for _ in range(400):
        n = int(g.choice([1, 2, 5, 6, 9, 10, 11, 24, 25, 59, 60, 61, 300, 5000]))
        x = np.unique(g.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((g.permutation(x)[: -(-len(x) * 9 // 10)], g.integers(0, 2**63, int(g.integers(0, max(1, n // 9) + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * len(np.union1d(x, y)):
            continue
        p, q = (s[: J.kept(len(s))] for s in (x, y))
        shared = len(np.intersect1d(p, q))
        assert shared >= J.sure(len(x)) and shared >= J.sure(len(y))
        for order in range(3):  # any order: the last of what is kept may be left out
            first = [s[np.argsort(J.ranked(s, order))][: len(s) - int(J.sure(m)) + 1] for s, m in ((p, len(x)), (q, len(y)))]
            assert len(np.intersect1d(*first))
        words = [np.frombuffer(J.parity(s), np.uint64)[None] for s in (x, y)]
        assert J.possible(np.array([len(x)]), np.array([len(y)]), *words)[0]


def test_occurrences_in_many_flushes(monkeypatch):
    monkeypatch.setattr(J, "FLUSH", 5000)
    g = random.Random(3)
    sets = {r: sorted({g.randrange(2**63) if g.random() < 0.4 else g.choice([5, 6, 7, 8, *range(100, 160), *range(1000, 9000)]) for _ in range(40)} | {5, 6 + r % 2}) for r in range(900)}
    batch = pa.record_batch([pa.array(list(sets)), pa.array([np.array(s, np.uint64).tobytes() for s in sets.values()], pa.binary())], ["rep", "tokens"])
    posted = pa.Table.from_batches(list(J._postings(7)(iter([batch.slice(0, 400), batch.slice(400)])))).sort_by("bucket")
    assert any(posted["direct"].to_pylist()) and len(set(posted["bucket"].to_pylist())) > 1
    got = defaultdict(dict)
    for b in J._repeated(iter(posted.to_batches(max_chunksize=5))):
        for rep, token, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[rep][token] = seen
    count = Counter(t for s in sets.values() for t in s)
    assert got == {r: {t: min(count[t], J.CAPPED) for t in s if count[t] > 1} for r, s in sets.items()}


def test_pairs_leave_their_groups_about_once():
    """Sets that share many keys are handed on under few of them, and no pair is lost."""
    g = random.Random(11)
    common = [g.randrange(-(2**63), 2**63 - 1) for _ in range(60)]
    keys = [sorted(g.sample(common, 45) if r < 40 else g.sample(common, r % 4 + 1)) for r in range(60)]
    groups = {k: [r for r in range(60) if k in keys[r]] for k in common}
    first = [J.least_keys(np.array(k, np.int64)) for k in keys]
    bits = J.folded(bytes(J.BITS // 8))  # sizes and bitmaps let every pair pass
    names, got, apart = ["key", "hb", "gb", "home", "stray", "rep", "comp", "n", "few", "first"], Counter(), 0
    for k, held in groups.items():
        sides = [(True, r) for r in held] + [(False, r) for r in held[1:]]  # every set is a component, the first one the main one
        rows = [(k, 0, 0, home, r != held[0], r, r, 50, bits, first[r]) for home, r in sides]
        t = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
        for b in J._across(iter(t.to_batches(max_chunksize=16))):
            got.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        apart += len(held) * (len(held) - 1) // 2
    assert set(got) == {(a, b) for b in range(60) for a in range(b) if set(keys[a]) & set(keys[b])}
    assert apart > 15 * len(got) and sum(got.values()) <= 2 * len(got)


def test_leaders_have_fewest_tokens_of_their_own(spark):
    held = spark.createDataFrame([(5, 1, 0.2), (5, 2, 0.0), (5, 3, 0.0), (6, 4, 0.1), (7, 1, 0.2), (7, 9, 0.3)], "key long, rep long, lone double")
    assert sorted(tuple(r) for r in J._leaders(held).select("key", "n_key", "leader").collect()) == [(5, 3, 2), (7, 2, 1)]
