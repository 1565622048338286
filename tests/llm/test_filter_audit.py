"""The filter audit against running all orders document by document."""

import random
from collections import Counter

from gridmatch.llm import filter_audit


def slow(rows, labels):
    smallest, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    out = {}
    for i, text, source in rows:
        text = text or ""
        w = text.encode().split()
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > smallest[text]}
        for order in filter_audit.ORDERS:
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((source or "", order, step), Counter())
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if not gone and fails[f]:
                    gone = True
                    c["removed"] += 1
                    c["good_lost"] += i in good
                    c["toxic_lost"] += i in toxic
                c["kept"] += not gone
    sums = Counter()
    for (part, order, step), c in out.items():
        sums[part, order[step - 1]] += c["removed"]
    return {(p, o, s, c["kept"], c["removed"], c["redundant"], c["unique_fails"], c["good_lost"], c["toxic_lost"], sums[p, o[s - 1]]) for (p, o, s), c in out.items()}


def test_all_orders(spark):
    g = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["Ünïc", "CAPS", "a#b", "ß"]
    texts = [" ".join(g.choice(words[: g.choice([8, 40, 44])]) for _ in range(g.choice([3, 49, 50, 51, 90]))) for _ in range(60)] + [None, "", " \t", "A" * 5000, "x " * 30_000]
    rows = [(i, g.choice(texts), g.choice(["s1", "s2", "s2", "s2", "", None])) for i in [*range(150), None, None, 7, 7]]
    rows += [(200 + i, "copied many times", "hot") for i in range(60)]
    labels = [(i, g.choice([0, 1, None]), g.choice([0, 1, None])) for i in [*range(0, 150, 2), 4, 4, None, 999]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, label int, bits string").repartition(3)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = {tuple(r) for r in filter_audit.audit(docs, marks).collect()}
    assert got == slow(rows, [r for r in labels if r[0] is not None])
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {r[7] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


def test_lookup():
    for bits, o in ((0, 5), (31, 77), (5, 13), (16, 119), (10, 60)):
        failing = [k for k, f in enumerate(filter_audit.ORDERS[o], 1) if bits >> "ABCDE".index(f) & 1]
        assert filter_audit.LOOKUP[bits, o] == (failing[0] if failing else 0)
