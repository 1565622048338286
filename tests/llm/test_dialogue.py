"""Conversation repair against trying all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridmatch.llm import dialogue

INSERTS = ["", "u", "a", "uu", "ua", "au", "aa"]


def tried(rows):
    """Least (cost, letters, repaired) over all edits of rows (role, text, fault), with up to two turns inserted at a place."""
    best, full = None, {"u": "user", "a": "assistant"}
    each = []
    for role, text, fault in rows:
        more = 5 * (fault == 3)
        ways = [("D", 2, None)]
        if fault in (0, 3):
            ways += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        each.append(ways)
    for ways in itertools.product(*each):
        kept = "".join("" if w[2] is None else w[2][0][:1] for w in ways)
        if len(re.sub("[sua]", "", kept)) or any(w[2] is not None and not w[2][0] for w in ways):
            continue
        for gaps in itertools.product(INSERTS, repeat=len(rows) + 1):
            out, letters, cost = [], "", 0
            for k, gap in enumerate(gaps):
                out += [(full[c], "") for c in gap]
                letters, cost = letters + "I" * len(gap), cost + 5 * len(gap)
                if k < len(rows):
                    letters, cost = letters + ways[k][0], cost + ways[k][1]
                    out += [ways[k][2]] if ways[k][2] else []
            if (best is None or (cost, letters) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                best = cost, letters, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def after_damage(conv, rows):
    """The damaged rows of one conversation (turn, role, text), in order, and their faults."""
    show = lambda v: " " if v is None else str(v)
    out = []
    for turn, role, text in rows:
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in out:
        bare = text.rstrip("\t\n\x0b\x0c\r ")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out, faults


def test_every_short_conversation():
    g = random.Random(4)
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool", "") for f in range(4)]
    initial = {"system": 1, "user": 2, "assistant": 3}
    cases = [[k] for k in kinds] + [[]] + g.sample(list(itertools.product(kinds, repeat=2)), 60)
    for case in cases:
        got = dialogue.edits(bytes(f * 4 + initial.get(r, 0) for r, f in case))
        assert got == tried([(r, "x", f) for r, f in case])[:2], case


def test_long_conversation_is_as_the_slow_recurrence():
    g = random.Random(8)
    codes = bytes(g.choice([0, 1, 2, 3]) + 4 * g.choice([0, 0, 0, 1, 2, 3]) for _ in range(3000))
    best = {"": (0, ""), "u": (5, "I"), "a": (10, "II")}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    for c in codes:
        new = {s: (k + 2, w + "D") for s, (k, w) in best.items()}
        if c >> 2 in (0, 3):
            for s, (k, w) in best.items():
                for symbol in "sua":
                    to = step.get((s, symbol))
                    same = " sua"[c & 3] == symbol
                    if to and (same or symbol != "s"):
                        new[to] = min(new.get(to, (1 << 40, "")), (k + (0 if same else 1) + 5 * (c >> 2 == 3), w + ("K" if same else "R")))
        for _ in range(2):
            for s, (k, w) in list(new.items()):
                to = "a" if s == "u" else "u"
                new[to] = min(new.get(to, (1 << 40, "")), (k + 5, w + "I"))
        best = new
    assert dialogue.edits(codes) == min(best[""], best["a"])


@pytest.fixture(scope="module")
def talks():
    g = random.Random(12)
    rows = []
    for conv in [*range(60), None]:
        for turn in g.sample(range(9), g.randint(1, 3)):
            rows.append((conv, turn if g.random() < 0.9 else None, g.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), g.choice(["Yes.", "No!", "cut off", "Why?  ", "", "  ", None, "Ä. é", "x" * 50_000 + "."])))
    rows += [(70, 1, "user", "same."), (70, 1, "user", "same."), (71, None, "user", "a."), (72, 5, "user", None)]
    return rows


def test_report_by_trying(spark, talks):
    t = spark.createDataFrame([(*r, "x", 1, 2) for r in talks], "conv_id long, turn long, role string, text string, audit string, cost int, code int").repartition(3)
    got = {r["conv_id"]: r for r in dialogue.report(t).collect()}
    assert set(got) == {r[0] for r in talks}
    for conv in got:
        rows, faults = after_damage(conv, [r[1:] for r in talks if r[0] == conv])
        if len(rows) > 4:
            continue
        turns = {r[0] for r in rows} - {None}
        first = [r[1][:1] for r in rows]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(first))
        cost, letters, text = tried([(r[1], r[2], f) for r, f in zip(rows, faults, strict=True)]) if rows else (0, "", "")
        want = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[conv])[1:] == want, (conv, rows)


def test_repaired_rows_and_empty_tables(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "user", "Hello?"), (1, 3, "assistant", "Yes."), (1, 4, "user", "And"), (2, 0, "assistant", " ")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in dialogue.repaired(t).collect())
    assert got == [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes.")]
    assert dialogue.report(t.limit(0)).count() == dialogue.repaired(t.limit(0)).count() == 0
    named = t.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id")))
    assert {r["conv_id"] for r in dialogue.report(named).collect()} == {"c1", "c2"}
