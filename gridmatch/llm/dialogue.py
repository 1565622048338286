"""Repairing the turn structure of conversations by cheapest edits.

A conversation's rows, in order, are read by an automaton of four states: nothing yet, after a system
turn, after a user turn, after an assistant turn. A node of the graph is a number of rows read and a
state; keeping, changing the role of, or deleting a row leads one row on, inserting a turn leads to
another state. Arcs cost whole numbers up to 6, so Dial's queue of seven buckets, used in a ring,
settles every node's distance from the end. The cheapest edits are read off by walking from the start
along tight arcs (whose cost is the difference of the distances), taking the least letter each time:
letters of the arcs that leave a node are all different, so the walk is unique.

Two passes, both by conversation and turn. The first one takes one byte for each row (its role and
first fault; repeated rows are told by a window over conversation, role and digest), so a long
conversation is a byte array. Its edits, one letter each, head the conversation's rows in the second
pass, which streams the texts through a hash and holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: What the edits cost; DIRTY is added for a row that stays although cut off.
KEEP, REROLE, DELETE, INSERT, DIRTY = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
DEEPEST = REROLE + DIRTY
#: The state that a turn of this role leads to: a system turn first, then user and assistant in turn.
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What a user or assistant turn put at a state is, and leads to.
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_BEFORE = [[p for p, q in _NEXT.items() if q == s] for s in range(4)]
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A row's byte: its role's initial (0 for others) and its first fault times 4.
INITIALS, FAULTS = ["", "s", "u", "a"], ["", "blank", "duplicate", "truncated"]
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: From the byte and the state before: the state that keeping the row leads to, -1 if none.
_KEPT = np.array([[_AFTER.get((s, INITIALS[b & 3]), -1) if b >> 2 in (0, TRUNCATED) else -1 for s in range(4)] for b in range(16)])
_WORD = r"[^\x20\x09-\x0D]"


def distances(codes: bytes) -> list[int]:
    """For each node (4 x rows read + state) the least cost from there to an end, by buckets in a ring."""
    n = len(codes)
    far = 1 << 60
    out = [far] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(max(DEEPEST, INSERT) + 1)]
    for s in (START, ASSISTANT):
        out[4 * n + s] = 0
        ring[0].append(4 * n + s)
    d, waiting, kept = 0, 2, _KEPT.tolist()
    while waiting:
        bucket = ring[d % len(ring)]
        while bucket:  # arcs of cost 0 add to the bucket at hand
            node = bucket.pop()
            waiting -= 1
            if out[node] != d:
                continue
            i, s = divmod(node, 4)
            arcs = [(4 * i + p, INSERT) for p in _BEFORE[s]]
            if i:
                b = codes[i - 1]
                arcs.append((node - 4, DELETE))
                if b >> 2 in (0, TRUNCATED):
                    dirty = DIRTY if b >> 2 else 0
                    arcs += [(4 * (i - 1) + p, KEEP + dirty) for p in range(4) if kept[b][p] == s]
                    arcs += [(4 * (i - 1) + p, REROLE + dirty) for p in _BEFORE[s]]
            for before, cost in arcs:
                if d + cost < out[before]:
                    out[before] = d + cost
                    ring[(d + cost) % len(ring)].append(before)
                    waiting += 1
        d += 1
    return out


def edits(codes: bytes) -> tuple[int, str]:
    """The least cost and, among the cheapest edits, the letters that come first: D, I, K, R."""
    left = distances(codes)
    node, end, out = START, 4 * len(codes), []
    while left[node] or node < end:
        i, s = divmod(node, 4)
        b = codes[i] if node < end else DUPLICATE << 2
        dirty = DIRTY if b >> 2 else 0
        arcs = [("D", node + 4, DELETE)] if node < end else []
        arcs.append(("I", 4 * i + _NEXT[s], INSERT))
        if b >> 2 in (0, TRUNCATED):
            if (to := int(_KEPT[b][s])) >= 0:
                arcs.append(("K", 4 * i + 4 + to, KEEP + dirty))
            arcs.append(("R", 4 * i + 4 + _NEXT[s], REROLE + dirty))
        letter, node = next((a, to) for a, to, cost in arcs if left[to] + cost == left[node])
        out.append(letter)
    return left[START], "".join(out)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(talks: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn`; nulls there, in roles and texts are one space."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    d = talks.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, and code: the role's initial and the first fault."""
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    d = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.rlike("text", F.lit(_WORD)).alias("some"), last.isin(".", "!", "?").alias("ended"))
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("some"), BLANK).when(seen, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(0)
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(INITIALS) if c for x in (c, k)]), F.substring("role", 1, 1)), F.lit(0))
    return d.select("conv_id", "turn", "role", "digest", (fault * 4 + initial).cast("int").alias("code"))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from rows that are sorted by conversation and order."""

    def closed(conv, codes: bytearray, turns: list) -> list:
        least, most, distinct = turns
        c = np.frombuffer(codes, np.uint8)
        kinds = np.bincount(c >> 2, minlength=4)
        role = c & 3
        legal = {(1, 2), (2, 3), (3, 2)}
        fine = sum(int(((role[:-1] == p) & (role[1:] == q)).sum()) for p, q in legal)
        cost, letters = edits(bytes(codes))
        return [conv, most - least + 1 - distinct if distinct else 0, *kinds[1:].tolist(), len(c) - 1 - fine, cost, letters]

    def table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(_COUNTS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["conv_id", *_COUNTS, "audit"])

    now, codes, turns, begun, kind = None, bytearray(), [0, 0, 0], False, None
    for b in batches:
        kind, done = b.schema.field(0).type, []
        for conv, turn, code in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if not begun or conv != now:
                if begun:
                    done.append(closed(now, codes, turns))
                now, codes, turns, begun = conv, bytearray(), [0, 0, 0], True
            codes.append(code)
            if turn is not None and (not turns[2] or turn != turns[1]):  # they ascend
                turns = [turn if not turns[2] else turns[0], turn, turns[2] + 1]
        if done:
            yield table(done, kind)
    if begun:
        yield table([closed(now, codes, turns)], kind)


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, the counts and the audit of every conversation of damaged rows."""
    kind = dict(rows.dtypes)["conv_id"]
    m = marked(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "digest")
    return m.select("conv_id", "turn", "code").mapInArrow(_plans, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")


def _applied(batches: Iterator[pa.RecordBatch], take) -> Iterator:
    """take(conv_id, header, turns) for every conversation; turns are the repaired (role, text), one after the other."""

    def rows():
        for b in batches:
            for i in range(b.num_rows):
                yield [c[i].as_py() for c in b.columns]

    def repaired(letters: str, coming: Iterator):
        state = START
        for x in letters:
            role, text = ("", "") if x == "I" else next(coming)
            if x == "D":
                continue
            state = _AFTER[state, role[0]] if x == "K" else _NEXT[state]
            yield (role if x == "K" else _ROLES[state]), text

    stream = rows()
    for head in stream:
        letters = head[1]
        here = ((r[2], r[3]) for r in stream)
        turns = repaired(letters, here)
        yield take(head, turns)
        for _ in turns:
            pass


def with_headers(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after one that holds its audit and counts."""
    kind = dict(rows.dtypes)["conv_id"]
    digest = F.md5("text")
    body = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", *[F.lit(None).cast("long").alias(c) for c in _COUNTS], F.lit(1).alias("_k"), "turn", digest.alias("_d"))
    top = heads.select(F.col("conv_id").cast(kind).alias("conv_id"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *_COUNTS, F.lit(0).alias("_k"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("_d"))
    both = top.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "_k", F.col("turn").asc_nulls_first(), "role", "_d")
    return both.drop("_k", "turn", "_d")


def headers(talks: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each original conversation; those that lost all rows have zeros and no edits."""
    ids = talks.select("conv_id").distinct()
    got = found.withColumnRenamed("conv_id", "_c")
    joined = ids.join(got, ids["conv_id"].eqNullSafe(got["_c"]), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], F.coalesce("audit", F.lit("")).alias("audit"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digest(head: list, turns: Iterator) -> list:
        h, first = hashlib.sha256(), True
        for role, text in turns:
            h.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
            first = False
        return [*head, h.hexdigest()]

    kind: list = [None]

    def watched():
        for b in batches:
            kind[0] = b.schema.field(0).type
            yield b

    done: list[list] = []

    def table() -> pa.RecordBatch:
        types = [kind[0], pa.string(), *[pa.int64()] * len(_COUNTS), pa.string()]
        cut = [[r[0], r[1], *r[4:]] for r in done]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in cut], t) for k, t in enumerate(types)], ["conv_id", "audit", *_COUNTS, "repaired_sha256"])

    for row in _applied(watched(), digest):
        done.append(row)
        if len(done) >= 1000:
            yield table()
    if done:
        yield table()


def report(talks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage.

    talks: conv_id, turn, role, text; other columns are ignored. A null role or text is one space;
    rows without a conv_id are one conversation; rows without a turn come first and leave no gap.
    Rows of one turn are ordered by role, then by their text's md5. A conversation without rows after
    damage has zeros, no edits and the hash of nothing; an empty table gives an empty result. Long
    texts are hashed one row at a time.
    """
    rows = damaged(talks)
    kind = dict(talks.dtypes)["conv_id"]
    all_rows = with_headers(rows, headers(talks, plans(rows)))
    out = all_rows.mapInArrow(_hashed, f"conv_id {kind}, audit string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", repaired_sha256 string")
    return out.select("conv_id", *_COUNTS, "audit", "repaired_sha256")


def repaired(talks: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text: the conversations as they are (not damaged), with the cheapest edits made.

    Same rules for nulls and ties as in report(). Inserted turns have an empty text; a conversation
    that is deleted whole has no rows.
    """
    kind = dict(talks.dtypes)["conv_id"]
    rows = talks.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        key = first.schema.field(0).type

        def every():
            yield first
            yield from batches

        out: list[tuple] = []
        for part in _applied(every(), lambda head, turns: ((head[0], n, *t) for n, t in enumerate(turns))):
            for row in part:
                out.append(row)
                if len(out) >= 1000:
                    yield table(out, key)
                    out = []
        if out:
            yield table(out, key)

    def table(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((key, pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn", "role", "text"])

    return with_headers(rows, headers(talks, plans(rows))).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string")


#: Dynamic programming over rows with four states; each state has its cheapest, then least, edits.
REPORT_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(2) c(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, substr(role, 1, 1) AS initial,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations
), best AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 'r': ''} AS x, {'c': 9999999, 'a': '', 'r': ''} AS s, {'c': 5, 'a': 'I', 'r': 'user:'} AS u, {'c': 10, 'a': 'II', 'r': E'user:\nassistant:'} AS v FROM ids
  UNION ALL
  SELECT conv_id, i, x, s,
    list_min([u0, {'c': x.c + 5, 'a': x.a || 'I', 'r': x.r || 'user:'}, {'c': s.c + 5, 'a': s.a || 'I', 'r': s.r || E'\nuser:'}, {'c': v0.c + 5, 'a': v0.a || 'I', 'r': v0.r || E'\nuser:'}]) AS u,
    list_min([v0, {'c': u0.c + 5, 'a': u0.a || 'I', 'r': u0.r || E'\nassistant:'}, {'c': x.c + 10, 'a': x.a || 'II', 'r': x.r || E'user:\nassistant:'}, {'c': s.c + 10, 'a': s.a || 'II', 'r': s.r || E'\nuser:\nassistant:'}]) AS v
  FROM (
    SELECT b.conv_id, m.i, {'c': b.x.c + 2, 'a': b.x.a || 'D', 'r': b.x.r} AS x,
      list_min([{'c': b.s.c + 2, 'a': b.s.a || 'D', 'r': b.s.r}, {'c': CASE WHEN fine AND initial = 's' THEN b.x.c + more ELSE 9999999 END, 'a': b.x.a || 'K', 'r': role || ':' || text}]) AS s,
      list_min([{'c': b.u.c + 2, 'a': b.u.a || 'D', 'r': b.u.r},
        {'c': CASE WHEN fine THEN b.x.c + more + (initial <> 'u')::INT ELSE 9999999 END, 'a': b.x.a || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END, 'r': CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text},
        {'c': CASE WHEN fine THEN b.s.c + more + (initial <> 'u')::INT ELSE 9999999 END, 'a': b.s.a || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END, 'r': b.s.r || E'\n' || CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text},
        {'c': CASE WHEN fine THEN b.v.c + more + (initial <> 'u')::INT ELSE 9999999 END, 'a': b.v.a || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END, 'r': b.v.r || E'\n' || CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text}]) AS u0,
      list_min([{'c': b.v.c + 2, 'a': b.v.a || 'D', 'r': b.v.r},
        {'c': CASE WHEN fine THEN b.u.c + more + (initial <> 'a')::INT ELSE 9999999 END, 'a': b.u.a || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END, 'r': b.u.r || E'\n' || CASE WHEN initial = 'a' THEN role ELSE 'assistant' END || ':' || text}]) AS v0
    FROM best b JOIN (SELECT *, fault IN (0, 3) AS fine, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more FROM marked) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1
  )
), ended AS (
  SELECT b.conv_id, list_min([b.x, b.v]) AS e FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(c.n, 0)
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(e.e.c AS BIGINT) AS cost, e.e.a AS audit, sha256(e.e.r) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
