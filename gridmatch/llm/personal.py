"""Personal data: fixed patterns as seeds, and bootstrapped contexts that find what they miss.

All of it is column expressions and joins; nothing runs in Python.

Seeds are e-mail addresses, IP addresses, card and phone numbers found by pattern. Every token with a
digit or an @ stands in lexical patterns: the word before it, the two words before, the word after,
and the words on both sides. The token's own form is no part of them, so identifiers of a kind that
no seed has are found where seeds stand, and then lend their other contexts trust in turn.

A pattern takes part only if it is specific: of all places where its rarest word occurs, in any text,
so large a share must hold an identifier-like token in this pattern. Words of common speech are not,
however often a number happens to follow them. In rounds, a pattern's confidence is the share of its
distinct instances that are trusted, and an instance's trust grows with the confidence of the
patterns it stands in (noisy or). Tokens that no seed covers, but that stand in a pattern of high
confidence at the end, become spans of kind `context`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The kinds in order; those of the seeds come first.
KINDS = ("email", "ip", "card", "phone", "context")
#: The patterns of the seeds. They match what the plain forms match; possessive quantifiers keep long
#: runs linear, and (start of a run, or where the last match ended) is where a local part can begin.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A token with a digit or an @, from the start of its run of such characters to its last letter or digit.
INNER = r"\p{L}\p{M}._%+-"
IDENTIFIER = rf"(?<![{INNER}0-9@])(?=[{INNER}]*+[0-9@])(?:[._%+@-]*+[\p{{L}}\p{{M}}0-9]++)++"
#: The last word before a token, past opening punctuation or up to the token, and the first one after.
LEFT, RIGHT = r"(\S{1,40})(?:\s+[^\s\w]*)?$", r"^\W*\s+(\S{1,40})"
#: The word before that one; and how many characters on either side are looked at for words.
SECOND, AROUND = r"(\S{1,40})\s+\S{1,40}(?:\s+[^\s\w]*)?$", 120

ROUNDS = 3
#: What a pattern needs to be trusted: distinct trusted instances, and their share.
SUPPORT, CONFIDENCE = 5, 0.8
#: The confidence from which on a pattern lends trust to its instances; below, it would feed on itself.
LENDS = 0.5
#: The least share of its rarest word's places at which a pattern holds an identifier-like token.
SPECIFIC = 0.05
#: Matches whose places are summed up in one go.
TOGETHER = 256


def found(text: Column, pattern: str, may: Column, around: bool = False) -> Column:
    """Array of (s, e, m) of all matches, by code points; empty unless `may`, a cheap test.

    The pieces between matches and the matches alternate, so their lengths give the positions. They
    are summed up within groups of TOGETHER matches, then over groups, so a text's cost stays near
    its length. around: with the word before (l), the one before that (l2) and the first after (r),
    which may hold the neighbouring match.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    later = lambda a, k: F.slice(a, F.lit(k + 1), F.size(pieces))
    earlier = lambda a: F.concat(F.array(F.lit("")), a)
    both = F.arrays_zip(pieces.alias("p"), hits.alias("h"), earlier(pieces).alias("bp"), earlier(hits).alias("bh"), later(pieces, 1).alias("n"), later(hits, 1).alias("nh"), later(pieces, 2).alias("np")) if around else F.arrays_zip(pieces.alias("p"), hits.alias("h"))
    kind = "array<struct<s:int,e:int,m:string,l2:string,l:string,r:string>>" if around else "array<struct<s:int,e:int,m:string>>"
    length = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["h"]), F.lit(0))

    def one(pos: Column, x: Column) -> Column:
        s = pos + F.length(x["p"])
        cols = [s.alias("s"), (s + F.length(x["h"])).alias("e"), x["h"].alias("m")]
        if around:
            before, after = F.substring(F.concat(x["bp"], x["bh"], x["p"]), -AROUND, AROUND), F.substring(F.concat_ws("", x["n"], x["nh"], x["np"]), 1, AROUND)
            cols += [F.lower(F.regexp_extract(v, pattern, 1)).alias(n) for n, v, pattern in (("l2", before, SECOND), ("l", before, LEFT), ("r", after, RIGHT))]
        return F.struct(*cols)

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["h"].isNull(), acc).otherwise(F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(one(acc["at"], x))).alias("out")))

    def group(g: Column, start: Column) -> Column:
        return F.aggregate(g, F.struct(start.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / TOGETHER).cast("int")), lambda k: F.slice(both, k * TOGETHER + 1, TOGETHER))
    sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda acc, x: acc + length(x)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    many = F.flatten(F.transform(F.arrays_zip(groups.alias("g"), F.slice(starts, F.lit(1), F.size(groups)).alias("at")), lambda x: group(x["g"], x["at"])))
    return F.when(may, F.when(F.size(both) <= TOGETHER, group(both, F.lit(0))).otherwise(many)).otherwise(F.array().cast(kind))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (k, s, e), the seeds by kind and start; null text has none."""

    def kind(k: int, pattern: str, may: Column, keep: Callable[[Column], Column]) -> Column:
        kept = F.filter(found(text, pattern, may), lambda x: keep(x["m"]))
        return F.transform(kept, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    def card(m: Column) -> Column:
        d = F.regexp_replace(m, "[ -]", "")
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)

    return F.concat(
        kind(0, EMAIL, text.contains("@"), lambda m: m.isNotNull()),
        kind(1, IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        kind(2, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), card),
        kind(3, PHONE, text.contains("+"), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)),
    )


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of an id and a text, so that rows that share an id are told apart."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text))


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, base (seed spans) and seen (identifier-like tokens with their contexts) per row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    return d.select(row_key(F.col("doc_id"), text).alias("key"), "doc_id", base_spans(text).alias("base"), found(text, IDENTIFIER, text.rlike("[0-9@]"), True).alias("seen"))


def patterns(x: Column) -> Column:
    """The patterns (side, a, b) that a token of `seen` stands in; b is empty for one word."""
    one = lambda side, a, b=F.lit(""): F.struct(F.lit(side).alias("side"), a.alias("a"), b.alias("b"))
    two = lambda a, b: (a != "") & (b != "")
    every = F.array(F.when(x["l"] != "", one("l", x["l"])), F.when(x["r"] != "", one("r", x["r"])), F.when(two(x["l2"], x["l"]), one("ll", x["l2"], x["l"])), F.when(two(x["l"], x["r"]), one("lr", x["l"], x["r"])))
    return F.filter(every, lambda p: p.isNotNull())


def word_totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, total: how often every word up to 40 characters occurs in all texts, in lower case."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("word"))
    return words.where(F.length("word").between(1, 40)).groupBy("word").agg(F.count("*").alias("total"))


def specific_edges(every: DataFrame, totals: DataFrame) -> DataFrame:
    """(side, a, b, instance, seed): distinct instances of the patterns that are specific.

    Patterns with fewer than SUPPORT instances can never be trusted, so they go before words are looked up.
    """
    t = every.select("base", F.explode("seen").alias("x"))
    seed = F.exists("base", lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s")))
    t = t.select(F.col("x.m").alias("instance"), seed.cast("int").alias("seed"), F.explode(patterns(F.col("x"))).alias("c"))
    edges = written(t.groupBy("c.side", "c.a", "c.b", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "edges")
    pattern = edges.groupBy("side", "a", "b").agg(F.sum("n").alias("places"), F.count("*").alias("instances")).where(F.col("instances") >= SUPPORT)
    of = lambda c: totals.select(F.col("word").alias(c), F.col("total").alias(f"total_{c}"))
    pattern = pattern.join(of("a"), "a", "left").join(of("b"), "b", "left")
    # a word that only stands glued to a token (addr=1.2.3.4) is no word of its own, and specific
    rarest = F.least(F.coalesce("total_a", "places"), F.when(F.col("b") == "", F.lit(1 << 62)).otherwise(F.coalesce("total_b", "places")))
    good = pattern.where(F.col("places") >= SPECIFIC * rarest).select("side", "a", "b")
    return written(edges.join(good, ["side", "a", "b"], "left_semi").select("side", "a", "b", "instance", "seed"), "edges")


def learned(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The patterns (side, a, b) of high confidence. edges is what specific_edges() gives.

    The graph holds one edge for each distinct pattern and instance, which is far less than text;
    each round is two aggregations and a join on shuffled keys, and is written to the shared folder.
    """
    key = ["side", "a", "b"]

    def scored(trust: DataFrame) -> DataFrame:
        p = edges.join(trust, "instance").groupBy(*key).agg(F.sum("trust").alias("good"), F.count("*").alias("n"))
        return p.select(*key, "good", (F.col("good") / F.col("n")).alias("confidence"))

    trust = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("trust"))
    for _ in range(rounds):
        doubt = F.log(F.greatest(F.lit(1e-6), 1 - F.when((F.col("good") >= SUPPORT) & (F.col("confidence") >= LENDS), F.col("confidence")).otherwise(0)))
        trust = written(edges.join(scored(trust), key).groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(doubt).alias("d")).select("instance", F.when(F.col("seed") == 1, 1.0).otherwise(1 - F.exp("d")).alias("trust")), "trust")
    return scored(trust).where((F.col("good") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select(*key)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, base, spans (base and context spans) of every row.

    A null text counts as empty. Rows that repeat get the same spans; rows that share an id but not
    the text are kept apart (key is a hash of both). An empty table gives an empty result.
    """
    every = written(extracted(docs, id_col, text_col), "identifiers")
    free = every.select("key", "base", F.explode("seen").alias("x"))
    free = free.where(~F.exists("base", lambda b: (b["s"] < F.col("x.e")) & (b["e"] > F.col("x.s"))))
    free = free.select("key", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.explode(patterns(F.col("x"))).alias("c")).select("key", "s", "e", "c.*")
    good = learned(specific_edges(every, word_totals(docs, text_col)))
    more = free.join(good, ["side", "a", "b"], "left_semi").groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.lit(4).alias("k"), "s", "e"))).alias("more"))
    return every.join(more, "key", "left").select("key", "doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>"))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the four seed kinds and of context spans, base_sha256, spans."""

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return scanned(docs).select("doc_id", *counts, F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one.

    Rows travel as one struct, so that no column's name can clash.
    """
    spans = scanned(docs, id_col, text_col).where("size(spans) > 0").select("key", "spans").dropDuplicates(["key"])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text, names = F.col(f"row.`{text_col}`"), F.array(*[F.lit(f"[{k}]") for k in KINDS])
    rows = rows.withColumn("own", row_key(F.col(f"row.`{id_col}`"), F.coalesce(text, F.lit(""))))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))

    def step(acc: Column, x: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct((-x["e"]).alias("at"), gap.alias("out")))

    clean = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined = rows.join(spans, rows["own"] == spans["key"], "left")
    return joined.select(*[F.when(F.col("spans").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
