"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order models over identifier characters are trained on the documents themselves: one of
random strings (labelled by the fixed patterns: assigned values, access keys, long hex runs), one of
ordinary identifiers (all other runs of WORDLIKE such characters or more). A long token of several
different characters whose log-likelihood ratio per character is high enough reads like a random
string and becomes a span of its own. Tokens under 20 characters are left to the fixed patterns.
Counts come from all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, text_bytes

#: The kinds in order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the models look at.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What an ordinary identifier has at least in characters, and a token of its own in different ones.
WORDLIKE, DIFFERENT = 3, 8
#: Least log-likelihood ratio per character, in nats.
THRESHOLD = 0.75

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1  # 0: any other character, or the start
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, N)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    low = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    low += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(low)


def _pairs(data: np.ndarray, starts: np.ndarray, least: int = 1) -> np.ndarray:
    """Counts of (previous, next) character codes in runs of at least so many; texts start at `starts`."""
    code = _CODE[data]
    before = np.concatenate(([0], code[:-1])) if len(code) else code
    before[starts[starts < len(code)]] = 0
    begin = np.flatnonzero((code > 0) & (before == 0))
    inside = code > 0
    number = np.cumsum((code > 0) & (before == 0)) - 1
    size = np.bincount(number[inside], minlength=len(begin))
    inside[inside] = size[number[inside]] >= least
    return np.bincount(before[inside] * N + code[inside], minlength=N * N)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    random, every = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
    for b in batches:
        data, offsets = text_bytes(b.column(0))
        for i, j in in_slices(offsets, 1 << 20):
            every += _pairs(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], WORDLIKE)
        for text in b.column(0).to_pylist():
            for start, kind, end in base_spans(text or ""):
                value = text[start:end]
                if kind == 0:
                    value = ASSIGN.match(value)[2]
                elif kind == 1:
                    value = value[4:]
                random += _pairs(np.frombuffer(value.encode(), np.uint8), np.zeros(1, np.int64))
    for name, counts in (("random", random), ("every", every)):
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(pair), pa.string()), pa.array(pair), pa.array(counts[pair])], ["model", "pair", "n"])


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(next | previous, random) - log P(next | previous, ordinary), as an N x N table.

    Each task counts its own documents; at most two tables of N * N = 4624 counts are gathered.
    Without labelled samples the random model is uniform.
    """
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "model string, pair long, n long").groupBy("model", "pair").agg(F.sum("n").alias("n"))
    table = {"random": np.zeros(N * N), "every": np.zeros(N * N)}
    for r in counts.collect():
        table[r["model"]][r["pair"]] = r["n"]

    def log_p(x: np.ndarray) -> np.ndarray:
        x = x.reshape(N, N)
        shared = x.sum(0) + 0.5  # what follows any character stands in for rare ones
        shared[0] = 0
        shared /= shared.sum()
        return np.log(np.maximum((x + 20 * shared) / (x.sum(1, keepdims=True) + 20), 1e-12))

    return log_p(table["random"]) - log_p(np.maximum(table["every"] - table["random"], 0))


def ratio(token: str, model: np.ndarray) -> float:
    """The mean log-likelihood ratio of a token's characters."""
    code = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    return float(model[np.concatenate(([0], code[:-1])), code].mean())


def spans(text: str, model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """The base spans, and those the models add: long random tokens that overlap no base span."""
    found = base_spans(text)
    free, k, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            reach = max(reach, found[k][2])
            k += 1
        if reach <= m.start() and len(set(m[0])) >= DIFFERENT and ratio(m[0], model) >= threshold:
            free.append((m.start(), 3, m.end()))
    return sorted(found + free)


def written_out(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every row.

    Null and empty texts have no spans; rows are treated one by one, so repeats and ties agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                found = spans(text or "", model, threshold)
                kinds = [k for _, k, _ in found]
                base = written_out([x for x in found if x[1] < 3])
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), written_out(found)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
