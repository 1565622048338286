"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import shared_dir, written  # noqa: F401

#: Rows of one Arrow batch; documents are long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def long_rows(spark: SparkSession) -> None:
    """Python workers get documents in batches of BATCH_ROWS, where no smaller number is set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Random values by position in a word (mod 64) and byte; A-Z as a-z, the space bytes as 0.
_TABULATION = np.random.default_rng(20240601).integers(1, 2**63, (64, 256), dtype=np.uint64)
_TABULATION[:, 65:91] = _TABULATION[:, 97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABULATION[:, SPACE] = 0
_TABULATION = _TABULATION.ravel()
#: Bytes hashed at once.
SLICE = 4 << 20


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], (o - o[0]).astype(np.int64)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words [^\\x20\\x09-\\x0D]+ of each text start, and how many words each text has."""
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] |= word[at]
    starts = np.flatnonzero(begins)
    return starts, np.diff(np.searchsorted(starts, offsets))


def hash_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: tabulation over its bytes, then a finalizer."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
        end = int(starts[j]) if j < len(starts) else len(data)
        s = starts[i:j] - starts[i]
        part = data[starts[i] : end]
        place = np.arange(len(part), dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(s, append=len(part)))
        value = _TABULATION[(place & 63) * 256 + part]
        far = place > 63
        if far.any():
            value[far] *= (place[far] >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        out[i:j] = np.add.reduceat(value, s)
        i = j
    return mix(out)


def in_slices(offsets: np.ndarray, limit: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of texts of about so many bytes each."""
    cuts, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        cuts.append((i, j))
        i = j
    return cuts


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    out = np.arange(int(size.sum()))
    out += np.repeat(start - (np.cumsum(size) - size), size)
    return out
