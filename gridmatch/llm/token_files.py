"""Token ids as Arrow files of fixed-size lists.

Texts are ranged over tasks by id, tokenized, and written as one stream in ascending id order: each
record holds SEQUENCE ids and a mask of which of them are real, RECORDS records to a batch, so any
sequence can be read in place by its number (SequenceFile). A file is closed at a document's end once it holds FILE_IDS ids; only its last record
is padded. Beside each file lies an index of its documents, and a manifest table lists the files.

Files are written under a name of their own and renamed when whole, so a task that is run again, or
twice, leaves the same files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import scratch, written

SEQUENCE = 1024
RECORDS = 256
FILE_IDS = 1 << 24
END_ID = 0
#: Pieces whose ids a worker remembers for good, and later ones, of which it starts anew at the bound.
CACHE, LATE = 750_000, 150_000

_known: dict[tuple[str, bool], _Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """How byte-level BPE writes each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_LETTER = _byte_letters()


class _Pieces(dict):
    """piece -> its ids, or None if it can't stand alone; the library encodes each once."""

    def __init__(self, library, kind: np.dtype, before: str):
        super().__init__()
        self.library, self.kind, self.before = library, kind, before
        self.word, self.after = library.model.tokenize, self
        self.late: dict[str, bytes] = {}
        self.code = "I" if kind.itemsize == 4 else "H"

    def tokens(self, p: str) -> bytes:
        plain = p.isascii() and p.isprintable()  # then only a space is written in another way
        letters = p.replace(" ", _LETTER[32]) if plain else "".join([_LETTER[b] for b in p.encode()])
        return array(self.code, [t.id for t in self.word(letters)]).tobytes()

    def keep(self, p: str, ids: bytes) -> bytes:
        """Remembers ids: the first pieces, which are the common ones, for good, later ones until there are too many."""
        if len(self) < CACHE:
            self[p] = ids
        else:
            if len(self.late) >= LATE:
                self.late.clear()
            self.late[p] = ids
        return ids

    def __missing__(self, p: str) -> bytes | None:
        if not p or p[0].isspace() or p[-1].isspace():
            return None
        if p in self.late:
            return self.late[p]
        if p.isalpha() and (p.isascii() or max(p) < "\u0250"):  # one pre-token: the library's model alone
            return self.keep(p, self.tokens(self.before + p))
        if p[-1] in ".,;:!?" and p[:-1].isalpha():  # a mark after a letter is a token of its own
            return self.keep(p, self[p[:-1]] + self.tokens(p[-1]))
        left, line, right = p.partition("\n")
        if line and left and right and p.count(line) < 50 and not left[-1].isspace() and not right[0].isspace():  # so is a line's end between others
            return self[left] + self.tokens(line) + self.after[right]
        return self.keep(p, np.array(self.library.encode(self.before + p, add_special_tokens=False).ids, self.kind).tobytes())


class _Encoder:
    """Ids of texts, put together from pieces.

    A text is cut before each single space between other characters, where byte-level BPE always
    cuts. A piece that has white space at an edge, or is empty, can't stand alone and sends its text
    the long way; so does an added token of the library anywhere in it.
    """

    def __init__(self, path: str, wide: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.first, self.rest = _Pieces(self.library, self.kind, ""), _Pieces(self.library, self.kind, " ")
        self.rest.after = self.first

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes())
                continue
            cut = iter(t.split(" "))
            head = self.first[next(cut)]
            try:
                out.append(head + b"".join(map(self.rest.__getitem__, cut)))
            except TypeError:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind).tobytes())
        return out


def encode(texts: list[str], path: str, wide: bool = False) -> list[bytes]:
    """The ids of each text, as little-endian 16- or 32-bit integers."""
    if (path, wide) not in _known:
        _known[path, wide] = _Encoder(path, wide)
    return _known[path, wide].encode(texts)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class _Writer:
    """One file of the stream and its index."""

    def __init__(self, folder: str, part: int, number: int, wide: bool):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.temp = f"part-{part:06d}-{number:05d}", f"{self.folder}/_{uuid.uuid4().hex}"
        self.kind = pa.uint32() if wide else pa.uint16()
        self.width = 4 if wide else 2
        self.schema = pa.schema([("ids", pa.list_(self.kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.ids, self.docs, self.starts, self.counts = [], 0, [], [], []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.counts.append(n)
        self.rest.append(ids)
        self.ids += n
        self.held += n
        if self.held >= SEQUENCE * RECORDS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        data = b"".join(self.rest)
        n = len(data) // self.width
        take = n if last else n - n % (SEQUENCE * RECORDS)
        self.rest, self.held = [data[take * self.width :]], n - take
        for a in range(0, take, SEQUENCE * RECORDS):
            real = min(take - a, SEQUENCE * RECORDS)
            full = -(-real // SEQUENCE) * SEQUENCE
            part = np.zeros(full, "<u4" if self.width == 4 else "<u2")
            part[:real] = np.frombuffer(data, part.dtype, real, a * self.width)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), SEQUENCE) for v in (part, np.arange(full) < real)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> tuple[str, int, int]:
        self.flush(True)
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "start": pa.array(self.starts, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(f"{self.temp}i") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        self._settle(f"{self.temp}i", f"{self.folder}/{self.name}.index.arrow")
        self._settle(self.temp, f"{self.folder}/{self.name}.arrow")
        return self.name, len(self.docs), self.ids


    def _settle(self, made: str, name: str) -> None:
        """Gives a whole file its name. A task that runs again makes the same bytes, so the first stays."""
        there = lambda: self.fs.get_file_info(name).type == pa.fs.FileType.File
        if not there():
            try:
                self.fs.move(made, name)
                return
            except OSError:
                if not there():
                    raise
        self.fs.delete_file(made)


def _write(folder: str, path: str, wide: bool):
    end = np.array([END_ID], "<u4" if wide else "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, rows = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for i in range(0, b.num_rows, 500):
                s = b.slice(i, 500)
                for doc, ids in zip(s.column(0).to_pylist(), encode(s.column(1).to_pylist(), path, wide), strict=True):
                    writer = writer or _Writer(folder, part, number, wide)
                    writer.add(doc, ids + end)
                    if writer.ids >= FILE_IDS:
                        rows.append((part, number, *writer.close()))
                        writer, number = None, number + 1
        if writer:
            rows.append((part, number, *writer.close()))
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "name", "n_docs", "n_ids"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files under folder; returns the manifest (part, number, name, n_docs, n_ids, first).

    first counts the ids of all files before. Null texts are empty documents (their end id only);
    null ids come first; rows with equal ids follow each other by text. No rows, no files.
    """
    wide = vocabulary_size(path) > 1 << 16
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = written(ranged.mapInArrow(_write(folder, path, wide), "part int, number int, name string, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class SequenceFile:
    """The sequences of a file by number. Every record batch but the last holds RECORDS of them."""

    def __init__(self, path: str, fs: pa.fs.FileSystem | None = None):
        local = fs is None or isinstance(fs, pa.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        many = self.reader.num_record_batches
        self.size = (many - 1) * RECORDS + self.reader.get_batch(many - 1).num_rows if many else 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, n: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the n-th sequence; of a local file both are views of the mapped bytes."""
        if not 0 <= n < self.size:
            raise IndexError(n)
        batch, at = self.reader.get_batch(n // RECORDS), n % RECORDS
        ids, mask = (batch.column(c).values.slice(at * SEQUENCE, SEQUENCE) for c in (0, 1))
        return ids.to_numpy(), mask


def read_sequences(fs: pa.fs.FileSystem, file: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the mask of a file, flat and copied together. SequenceFile reads in place."""
    source = pa.memory_map(file) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(file)
    with source, pa.ipc.open_file(source) as reader:
        batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
        ids = [b.column(0).values.to_numpy() for b in batches]
        mask = [b.column(1).values.to_numpy(zero_copy_only=False) for b in batches]
        return np.concatenate(ids), np.concatenate(mask)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, mask = read_sequences(fs, f"{at}/{name}.arrow")
                ids = ids[: int(mask.sum())]
                with fs.open_input_file(f"{at}/{name}.index.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                starts, counts = (index.column(c).to_numpy() for c in ("start", "n_tokens"))
                crcs = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(starts + first), pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""
    files = manifest.select("name", "first")
    return files.repartition(min(10_000, max(1, files.count())), "name").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, path or tokenizer_path()), folder)
