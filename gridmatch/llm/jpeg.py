"""Baseline JPEG: payloads stored as quantized coefficients, and a decoder for thumbnails.

The decoder parses markers, splits scans at restart markers, and Huffman-decodes all the resulting
intervals of all images of a batch in step, one symbol of each at a time, in numpy. It takes any
8-bit baseline file: several components, sampling factors, interleaved or separate scans.

A payload byte b is stored as one coefficient of category 8, whose eight extra bits are b itself
(b >= 128: the value b, else b - 255), in zigzag order, 64 to a block. Each block is a restart
interval of its own, so that a block can be read without those before. A comment holds the length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, text_bytes

BLOCK, UNIT, PAD = 64, 192, 32


# writing -------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(n_bytes: int, cols: int, rows: int) -> bytes:
    only = bytes([1] + [0] * 15)  # one code, of one bit
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, b"payload " + str(n_bytes).encode()),
            _segment(0xDB, bytes([0]) + bytes([1] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, cols * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, bytes([0x00]) + only + bytes([8])),
            _segment(0xC4, bytes([0x10]) + only + bytes([8])),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _pack(blocks: np.ndarray) -> np.ndarray:
    """Each row of 64 bytes as 72: a 0 bit, the code, before the 8 bits of each byte."""
    b = blocks.reshape(-1, 8).astype(np.uint16)
    out = np.zeros((len(b), 9), np.uint16)
    for k in range(8):
        out[:, k] |= b[:, k] >> (k + 1)
        out[:, k + 1] |= b[:, k] << (7 - k)
    return out.astype(np.uint8).reshape(-1, 72)


def pad(data: bytes) -> bytes:
    """data with bytes 32 appended up to a positive multiple of 192."""
    return data + bytes([PAD]) * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def encode(payloads: list[bytes]) -> list[bytes]:
    """One baseline JPEG for each payload (whose length is a multiple of 64)."""
    shapes = []
    for p in payloads:
        n = len(p) // BLOCK
        cols = max(1, int(np.ceil(np.sqrt(n))))
        shapes.append((cols, max(1, -(-n // cols))))
    fill = [p + bytes([PAD]) * (c * r * BLOCK - len(p)) for p, (c, r) in zip(payloads, shapes, strict=True)]
    packed = _pack(np.frombuffer(b"".join(fill), np.uint8))
    marks = np.empty((len(packed), 74), np.uint8)
    marks[:, :72], marks[:, 72] = packed, 0xFF
    out, at = [], 0
    for p, (c, r) in zip(payloads, shapes, strict=True):
        m = marks[at : at + c * r]
        m[:, 73] = 0xD0 + np.arange(c * r) % 8
        flat = m.ravel()
        if (m[:, :72] == 0xFF).any():  # a 0xFF among the data is followed by a 0
            data = np.flatnonzero((flat == 0xFF) & (np.arange(len(flat)) % 74 < 72))
            flat = np.insert(flat, data + 1, 0)
        out.append(_head(len(p), c, r) + flat[:-2].tobytes() + b"\xff\xd9")
        at += c * r
    return out


# reading -------------------------------------------------------------------------------------


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comments: list[bytes] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    #: id, horizontal and vertical sampling, quantization table
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    #: component -> (block rows, block columns), padded to whole MCUs
    grid: dict[int, tuple[int, int]] = field(default_factory=dict)
    coefficients: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass
class _Scan:
    image: Image
    data: np.ndarray
    lanes: np.ndarray
    #: for each block of the scan in order: component, its block number; tables by component
    where: np.ndarray
    blocks: np.ndarray
    per_lane: int
    tables: dict[int, tuple[bytes, bytes]]


def _scan_order(image: Image, chosen: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Component and block number of each block of a scan in order, and blocks to an MCU."""
    parts = {p[0]: p for p in image.parts}
    most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    if len(chosen) == 1:  # only the blocks that hold pixels, by row
        cid, h, v, _ = parts[chosen[0]]
        rows = -(-(-(-image.height * v // most_v)) // 8)
        cols = -(-(-(-image.width * h // most_h)) // 8)
        number = (np.arange(rows)[:, None] * image.grid[cid][1] + np.arange(cols)).ravel()
        return np.full(rows * cols, cid), number, 1
    mcu_rows, mcu_cols = -(-image.height // (8 * most_v)), -(-image.width // (8 * most_h))
    where, number = [], []
    y, x = np.divmod(np.arange(mcu_rows * mcu_cols), mcu_cols)
    for c in chosen:
        cid, h, v, _ = parts[c]
        for dy in range(v):
            for dx in range(h):
                where.append(np.full(len(y), cid))
                number.append((y * v + dy) * image.grid[cid][1] + x * h + dx)
    return np.stack(where, 1).ravel(), np.stack(number, 1).ravel(), len(where)


def parse(data: bytes) -> tuple[Image, list[_Scan]]:
    """The image's frame and its scans, not yet decoded. ValueError if it isn't baseline."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, scans, tables, restart, at = Image(), [], {}, 0, 2
    raw = np.frombuffer(data, np.uint8)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 64 * (2 if wide else 1)
                image.quant[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not image.height or not image.width:
                raise ValueError("not 8-bit baseline")
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if n == 1:
                image.parts = [(image.parts[0][0], 1, 1, image.parts[0][3])]
            h, v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
            for cid, ch, cv, _ in image.parts:
                image.grid[cid] = (-(-image.height // (8 * v)) * cv, -(-image.width // (8 * h)) * ch)
                image.coefficients[cid] = np.zeros((image.grid[cid][0] * image.grid[cid][1], 64), np.int16)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            rest = raw[at:]
            ff = np.flatnonzero(rest[:-1] == 0xFF)
            follows = rest[ff + 1]
            ends = ff[(follows != 0) & (follows != 0xFF) & ~((follows >= 0xD0) & (follows <= 0xD7))]
            end = int(ends[0]) if len(ends) else len(rest)
            inside = ff < end
            ff, follows = ff[inside], follows[inside]
            keep = np.ones(end, bool)
            marks = ff[(follows >= 0xD0) & (follows <= 0xD7)]
            keep[ff[follows == 0] + 1] = False
            keep[marks], keep[marks + 1] = False, False
            kept = np.concatenate(([0], np.cumsum(keep)))
            where, number, per_mcu = _scan_order(image, [c for c, _ in chosen])
            lanes = kept[np.concatenate(([0], marks + 2))] if restart else np.zeros(1, np.int64)
            per_lane = restart * per_mcu if restart else len(where)
            if len(lanes) != -(-len(where) // per_lane):
                raise ValueError("restart intervals don't add up")
            scans.append(_Scan(image, rest[:end][keep], lanes, where, number, per_lane, {c: (tables[t >> 4], tables[0x10 | t & 15]) for c, t in chosen}))
            at += end
    if not scans:
        raise ValueError("no scan")
    return image, scans


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may follow: length of the code they start with << 8 | its symbol."""
    found = _lookups.get(table)
    if found is None:
        found = np.zeros(1 << 16, np.int32)
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                found[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[table] = found
    return found


def decode(scans: list[_Scan]) -> None:
    """Fills in the coefficients (zigzag order) of the scans' images; all intervals go in step."""
    names: dict[bytes, int] = {}
    offset, total, lanes, first, last, lane_block, targets, dc_of, ac_of, pred_of = 0, 0, [], [], [], [], [], [], [], []
    pieces = []
    for s in scans:
        cids = sorted(s.tables)
        dc = {c: names.setdefault(s.tables[c][0], len(names)) for c in cids}
        ac = {c: names.setdefault(s.tables[c][1], len(names)) for c in cids}
        dc_of.append(np.array([dc[c] for c in cids])[np.searchsorted(cids, s.where)])
        ac_of.append(np.array([ac[c] for c in cids])[np.searchsorted(cids, s.where)])
        pred_of.append(np.searchsorted(cids, s.where))
        lanes.append((s.lanes + offset) * 8)
        first.append(np.arange(0, len(s.where), s.per_lane) + total)
        last.append(np.minimum(np.arange(0, len(s.where), s.per_lane) + s.per_lane, len(s.where)) + total)
        pieces.append(s.data)
        offset, total = offset + len(s.data), total + len(s.where)
    data = np.concatenate([*pieces, np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    tables = np.concatenate([_lookup(t) for t in names])
    dc_of, ac_of, pred_of = (np.concatenate(x) for x in (dc_of, ac_of, pred_of))
    pos, block, end = (np.concatenate(x).astype(np.int64) for x in (lanes, first, last))
    out = np.zeros(total * 64, np.int16)
    k = np.zeros(len(pos), np.int64)
    pred = np.zeros((len(pos), int(pred_of.max()) + 1), np.int64)
    top = len(window) - 1
    while len(pos):
        is_dc = k == 0
        table = np.where(is_dc, dc_of[block], ac_of[block])
        bits = (window[np.minimum(pos >> 3, top)] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        entry = tables[(table << 16) + bits]
        if not entry.all():
            raise ValueError("no such code")
        symbol = entry & 255
        pos = pos + (entry >> 8)
        size = np.where(is_dc, symbol, symbol & 15)
        extra = (window[np.minimum(pos >> 3, top)] >> (32 - size - (pos & 7)).clip(0, 31).astype(np.uint32)) & ((1 << size) - 1)
        value = np.where(extra >= (1 << size) >> 1, extra, extra - (1 << size) + 1) * (size > 0)
        pos += size
        if is_dc.any():
            rows = np.flatnonzero(is_dc)
            c = pred_of[block[rows]]
            pred[rows, c] += value[rows]
            value[rows] = pred[rows, c]
        k = k + np.where(is_dc, 0, symbol >> 4)
        over = ~is_dc & (symbol == 0)
        at = np.flatnonzero((k < 64) & ~over & (is_dc | (size > 0)))
        out[block[at] * 64 + k[at]] = value[at]
        k += 1
        done = over | (k > 63)
        if done.any():
            k[done] = 0
            block = block + done
            alive = block < end
            if not alive.all():
                pos, block, end, k, pred = pos[alive], block[alive], end[alive], k[alive], pred[alive]
    out, at = out.reshape(-1, 64), 0
    for s in scans:
        part = out[at : at + len(s.where)]
        for c in s.tables:
            mine = s.where == c
            s.image.coefficients[c][s.blocks[mine]] = part[mine]
        at += len(s.where)


def thumbnail(image: Image) -> np.ndarray:
    """The luminance of each 8x8 block from its DC coefficient alone, 0 to 255."""
    cid, h, v, q = image.parts[0]
    most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    rows, cols = -(-(-(-image.height * v // most_v)) // 8), -(-(-(-image.width * h // most_h)) // 8)
    dc = image.coefficients[cid][:, 0].reshape(image.grid[cid])[:rows, :cols].astype(np.int64)
    return np.clip((dc * int(image.quant[q][0]) + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 reduction are above its mean."""
    y, x = (np.arange(8) * n // 8 for n in thumb.shape)
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), y, 0), x, 1) if min(thumb.shape) >= 8 else thumb[np.ix_(y, x)].astype(np.int64)
    return np.packbits(cells * 64 > cells.sum()).tobytes().hex()


def payload(image: Image) -> bytes:
    """What encode() stored."""
    n = int(next(c for c in image.comments if c.startswith(b"payload "))[8:])
    v = image.coefficients[image.parts[0][0]].ravel()[:n]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


# columns -------------------------------------------------------------------------------------


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in in_slices(offsets, 2 << 20):
            media = encode([pad(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(i, j)])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


#: What a damaged image may raise while it is parsed or decoded.
_DAMAGE = (ValueError, IndexError, KeyError, StopIteration, struct.error, ZeroDivisionError)


def _read(media: list[bytes | None]) -> list[Image | str]:
    """The decoded images, or what is wrong with them. All are decoded in step; only if one fails, one by one."""
    out: list[Image | str] = []
    parsed: list[tuple[int, list[_Scan]]] = []
    for k, m in enumerate(media):
        try:
            if m is None:
                raise ValueError("null")
            image, scans = parse(m)
            out.append(image)
            parsed.append((k, scans))
        except _DAMAGE as e:
            out.append(f"{type(e).__name__}: {e}")
    try:
        decode([s for _, scans in parsed for s in scans])
    except _DAMAGE:
        for k, _ in parsed:
            try:
                out[k], scans = parse(media[k])
                decode(scans)
            except _DAMAGE as e:
                out[k] = f"{type(e).__name__}: {e}"
    return out


def _feature_row(m: bytes | None, image: Image | str) -> tuple:
    sha = hashlib.sha256(m).hexdigest() if m is not None else None
    if not isinstance(image, str):
        try:
            p, t = payload(image), thumbnail(image)
            return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), sha, f"{image.width}x{image.height}:{hashlib.sha256(t.tobytes()).hexdigest()[:16]}:{average_hash(t)}", None
        except _DAMAGE as e:
            image = f"{type(e).__name__}: {e}"
    return None, None, None, len(m) if m is not None else None, sha, None, image


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]
    for b in batches:
        at = np.concatenate(([0], np.cumsum([len(m.as_buffer()) if m.is_valid else 0 for m in b.column(2)])))
        for i, j in in_slices(at, 2 << 20):
            media = b.column(2).slice(i, j - i).to_pylist()
            rows = [_feature_row(m, image) for m, image in zip(media, _read(media), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *[pa.array(list(c), k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", *[n for n, _ in kinds]])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text, padded, as a baseline JPEG. Null texts count as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hashes and the payload's digests, all from the stored bytes.

    Equal texts give equal rows but for the id; an empty table gives an empty result. A null or damaged
    image, or one without a payload, keeps its row, with nulls and what is wrong in `error`.
    """
    return media.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
