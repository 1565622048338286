"""Where codes are on a page, from the numbers under them or from pixels, and the grids in them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.bits import CELLS, SIDE, WORDS
from ..sources.records import to_words
from ..sources.tables import short_batches, written
from .components import measured, runs
from .raster import GALLERY, sample

#: Distance within which positions are one row or column, in page pixels.
TOLERANCE = 60.0
BOX = "index int, text string, left int, top int, width int, height int"
#: Crops of one task when pages are cut up.
CROPS = 500


def centres(values: np.ndarray, tolerance: float = TOLERANCE) -> list[float]:
    """Ascending cluster centres: a value joins the last cluster if near its running mean."""
    out: list[list[float]] = []  # sum, count
    for v in np.sort(values):
        if out and abs(out[-1][0] / out[-1][1] - v) <= tolerance:
            out[-1][0] += v
            out[-1][1] += 1
        else:
            out.append([v, 1])
    return [s / n for s, n in out]


def upper_median(values: list[float], fallback: float) -> float:
    some = sorted(v for v in values if np.isfinite(v) and v > 0)
    return some[len(some) // 2] if some else fallback


def spacings(values: np.ndarray, first: np.ndarray, size: float, least: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """How far the cluster centres of each page's values are apart: their upper median, or size by their number, `least` or more.

    first: where each page's values begin. Pages advance together, a value at a time, as centres() does for one.
    """
    many = np.diff(np.append(first, len(values)))
    v = values[np.lexsort((values, np.repeat(np.arange(len(first)), many)))]
    by = np.argsort(-many, kind="stable")  # those that go on longest come first
    total, n, clusters, last = np.zeros(len(by)), np.zeros(len(by)), np.zeros(len(by), np.int64), np.full(len(by), np.nan)
    pages, gaps = [], []

    def closed(at: np.ndarray) -> None:
        centre = total[at] / n[at]
        gap = centre - last[at]
        some = np.isfinite(gap) & (gap > 0)
        pages.append(by[at[some]])
        gaps.append(gap[some])
        last[at] = centre

    for k in range(int(many.max(initial=0))):
        going = int(np.searchsorted(-many[by], -k))
        x = v[first[by[:going]] + k]
        if k:
            new = ~(np.abs(total[:going] / n[:going] - x) <= tolerance)
            closed(np.flatnonzero(new))
        else:
            new = np.ones(going, bool)
        total[:going], n[:going] = np.where(new, x, total[:going] + x), np.where(new, 1, n[:going] + 1)
        clusters[:going] += new
    closed(np.arange(len(by)))
    out = np.empty(len(by))
    out[by] = size / np.maximum(clusters, least)
    page, gap = np.concatenate(pages), np.concatenate(gaps)
    order = np.lexsort((gap, page))
    some, at, count = np.unique(page[order], return_index=True, return_counts=True)
    out[some] = gap[order][at + count // 2]
    return out


def crops_from_text(items: DataFrame, page_width: float = 900, page_height: float = 1200) -> DataFrame:
    """Crops of every page; items: page_id, str, x, y, width, height. Only numbers of 6 digits count.

    Boxes stand above the numbers and are numbered down the page, before those under 32 pixels go.
    A page_id may be of any type; pages are taken to have few items. Items travel once; all pages of a
    batch are worked on together.
    """
    numbers = items.where(F.col("page_id").isNotNull()).select("page_id", F.trim("str").alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    numbers = numbers.where(F.col("text").rlike("^[0-9]{6,}$") & (F.col("width") > 10)).withColumn("middle", F.col("x") + F.col("width") / 2)
    ordered = numbers.withColumn("index", F.row_number().over(W.partitionBy("page_id").orderBy("y", "x", "text", "width", "height")))
    columns = ["page_id", "index", "text", "y", "width", "height", "middle"]

    def apart(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole pages with their spacings."""
        t = pa.Table.from_batches(rows)
        if not t.num_rows:
            return
        first = np.flatnonzero(t.column("index").to_numpy() == 1)
        each = np.diff(np.append(first, t.num_rows))
        for name, c, size, least in (("across", "middle", page_width, 4), ("down", "y", page_height, 3)):
            t = t.append_column(name, pa.array(np.repeat(spacings(t.column(c).to_numpy(), first, size, least), each)))
        yield from t.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # from the start of a page on
        for b in batches:
            starts = np.flatnonzero(b.column(1).to_numpy() == 1)
            if len(starts):
                yield from apart([*held, b.slice(0, starts[-1])])
                held, b = [], b.slice(starts[-1])
            held.append(b)
        if held:
            yield from apart(held)

    # a window's rows come page by page, in its order
    d = ordered.select(columns).mapInArrow(run, f"page_id {dict(items.dtypes)['page_id']}, index int, text string, y double, width double, height double, middle double, across double, down double")
    near = lambda c: F.floor(c + 0.5).cast("int")
    size = F.greatest(F.lit(48.0), F.least(F.col("width") * 0.58, F.col("across") * 0.42, F.col("down") * 0.68))
    d = d.withColumn("size", size)
    d = d.withColumn("left", near(F.greatest(F.lit(0.0), F.col("middle") - F.col("size") / 2)))
    d = d.withColumn("top", near(F.greatest(F.lit(0.0), F.col("y") - F.greatest(F.lit(6.0), F.col("height") * 0.35) - F.col("size"))))
    d = d.select("page_id", "index", "text", "left", "top", near(F.least("size", page_width - F.col("left"))).alias("width"), near(F.least("size", page_height - F.col("top"))).alias("height"))
    return d.where("width >= 32 and height >= 32")


def dilated(bits: np.ndarray, radius: int) -> np.ndarray:
    """Set where a pixel of the square of that radius is set."""
    bits = bits != 0
    for axis in (0, 1):
        near, by_axis = bits.copy(), np.moveaxis(bits, axis, 0)
        out = np.moveaxis(near, axis, 0)  # a view
        for k in range(1, min(radius, len(by_axis) - 1) + 1):
            out[k:] |= by_axis[:-k]
            out[:-k] |= by_axis[k:]
        bits = near
    return bits


def pixel_boxes(gray: np.ndarray) -> np.ndarray:
    """left, top, width and height of what looks like a code on a page, in reading order.

    Rows are told apart by 20 pixels from their first box down.
    """
    high, wide = gray.shape
    black = gray < 105
    radius = max(2, int(wide / 450 + 0.5))
    grown = dilated(black, radius)
    rows, starts, ends, number, many = runs(grown)
    r = measured(rows, starts, ends, number, many)
    first = np.cumsum(ends - starts) - (ends - starts)  # of each run's pixels among all set ones
    ink = np.bincount(number, np.add.reduceat(black[grown], first, dtype=np.int64) if many else None, many)
    box = [r[c].astype(int) for c in ("left", "top", "width", "height")]
    within = lambda v: (v >= max(42, wide * 0.045)) & (v <= max(90, wide * 0.19))
    fits = within(box[2]) & within(box[3]) & (r["ratio"] >= 0.74) & (r["ratio"] <= 1.26) & (ink >= 0.06 * r["area"])
    left, top, w, h = (b[fits] for b in box)
    side = np.maximum(w, h) + radius * 3
    x, y = (np.maximum(0, np.floor(a + (b - 1) / 2 - side / 2 + 0.5).astype(int)) for a, b in ((left, w), (top, h)))
    boxes = np.stack([x, y, np.minimum(side, wide - x), np.minimum(side, high - y)], 1)
    return boxes[_reading_order(x, y)]


def _reading_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    row, start = np.zeros(len(y), int), None
    for k in np.lexsort((x, y)):
        if start is None or y[k] - start[0] > 20:
            start = (y[k], 0 if start is None else start[1] + 1)
        row[k] = start[1]
    return np.lexsort((y, x, row))


def page_raster(pixels: bytes | None, width: int | None) -> np.ndarray | None:
    """Gray pixels as rows; None if they are null, empty or no whole number of rows."""
    whole = pixels and width and width > 0 and len(pixels) % width == 0
    return np.frombuffer(pixels, np.uint8).reshape(-1, width) if whole else None


def whole_squares(gray: np.ndarray, boxes: list[tuple[int, int, int, int]], black: float, side: int = SIDE) -> list[tuple[float, float, float] | None]:
    """left, top and side of codes whose outermost lines are white, by the others on the page; None for all others.

    The dark pixels of such a code are narrower (or lower) than a square, and don't tell on which side
    a line is missing. Codes in the same column that are whole and as large do, if they all agree;
    likewise those in the same row of codes that are too low.
    """
    out: list[tuple[float, float, float] | None] = [None] * len(boxes)
    if len(boxes) < 2:
        return out
    dark, box = gray <= black, np.zeros((len(boxes), 2, 2))  # across and down, first pixel and end
    for k, (left, top, width, height) in enumerate(boxes):
        part = dark[max(0, top) : top + height, max(0, left) : left + width]
        for axis, start in ((0, max(0, left)), (1, max(0, top))):
            at = np.flatnonzero(part.any(axis))
            box[k, axis] = (start + at[0], start + at[-1] + 1) if len(at) else np.nan
    length = box[:, :, 1] - box[:, :, 0]
    most = length.max(1)
    cell = most / side
    whole = most - length.min(1) <= cell / 2
    for k in np.flatnonzero(most - length.min(1) > cell / 2):
        axis, near = int(length[k].argmin()), cell[k] / 4
        first, end = box[:, axis].T
        like = whole & (np.abs(most - most[k]) <= near) & (first <= first[k] + near) & (end >= end[k] - near)
        if like.any() and np.ptp(first[like]) <= near:
            corner = box[k, :, 0].copy()
            corner[axis] = np.median(first[like])
            out[k] = (*corner.tolist(), float(most[k]))
    return out


def crops_from_pixels(pages: DataFrame) -> DataFrame:
    """Crops of page rasters (page_id, page_width, pixels: gray bytes, row by row); text is null.

    A page whose bytes are null, empty or no whole number of rows has no crops.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                gray = page_raster(b.column(2)[i].as_py(), b.column(1)[i].as_py())
                boxes = pixel_boxes(gray) if gray is not None else []
                if len(boxes):
                    n = len(boxes)
                    page = b.column(0).take(pa.array([i] * n))
                    yield pa.RecordBatch.from_arrays([page, pa.array(range(1, n + 1), pa.int32()), pa.nulls(n, pa.string()), *[pa.array(boxes[:, k].astype(np.int32)) for k in range(4)]], names)

    names = ["page_id", *[c.split()[0] for c in BOX.split(", ")]]
    short_batches(pages.sparkSession)
    return pages.select("page_id", F.col("page_width").cast("int"), "pixels").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, {BOX}")


def chosen_crops(from_text: DataFrame, from_pixels: DataFrame) -> DataFrame:
    """Crops from text where a page has any, else those from pixels."""
    return from_text.unionByName(from_pixels.join(from_text.select("page_id").distinct(), "page_id", "left_anti"))


def crop_grids(pages: DataFrame, crops: DataFrame | None = None, preset: dict | None = None) -> DataFrame:
    """The grid in every crop of page rasters: page_id, index, text, status, error, known, words (w0 ...) and mask (m0 ...).

    pages: page_id, page_width, pixels; crops: page_id and the columns of BOX. A page without crops
    is looked through for codes by its pixels. Each raster travels once, unsorted, to the task that cuts it up;
    tasks are as many as crops ask for. status is `indexed` or `failed`; besides, each page has a row
    without an index, `page` or, if it has no raster, `failed`, and its crops then have none. A crop
    that doesn't lie within its page fails. Crops of unknown pages are failures of those. A code with
    a white line at its edge gets its square from the page's others, see whole_squares().
    """
    preset = GALLERY if preset is None else preset
    short_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    words = [f"{p}{k}" for p in "wm" for k in range(WORDS)]
    boxes = F.sort_array(F.collect_list(F.struct("index", "text", "left", "top", "width", "height")))
    rasters = pages.select("page_id", F.col("page_width").cast("int").alias("page_width"), "pixels")
    if crops is None:
        joined = rasters.withColumn("boxes", F.lit(None).cast(f"array<struct<{BOX.replace(' ', ':')}>>".replace(",:", ",")))
    else:
        given = written(crops.select("page_id", *[F.col(c.split()[0]).cast(c.split()[1]) for c in BOX.split(", ")]), "crops")
        n = max(1, -(-given.count() // CROPS))
        lists = given.repartition(n, "page_id").groupBy("page_id").agg(boxes.alias("boxes"))  # of one page each
        joined = rasters.repartition(n, "page_id").join(lists.hint("shuffle_hash"), "page_id", "full").select("page_id", "page_width", "pixels", "boxes")

    def cut(gray: np.ndarray, box: tuple[int, int, int, int], whole: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray] | None:
        left, top, width, height = box
        if min(left, top) < 0 or min(width, height) < 1 or left + width > gray.shape[1] or top + height > gray.shape[0]:
            return None
        square = (whole[0] - left, whole[1] - top, whole[2]) if whole and width == height else None
        return sample(gray[top : top + height, left : left + width], SIDE, **preset, square=square)

    def one(page: pa.Array, wide: int | None, pixels: bytes | None, given: list[dict] | None) -> pa.RecordBatch:
        gray = page_raster(pixels, wide)
        if gray is None:
            rows, grids = [(None, None, "failed", "no raster")], [None]
        else:
            at = [(c["index"], c["text"], (c["left"], c["top"], c["width"], c["height"])) for c in given] if given else [(k, None, tuple(b)) for k, b in enumerate(pixel_boxes(gray).tolist(), 1)]
            boxes = [box for *_, box in at]
            grids = [None, *map(cut, repeat(gray), boxes, whole_squares(gray, boxes, preset["black"]))]
            rows = [(None, None, "page", None), *[(k, t, *(("failed", "outside the page") if g is None else ("indexed", None))) for (k, t, _), g in zip(at, grids[1:], strict=True)]]
        flat, lost = np.zeros((2, len(rows), 448), np.uint8), np.array([g is None for g in grids])
        for k, g in enumerate(grids):
            if g is not None:
                flat[0, k, :CELLS], flat[1, k, :CELLS] = g[0].ravel(), g[1].ravel()
        known = pa.array(flat[1].sum(1, dtype=np.int32), mask=lost)
        both = [to_words(np.packbits(v, 1, "little")) for v in flat]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([page.take(pa.array([0] * len(rows))), *columns, known, *[pa.array(np.ascontiguousarray(v[:, k]), mask=lost) for v in both for k in range(WORDS)]], names)

    names = ["page_id", "index", "text", "status", "error", "known", *words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield one(b.column(0).slice(i, 1), *(b.column(k)[i].as_py() for k in (1, 2, 3)))

    return joined.mapInArrow(run, f"page_id {kind}, index int, text string, status string, error string, known int, " + ", ".join(f"{w} long" for w in words))
