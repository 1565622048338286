"""Crops of uploaded images, and pictures of the grid that is seen in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as V
from ..operators import index as I
from ..operators import raster as R
from ..operators.finders import SIDE, finder_grids, rectified_grid
from .fine import HIGH, square_padded

_CROP, _IMAGE = ("x", "y", "w", "h"), ("width", "height", "pixels")
#: Fixed value: darker pixels of a preview are black.
BLACK = 145


def cropped(images: DataFrame) -> DataFrame:
    """Images (width, height, gray pixels, any other columns) cut to their crop x, y, w, h; a null crop keeps them whole.

    Crops are rounded and clamped to the image, 8 pixels or more. An image whose crop then still
    reaches over its edge, or that is no raster, has no pixels.
    """
    others = [c for c in images.columns if c not in (*_CROP, *_IMAGE)]
    box = I.clamped_crop(*(F.col(c).cast("double") for c in _CROP), F.col("width"), F.col("height"))
    whole = [F.lit(0), F.lit(0), F.col("width"), F.col("height")]
    none = F.greatest(*[F.col(c).isNull().cast("int") for c in _CROP]) == 1
    rows = images.select(*others, *[F.col(c) for c in _IMAGE], *[F.when(none, a).otherwise(b).cast("int").alias(f"_{k}") for k, (a, b) in enumerate(zip(whole, box, strict=True))])

    def cut(width: int | None, height: int | None, pixels: bytes | None, left: int, top: int, w: int, h: int) -> tuple:
        if not pixels or not width or not height or len(pixels) != width * height or left + w > width or top + h > height:
            return None, None, None
        return w, h, np.frombuffer(pixels, np.uint8).reshape(height, width)[top : top + h, left : left + w].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(others)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                s = b.slice(i, 64)
                made = [cut(*(c[k].as_py() for c in s.columns[n:])) for k in range(s.num_rows)]
                yield pa.RecordBatch.from_arrays([*s.columns[:n], *[pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]], [*others, *_IMAGE])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", width int, height int, pixels binary")


def preview_grid(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Cells and mask (25 x 25) of an image padded to a square, and whether finders were used."""
    bits = V.binarized(R.stretched(R.resized(square_padded(gray), HIGH))[None], BLACK)[0]
    cells, mask = rectified_grid(bits)
    return cells, mask, any(np.array_equal(cells, c) and np.array_equal(mask, m) for c, m in finder_grids(bits))


def target_previews(images: DataFrame) -> DataFrame:
    """record_no, by (`finders`, `area`, null without a raster), black, svg: each image's grid as a picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                rows = []
                for number, width, raw in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    if not raw or not width or width < 0 or len(raw) % width:
                        rows.append((number, None, None, None, None))
                        continue
                    cells, mask, found = preview_grid(np.frombuffer(raw, np.uint8).reshape(-1, width))
                    rows.append((number, "finders" if found else "area", int(cells.sum()), cells.ravel().tolist(), mask.ravel().tolist()))
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_no", "by", "black", "cells", "mask"])

    grids = images.select(F.col("record_no").cast("long"), F.col("width").cast("int"), "pixels").mapInArrow(run, "record_no long, by string, black int, cells array<int>, mask array<int>")
    return grids.select("record_no", "by", "black", R.svg(F.col("cells"), F.col("mask"), SIDE).alias("svg"))
