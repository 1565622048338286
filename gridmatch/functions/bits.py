"""Grids of black and white cells as 63-bit words, and expressions over them.

A 21 x 21 grid is cut, row by row and least significant bit first, into seven words of three rows:
cell (x, y) is bit (y % 3) * 21 + x of word y // 3. Words are never negative, so no shift meets the
sign bit. A grid of side g keeps 63 // g rows in a word. All of this compiles to Java arithmetic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 21
CELLS = SIDE * SIDE
WORD_BITS = 63
FULL = (1 << WORD_BITS) - 1
WORDS = CELLS // WORD_BITS
ROWS = WORD_BITS // SIDE


def rows_per_word(side: int) -> int:
    return WORD_BITS // side


def words_of(side: int) -> int:
    return -(-side // rows_per_word(side))


def place(x: int, y: int, side: int = SIDE) -> tuple[int, int]:
    """Word and bit of a cell."""
    r = rows_per_word(side)
    return y // r, (y % r) * side + x


def mask_of(cells: list[tuple[int, int]], side: int = SIDE) -> list[int]:
    """The words with these cells set."""
    out = [0] * words_of(side)
    for x, y in cells:
        k, b = place(x, y, side)
        out[k] |= 1 << b
    return out


def in_finder_zone(x: float, y: float) -> bool:
    """Whether a position (0 to 1 across and down) lies in one of the three finder corners."""
    return (x < 0.31 and (y < 0.31 or y > 0.69)) or (x > 0.69 and y < 0.31)


def finder_mask(side: int = SIDE, turns: int = 0) -> list[int]:
    """The words of the finder corners, turned with the grid they belong to."""
    zone = [(x, y) for y in range(side) for x in range(side) if in_finder_zone(x / (side - 1), y / (side - 1))]
    return mask_of([turned_place(x, y, turns, side) for x, y in zone], side)


_FIRST_COLUMN = sum(1 << (r * SIDE) for r in range(ROWS))
_LAST_COLUMN = sum(1 << (r * SIDE + SIDE - 1) for r in range(ROWS))
_TOP, _BOTTOM = (1 << SIDE) - 1, ((1 << SIDE) - 1) << (SIDE * (ROWS - 1))


def cols(prefix: str, n: int = WORDS) -> list[str]:
    """The names of a grid's word columns."""
    return [f"{prefix}{k}" for k in range(n)]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _and(a: Column, b) -> Column:
    return _col(a).bitwiseAND(F.lit(b) if isinstance(b, int) else _col(b))


def popcount(words: list[Column]) -> Column:
    return total([F.bit_count(_col(w)).cast("bigint") for w in words])


def both(a: list[Column], b: list) -> list[Column]:
    return [_and(x, y) for x, y in zip(a, b, strict=True)]


def differ(a: list[Column], b: list[Column]) -> list[Column]:
    return [_col(x).bitwiseXOR(_col(y)) for x, y in zip(a, b, strict=True)]


def inverse(a: list[Column]) -> list[Column]:
    return [_col(x).bitwiseXOR(F.lit(FULL)) for x in a]


def neighbours(a: list[Column]) -> list[Column]:
    """The cells that have a set cell left, right, above or below them."""
    out, a = [], [_col(w) for w in a]
    for k, w in enumerate(a):
        right = F.shiftleft(_and(w, FULL & ~_LAST_COLUMN), 1)
        left = F.shiftright(_and(w, FULL & ~_FIRST_COLUMN), 1)
        below = F.shiftleft(_and(w, FULL & ~_BOTTOM), SIDE)
        above = F.shiftright(w, SIDE)
        near = right.bitwiseOR(left).bitwiseOR(below).bitwiseOR(above)
        if k:  # the last row of the word before is above the first of this one
            near = near.bitwiseOR(F.shiftright(a[k - 1], SIDE * (ROWS - 1)))
        if k + 1 < len(a):
            near = near.bitwiseOR(F.shiftleft(_and(a[k + 1], _TOP), SIDE * (ROWS - 1)))
        out.append(near)
    return out


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent with two decimals, half up; 0 if whole is 0."""
    ratio = part.cast("double") / whole.cast("double")
    return F.when(whole > 0, F.floor(ratio * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(100.0)).otherwise(F.lit(0.0))


def mismatches(t: list[Column], m: list[Column], c: list[Column]) -> Column:
    return popcount(both(differ(t, c), m))


def supported(t: list[Column], m: list[Column], c: list[Column]) -> Column:
    """Mismatches that a direct neighbour in the candidate makes up for."""
    wrong = both(differ(t, c), m)
    t = [_col(x) for x in t]
    black, white = neighbours(c), neighbours(inverse(c))
    return popcount([_and(w, _and(x, b).bitwiseOR(_and(x.bitwiseXOR(F.lit(FULL)), v))) for w, x, b, v in zip(wrong, t, black, white, strict=True)])


def cells(words: list[Column], side: int = SIDE) -> Column:
    """All cells, row by row, as an array of 0 and 1."""
    r = rows_per_word(side)
    per = r * side
    parts = []
    for k, w in enumerate(words):
        n = min(per, side * side - k * per)
        parts.append(_bits(_col(w), n))
    return F.concat(*parts)


def _bits(word: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(word, i).cast("int"))


def pack(values: Column, side: int = SIDE) -> list[Column]:
    """Words of an array of cells: any non-zero is 1, missing ones are 0, further ones are ignored."""
    r = rows_per_word(side)
    per, out = r * side, []
    for k in range(words_of(side)):
        n = min(per, side * side - k * per)
        out.append(_pack_word(F.slice(values, k * per + 1, n)))
    return out


def _push(acc: Column, v: Column) -> Column:
    return F.shiftleft(acc, 1).bitwiseOR(F.when(F.coalesce(v, F.lit(0)) != 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def _pack_word(part: Column) -> Column:
    return F.aggregate(F.reverse(part), F.lit(0).cast("bigint"), _push)


def turned_place(x: int, y: int, turns: int, side: int = SIDE) -> tuple[int, int]:
    """Where a cell goes: one clockwise turn moves (x, y) to (side - 1 - y, x)."""
    for _ in range(turns % 4):
        x, y = side - 1 - y, x
    return x, y


def rotated(words: list, turns: int, side: int = SIDE) -> list[Column]:
    """The grid turned clockwise: its cells, ordered by where they go, packed again."""
    if not turns % 4:
        return [_col(w) for w in words]
    to = [turned_place(x, y, turns, side) for y in range(side) for x in range(side)]
    goes = F.array(*[F.lit(y * side + x) for x, y in to])
    moved = F.array_sort(F.zip_with(goes, cells(words, side), lambda i, v: F.struct(i.alias("i"), v.alias("v"))))
    return pack(F.transform(moved, lambda p: p["v"]), side)


def row_bits(words: list[Column]) -> list[Column]:
    """Each row as a number of 21 bits."""
    return [_and(F.shiftright(_col(w), r * SIDE), _TOP) for w in words for r in range(ROWS)]


def looks_square(words: list[Column]) -> Column:
    """Whether the box around the black cells has sides of 0.68 of the grid and 0.7 to 1.45 : 1."""
    rows = row_bits(words)
    any_row = F.array(*[r != 0 for r in rows])
    top, bottom = F.array_position(any_row, True), SIDE + 1 - F.array_position(F.reverse(any_row), True)
    across = reduce(lambda a, b: a.bitwiseOR(b), rows)
    height = (bottom - top + 1).cast("double")
    spread = F.length(F.trim(F.translate(F.lpad(F.bin(across), SIDE, "0"), "0", " ")))
    width = spread.cast("double")
    fine = (width >= 0.68 * SIDE) & (height >= 0.68 * SIDE) & (width / height >= 0.7) & (width / height <= 1.45)
    return F.when(across == 0, F.lit(False)).otherwise(fine)
