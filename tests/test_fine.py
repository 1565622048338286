"""Finders, sampled grids, crops from pixels and the fine search against slow versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmatch.functions.bits import in_finder_zone
from gridmatch.jobs import fine as FS
from gridmatch.jobs import preview as PV
from gridmatch.operators import crops as C
from gridmatch.operators import features as V
from gridmatch.operators import finders as D
from gridmatch.operators import raster as R
from gridmatch.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def code(seed=1, side=25):
    """Cells with three corner squares, ringed by white, and noise elsewhere."""
    cells = (np.random.default_rng(seed).random((side, side)) < 0.5).astype(np.uint8)
    square = np.pad(np.ones((3, 3), np.uint8), 1)
    square = np.pad(square, 1, constant_values=1)
    for y, x in ((0, 0), (0, side - 7), (side - 7, 0)):
        cells[max(0, y - 1) : y + 8, max(0, x - 1) : x + 8] = 0
        cells[y : y + 7, x : x + 7] = square
    return cells


def image(cells, scale=10):
    return np.pad(np.kron(cells, np.ones((scale, scale), np.uint8)), 5)


def slow_score(t, m, c, black_weight, white_weight):
    n, best = len(t), 0.0
    for turns in range(4):
        v, sums = c, {"b": 0.0, "w": 0.0, "bh": 0.0, "wh": 0.0}
        for _ in range(turns):
            v = [[v[n - 1 - x][y] for x in range(n)] for y in range(n)]
        for y in range(n):
            for x in range(n):
                if m[y][x]:
                    kind = "b" if t[y][x] else "w"
                    weight = 0.08 if in_finder_zone(x / (n - 1), y / (n - 1)) else 1
                    sums[kind] += weight
                    sums[kind + "h"] += weight * (v[y][x] == t[y][x])
        if sums["b"] >= 10:
            best = max(best, sums["bh"] / sums["b"] * black_weight + (sums["wh"] / sums["w"] if sums["w"] else 0) * white_weight)
    return best * 100


@pytest.mark.parametrize("turns", range(4))
def test_finders_in_each_rotation(turns):
    cells = np.rot90(code(), turns)
    centres = D.finder_centres(image(cells))
    at = [(3.5, 3.5), (21.5, 3.5), (3.5, 21.5), (21.5, 21.5)]
    found = {tuple(p) for p in ((centres - 4.5) / 10).round(1).tolist()}
    missing = [p for p in at if p not in found]
    assert len(found) == 3 and missing == [[(21.5, 21.5)], [(21.5, 3.5)], [(3.5, 3.5)], [(3.5, 21.5)]][[0, 1, 2, 3].index(turns)]
    grids = D.finder_grids(image(cells), variants=True)
    assert len(grids) == 6 and any((g == code()).all() for g, _ in grids)


def test_upright_finders_give_the_cells_back():
    (cells, mask), = D.finder_grids(image(code()))
    assert (cells == code()).all() and mask.all()
    got, known = D.rectified_grid(image(code()))
    assert (got == code()).all() and known.all()


def test_no_finders():
    bits = np.zeros((260, 260), np.uint8)
    assert D.finder_centres(bits) is None and D.finder_grids(bits, True) == []
    square = image(code())[5:75, 5:75]
    bits[10:80, 10:80] = bits[10:80, 150:220] = square
    assert D.finder_centres(bits) is None
    assert D.rectified_grid(np.ones((260, 260), np.uint8))[0].all()


def test_collinear_finders_fall_back_to_the_largest():
    bits = np.zeros((260, 260), np.uint8)
    for x in (10, 95, 180):
        bits[100:170, x : x + 70] = image(code())[5:75, 5:75]
    assert D.finder_centres(bits).tolist() == [[x + 34.5, 134.5] for x in (10, 95, 180)]
    assert D.upright(np.array([[5.0, 5.0], [5.0, 5.0], [9.0, 5.0]])) is None


@pytest.mark.parametrize("pad", [0, 0.5, 1])
@pytest.mark.parametrize("n", [21, 33])
def test_sampling_one_by_one(n, pad):
    rng = np.random.default_rng(n)
    bits, mask = np.zeros((64, 64), np.uint8), (rng.random((64, 64)) < 0.6).astype(np.uint8)
    bits[4:60, 7:58] = rng.random((56, 51)) < 0.5
    bits[4, 7] = bits[59, 57] = 1
    got = D.grid_by_sampling(bits, mask, n, pad)
    cell = 56 / (n - 1)
    step = cell * (n + pad * 2) / n
    left, top = (s / 2 - cell * (n - 1) / 2 - cell * pad for s in (7 + 57, 4 + 59))
    for gy in range(n):
        for gx in range(n):
            cx, cy = int(np.floor(left + (gx + 0.5) * step + 0.5)), int(np.floor(top + (gy + 0.5) * step + 0.5))
            near = [(y, x) for y in range(cy - 1, cy + 2) for x in range(cx - 1, cx + 2) if 0 <= y < 64 and 0 <= x < 64]
            for plane, grid in zip((bits, mask), got, strict=True):
                assert grid[gy, gx] == (sum(plane[p] for p in near) / max(len(near), 1) >= 0.45)


@pytest.mark.parametrize("n", [21, 25, 29, 33])
def test_areas_one_by_one(n):
    bits = (np.random.default_rng(n).random((1, 64, 64)) < 0.5).astype(np.uint8)
    got, step = V.area_shares(bits, n)[0], 64 / n
    for gy in range(n):
        for gx in range(n):
            assert got[gy, gx] == bits[0, int(gy * step) : int((gy + 1) * step), int(gx * step) : int((gx + 1) * step)].mean()


def test_crops_from_pixels():
    page = np.full((700, 900), 255, np.uint8)
    for x, y in ((500, 60), (60, 70), (300, 300)):
        page[y : y + 100, x : x + 100] = 255 * (1 - np.kron(code(x), np.ones((4, 4), np.uint8)))
    page[600:606, 100:800] = 0  # a line
    page[400:420, 700:720] = 0  # too small
    assert C.pixel_boxes(page).tolist() == [[x - 5, y - 5, 110, 110] for x, y in ((60, 70), (500, 60), (300, 300))]
    assert C.pixel_boxes(np.full((50, 50), 255, np.uint8)).tolist() == []


def test_crops_from_pixels_of_pages_that_are_none(spark):
    rows = [(1, 10, None), (2, 10, b""), (3, 7, b"12345"), (4, None, b"12"), (5, 0, b"12")]
    assert C.crops_from_pixels(spark.createDataFrame(rows, "page_id long, page_width int, pixels binary")).count() == 0


def test_text_crops_come_first(spark):
    row = "page_id long, index int, text string, left int, top int, width int, height int"
    text = spark.createDataFrame([(1, 1, "123456", 0, 0, 9, 9)], row)
    pixels = spark.createDataFrame([(1, 1, None, 5, 5, 9, 9), (2, 1, None, 5, 5, 9, 9)], row)
    assert sorted((r["page_id"], r["left"]) for r in C.chosen_crops(text, pixels).collect()) == [(1, 0), (2, 5)]


def test_grid_scores_one_by_one():
    rng = np.random.default_rng(3)
    t, m, c = (rng.random((6, 25, 25)) < p for p in (0.5, 0.7, 0.5))
    t[1] = False  # no black at all
    c[2] = np.rot90(t[2], 1)
    got = FS.grid_scores(t, m, c, 0.92, 0.08)
    assert np.allclose(got, [slow_score(a.tolist(), b.tolist(), d.tolist(), 0.92, 0.08) for a, b, d in zip(t, m, c, strict=True)], atol=0.0051)
    assert got[1] == 0 and got[2] == 100


def test_finder_scores_one_by_one():
    rng = np.random.default_rng(4)
    pack = lambda grids: b"".join(FS._packed(g) for pair in grids for g in pair)
    make = lambda k: [((rng.random((25, 25)) < 0.5).astype(np.uint8), (rng.random((25, 25)) < 0.9).astype(np.uint8)) for _ in range(k)]
    ts, cs = [make(k) for k in (6, 0, 1, 6)], [make(k) for k in (1, 1, 0, 1)]
    cs[3] = [ts[3][4]]
    got = FS.finder_scores([pack(g) for g in ts], [pack(g) for g in cs])
    for k, (a, b) in enumerate(zip(ts, cs, strict=True)):
        s = max((slow_score(t.tolist(), m.tolist(), c.tolist(), 0.92, 0.08) for t, m in a for c, _ in b), default=0.0)
        assert abs(got[k] - (100 - (100 - s) * 0.55 if s >= 85 else s)) < 0.011
    assert got[3] == 100


def test_lists_as_by_columns(spark):
    """Running lists give what the distances as column expressions give, pair by pair."""
    images = R.drawn(X.gallery(spark, SF).where("record_no < 60")).withColumn("width", F.lit(420))
    items = FS.image_features(images).drop("cells", "mask", "finders").cache()
    targets = items.where("record_no % 20 = 0").withColumnRenamed("record_no", "target_id")
    whole = F.struct("blocks", "rows", "cols", "density", "edge")
    pairs = items.select("record_no", whole.alias("c")).crossJoin(targets.select("target_id", whole.alias("t")))
    for damaged, distance in ((False, V.coarse_distance("t", "c")), (True, V.damaged_distance("t", "c", 16))):
        want = {}
        for r in pairs.select("target_id", "record_no", distance.alias("d")).collect():
            want.setdefault(r["target_id"], []).append((round(r["d"], 6), r["record_no"]))
        got = {}
        for r in FS.coarse_list(items, targets, 7, damaged).orderBy("place").collect():
            got.setdefault(r["target_id"], []).append((round(r["distance"], 6), r["record_no"]))
        assert {k: [d for d, _ in v] for k, v in got.items()} == {k: [d for d, _ in sorted(v)[:7]] for k, v in want.items()}
        assert all(set(got[k]) <= set(want[k]) for k in want)
    assert FS.coarse_list(items, targets.where("false"), 7).count() == 0


def test_fine_search_finds_damaged_codes(spark):
    """Turned and blotted codes find their origin first; what is no raster gets an error."""
    images = [(k, 420, bytes(R.draw(code(k, 21)[None], 20, 0)[0].tobytes())) for k in range(12)]
    items = FS.image_features(spark.createDataFrame(images + [(99, 7, b"123")], "record_no long, width int, pixels binary")).cache()
    assert [r["record_no"] for r in items.where("error is not null").collect()] == [99]
    blotted = []
    for k in (2, 5):
        gray = np.rot90(R.draw(code(k, 21)[None], 20, 0)[0], k).copy()
        gray[180:260, 200:300] = 128
        blotted.append((k, 420, gray.tobytes()))
    targets = FS.image_features(spark.createDataFrame(blotted, "record_no long, width int, pixels binary"), target=True).withColumnRenamed("record_no", "target_id")
    best = FS.fine_top(FS.coarse_list(items, targets, 12), items, targets).where("rank = 1").collect()
    assert sorted((r["target_id"], r["record_no"]) for r in best) == [(2, 2), (5, 5)] and min(r["score"] for r in best) > 90


def test_square_padding():
    assert FS.square_padded(np.zeros((3, 8), np.uint8)).shape == (8, 8) and FS.square_padded(np.zeros((8, 3), np.uint8))[:, 2:5].sum() == 0


def test_long_lists_are_a_full_sort(spark):
    """More than half of all items for each target, with ties, by bins and by sorting everything."""
    g = np.random.default_rng(4)
    n, keep = 900, 560
    v = {"blocks": g.integers(0, 256, (n, 16)), "rows": g.integers(0, 256, (n, 8)), "cols": g.integers(0, 256, (n, 8))}
    for k in v:
        v[k][600:] = v[k][:300]  # pairs that tie
    rows = [(i, *(v[k][i].tolist() for k in v), float(i % 7) / 7, 0.5, None if i % 50 else "bad") for i in range(n)]
    items = spark.createDataFrame(rows, "record_no long, blocks array<int>, rows array<int>, cols array<int>, density double, edge double, error string").repartition(4)
    targets = items.where("record_no in (3, 4, 601)").withColumnRenamed("record_no", "target_id")
    vectors = {k: x.astype(float) for k, x in v.items()} | {"density": np.array([r[4] for r in rows]), "edge": np.full(n, 0.5)}
    fine = np.array([r[6] is None for r in rows])
    for damaged, distance in ((True, FS.damaged_distances), (False, FS.coarse_distances)):
        got = {}
        for r in FS.coarse_list(items, targets, keep, damaged).orderBy("target_id", "place").collect():
            got.setdefault(r["target_id"], []).append((r["distance"], r["record_no"]))
        assert set(got) == {3, 4, 601}
        for t, mine in got.items():
            d = np.round(distance({k: x[t] for k, x in vectors.items()}, vectors), 9)
            assert mine == sorted((d[i], i) for i in range(n) if fine[i])[:keep]


def test_previews(spark):
    """A code with finders is seen by them, a wide image too; bars by area; no raster is no preview."""
    upright = np.kron(1 - code(3), np.full((10, 10), 255)).astype(np.uint8)
    wide = np.pad(upright, ((0, 0), (40, 40)), constant_values=255)
    bars = np.tile(np.repeat(np.array([0, 255], np.uint8), 26), (260, 5))
    rows = [(1, 250, upright.tobytes()), (2, 330, wide.tobytes()), (3, 260, bars.tobytes()), (4, 7, b"123"), (5, None, None)]
    got = {r["record_no"]: r for r in PV.target_previews(spark.createDataFrame(rows, "record_no long, width int, pixels binary")).collect()}
    assert [got[k]["by"] for k in range(1, 6)] == ["finders", "finders", "area", None, None] and got[4]["svg"] is None
    assert got[1]["svg"].count("#000") == got[1]["black"] == int(code(3).sum()) and abs(got[2]["black"] - got[1]["black"]) <= 12


def test_crops_as_slices(spark):
    gray = np.arange(40 * 30, dtype=np.int64).reshape(30, 40).astype(np.uint8)
    boxes = [(1, None, None, None, None), (2, 3.4, 2.5, 10.0, 12.0), (3, -5.0, -0.6, 20.0, 9.0), (4, 36.0, 5.0, 9.0, 9.0), (5, 10.0, 10.0, 500.0, 3.0), (6, 1.0, 1.0, None, 2.0)]
    t = spark.createDataFrame([(*b, 40, 30, gray.tobytes(), "k") for b in boxes] + [(7, 0.0, 0.0, 9.0, 9.0, 40, 30, b"short", "k")], "record_no long, x double, y double, w double, h double, width int, height int, pixels binary, note string")
    got = {r["record_no"]: (r["width"], r["height"], r["pixels"] and bytes(r["pixels"])) for r in PV.cropped(t).collect()}
    cut = lambda left, top, w, h: (w, h, gray[top : top + h, left : left + w].tobytes())
    assert got == {1: cut(0, 0, 40, 30), 2: cut(3, 3, 10, 12), 3: cut(0, 0, 20, 9), 4: (None, None, None), 5: cut(10, 10, 30, 8), 6: cut(0, 0, 40, 30), 7: (None, None, None)}
    assert "note" in PV.cropped(t).columns


def test_turned_and_blotted_targets_find_themselves(spark):
    images = R.drawn(X.gallery(spark, SF).where("record_no < 90")).withColumn("width", F.lit(420))
    items = FS.image_features(images).cache()
    asked = R.blotted(images.where("record_no % 15 = 0"), F.floor(F.col("record_no") / 15) % 4)
    targets = FS.image_features(asked, target=True).withColumnRenamed("record_no", "target_id").cache()
    best = FS.fine_top(FS.coarse_list(items, targets), items, targets).where("rank <= 2").collect()
    first = {r["target_id"]: (r["record_no"], r["score"]) for r in best if r["rank"] == 1}
    assert first.keys() == {0, 15, 30, 45, 60, 75} and sum(t == r for t, (r, _) in first.items()) >= 5


def slow_sample(gray, side, black, white, gray_share, margin=0, shift=(0, 0), scale=1.0, expand=0, full=False):
    """Cells and mask pixel by pixel, of a raster that already has the size it is sampled at."""
    size = len(gray)
    dark = [(x, y) for y in range(size) for x in range(size) if gray[y][x] <= black]
    cx = cy = size / 2
    length = max(side, size - 2 * margin) if full else size
    if dark and not full:
        xs, ys = [x for x, _ in dark], [y for _, y in dark]
        cx, cy, length = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, max(max(xs) - min(xs), max(ys) - min(ys)) + 1
    length *= scale
    left, top, cell = cx + shift[0] - length / 2, cy + shift[1] - length / 2, length / side
    values, mask = [[0] * side for _ in range(side)], [[0] * side for _ in range(side)]
    for j in range(side):
        for i in range(side):
            span = lambda start, k: range(max(0, min(size, int(np.floor(start + k * cell + cell / 4)))), max(0, min(size, int(np.ceil(start + (k + 1) * cell - cell / 4)))))
            inside = [gray[y][x] for y in span(top, j) for x in span(left, i)]
            mean = sum(inside) / max(1, len(inside))
            values[j][i], mask[j][i] = int(mean <= black), int(mean <= black or mean >= white)
            if gray_share is not None and sum(black < v < white for v in inside) / max(1, len(inside)) >= gray_share:
                mask[j][i] = 0
    lost = [(i, j) for j in range(side) for i in range(side) if not mask[j][i]]
    for i, j in lost:
        for y in range(max(0, j - expand), min(side, j + expand + 1)):
            for x in range(max(0, i - expand), min(side, i + expand + 1)):
                mask[y][x] = 0
    return np.array(values) * np.array(mask), np.array(mask)


@pytest.mark.parametrize("options", [{}, {"full": True, "margin": 9}, {"shift": (6, -4)}, {"scale": 0.9}, {"expand": 1}, {"shift": (40, 40), "scale": 1.2, "expand": 2}])
@pytest.mark.parametrize("preset", [R.GALLERY, R.TARGET])
def test_samples_pixel_by_pixel(options, preset):
    g = np.random.default_rng(len(options))
    cells = (g.random((13, 13)) < 0.5) * 255
    gray = np.full((260, 260), 255, np.uint8)
    gray[26:247, 20:241] = np.kron(cells, np.ones((17, 17)))
    gray[60:120, 90:150] = 140
    gray[180:186, 60:200] = 120
    want = slow_sample(gray.astype(float).tolist(), 13, preset["black"], preset["white"], preset["gray_share"], **options)
    plain = {k: v for k, v in options.items() if k != "full"} | ({"fit": "full"} if "full" in options else {})
    got = R.sample(gray, 13, **(preset | {"stretch": False}), **plain)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_feature_bundle_part_by_part():
    """cells and mask of an image's features are the grids by area and by sampling, one after the other; blocks and lines are shares."""
    gray = np.pad(np.kron(1 - code(5), np.full((9, 9), 230)).astype(np.uint8) + 20, ((3, 3), (20, 20)), constant_values=250)
    for target in (False, True):
        f, image_ = FS.image_feature(gray, target), FS.square_padded(gray) if target else gray
        low, high = (R.resized(image_, n) for n in (64, 260))
        bits = [(R.stretched(p) < R.stretched(p).mean()).astype(np.uint8) for p in (low, high)]
        masks = []
        for p, b in zip((low, high), bits, strict=True):
            sure = np.abs(p - p.mean()) >= 18
            sure = np.ones_like(sure) if sure.mean() < 0.35 else sure
            masks.append(FS.without_white_damage(b, sure.astype(np.uint8)) if target else np.ones_like(b))
        at = 0
        cells, mask = (np.unpackbits(np.frombuffer(f[k], np.uint8), bitorder="little") for k in ("cells", "mask"))
        for n, pad in FS.GRIDS:
            k = int((n, pad) in FS.FROM_HIGH)
            if pad is None:
                edge = [int(v * (64 / n)) for v in range(n + 1)]
                share = lambda a: np.array([[a[edge[y] : edge[y + 1], edge[x] : edge[x + 1]].mean() for x in range(n)] for y in range(n)])  # noqa: B023, E731
                want = (share(bits[0]) >= 0.5).astype(int), (share(masks[0]) >= 0.45).astype(int)
            else:
                want = D.grid_by_sampling(bits[k], masks[k], n, pad)
            for mine, w in zip((cells, mask), want, strict=True):
                assert (mine[at : at + n * n].reshape(n, n) == w).all(), (n, pad, target)
            at += n * n
        assert f["blocks"].tolist() == [int(np.floor(bits[0][y : y + 4, x : x + 4].mean() * 255 + 0.5)) for y in range(0, 64, 4) for x in range(0, 64, 4)]
        assert f["rows"].tolist() == [int(np.floor(r.mean() * 255 + 0.5)) for r in bits[0]] and f["density"] == bits[0].mean()


def test_fine_score_is_the_best_of_all_grids():
    g = np.random.default_rng(9)
    some = [FS.image_feature(R.draw(code(k, 21)[None], 12, 0)[0], target=k < 3) for k in range(6)]
    t, c = some[:3] * 3, [some[3 + k // 3] for k in range(9)]
    got = FS.fine_scores(FS.unpacked([x["cells"] for x in t]), FS.unpacked([x["mask"] for x in t]), FS.unpacked([x["cells"] for x in c]), [x["finders"] for x in t], [x["finders"] for x in c])
    for k, (x, y) in enumerate(zip(t, c, strict=True)):
        a, m, b = (FS.unpacked([v])[0] for v in (x["cells"], x["mask"], y["cells"]))
        scores = [FS.finder_scores([x["finders"]], [y["finders"]])[0]]
        for i, (n, pad) in enumerate(FS.GRIDS):
            part = slice(FS.ENDS[i], FS.ENDS[i + 1])
            scores.append(slow_score(*(v[part].reshape(n, n).tolist() for v in (a, m, b)), *((0.72, 0.28) if pad is None else (0.92, 0.08))))
        assert got[k] == pytest.approx(max(scores), abs=0.011)
    assert g is not None and len(FS.GRIDS) == 16


def test_sharp_rasters_are_sampled_without_resizing_them(spark, monkeypatch):
    """Sums of interpolated pixels as weighted sums of pixels: as by resizing all, of which only strips are left; drawing is spread."""
    g, whole, pixels = np.random.default_rng(12), R.resized, []

    def counted(gray, size, *parts):
        out = whole(gray, size, *parts)
        pixels.append(out.size)
        return out

    monkeypatch.setattr(R, "resized", counted)
    cases = []
    for n in range(60):
        side, scale = int(g.integers(8, 26)), int(g.integers(2, 22))
        gray = np.pad(np.kron(g.random((side, side)) < 0.5, np.ones((scale, scale))), g.integers(0, 9, (2, 2)))
        gray = (255 * (1 - gray)).astype(np.uint8)
        gray[: side // 3, : side // 2] = g.integers(0, 256)
        cases.append((gray, {} if n % 3 else {"fit": "full", "margin": n / 10}))
    mine = [R.sample(gray, **options) for gray, options in cases]
    assert max(pixels) < 420 * 60
    monkeypatch.setattr(R, "_has_full_contrast", lambda gray, size: False)
    for (gray, options), got in zip(cases, mine, strict=True):
        want = R.sample(gray, **options)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    gallery = X.gallery(spark, SF).coalesce(1)
    assert R.drawn(gallery).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_best_pairs_are_the_best_of_all(spark, monkeypatch):
    """Bounds by matrices hold and leave few pairs to score; the best of each target as by scoring all, with ties and finders."""
    g, noisy = np.random.default_rng(21), lambda k: code(k % 24, 21 if k % 3 else 25)
    images = [R.draw(noisy(k)[None], 12, 0)[0] for k in range(60)]
    asked = []
    for k in (3, 8, 17, 40):
        gray = np.rot90(images[k], k).copy()
        gray[90:150, 100:170] = 128
        asked.append(gray)
    items = [(f["cells"], f["finders"]) for f in map(FS.image_feature, images)]
    targets = [(f["cells"], f["mask"], f["finders"]) for f in (FS.image_feature(a, target=True) for a in [*asked, np.full((252, 252), 255, np.uint8)])]
    assert any(f for *_, f in targets) and any(f for _, f in items)
    item, target = (v.ravel()[g.permutation(300)[:280]] for v in np.divmod(np.arange(300), 5))
    place, whole, scored = g.permutation(280), FS.fine_scores, []
    monkeypatch.setattr(FS, "MULTIPLIED", 17)
    monkeypatch.setattr(FS, "fine_scores", lambda *a: scored.append(len(a[0])) or whole(*a))
    of = lambda v, k, at: [v[i][k] for i in at]
    every = whole(*(FS.unpacked(of(targets, k, target)) for k in (0, 1)), FS.unpacked(of(items, 0, item)), of(targets, 2, target), of(items, 1, item))
    low, high = (v[item, target] for v in FS.bounds(*(FS.unpacked([t[k] for t in targets]) for k in (0, 1)), [t[2] for t in targets], [i[0] for i in items], [i[1] for i in items]))
    assert (every >= low - 0.012).all() and (every <= high + 0.012).all()
    best, score = FS.best_pairs(item, target, place, items, targets, 5)
    want = {(t, place[k], every[k]) for t in range(5) for k in sorted(np.flatnonzero(target == t), key=lambda k: (-every[k], place[k]))[:5]}
    assert {(target[k], place[k], s) for k, s in zip(best, score, strict=True)} == want and len(best) == 25
    assert sum(scored) < 150  # the white target's ties are 56
