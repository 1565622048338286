"""Images, JSON lines, components, crops and small features against slow versions."""

import json
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from gridmatch.operators import components as K
from gridmatch.operators import crops as C
from gridmatch.operators import features as V
from gridmatch.operators import raster as R
from gridmatch.sources import fixtures as X
from gridmatch.sources import records as P
from gridmatch.sources import store
from gridmatch.sources.tables import shared_dir, tables_removed, written


def png(gray):
    h, w = gray.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in gray)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images_become_records_and_a_damaged_one_finds_its_origin(spark, tmp_path):
    g = np.random.default_rng(3)
    grids = (g.random((12, 21, 21)) < 0.5).astype(np.uint8)
    grids[:, [0, 0, -1, -1], [0, -1, 0, -1]] = 1  # the box around the dark pixels is the grid
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i, cells in enumerate(grids):
        image = np.full((21 * 12 + 60, 21 * 12 + 60), 255, np.uint8)
        image[30:-30, 30:-30] = np.kron(1 - cells, np.full((12, 12), 255, np.uint8)).astype(np.uint8)
        (tmp_path / "in" / "deep" / f"{i}.png").write_bytes(png(image))
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    made = store.image_records(store.read_images(spark, str(tmp_path / "in")))
    store.write_gallery(made, str(tmp_path / "store"))
    rows = {int(r["path"].split("/")[-1][:-4]): r for r in store.read_gallery(spark, str(tmp_path / "store")).collect()}
    assert set(rows) == set(range(12))
    word = lambda cells: [int(sum(int(v) << i for i, v in enumerate(cells.ravel()[k * 63 : k * 63 + 63]))) for k in range(7)]
    for i, cells in enumerate(grids):
        assert rows[i]["known"] == 441 and [rows[i][f"w{k}"] for k in range(7)] == word(cells) and (rows[i]["page"], rows[i]["item_index"], rows[i]["code"]) == (0, 1, None)
    # part of an image painted gray, sampled as a target
    image = np.full((21 * 12 + 60, 21 * 12 + 60), 255, np.uint8)
    image[30:-30, 30:-30] = np.kron(1 - grids[5], np.full((12, 12), 255, np.uint8)).astype(np.uint8)
    image[30 + 60 : 30 + 180, 30 + 60 : 30 + 150] = 150
    cells, mask = R.sample(image, 21, **R.TARGET)
    wrong = [int(((cells != c) & (mask == 1)).sum()) for c in grids]
    assert 300 < mask.sum() < 441 and int(np.argmin(wrong)) == 5 and wrong[5] <= 0.01 * mask.sum()


def test_json_lines_keep_the_last_row(spark, tmp_path):
    lines = [{"id": 1, "name": "a", "item_count": 1, "mode": "m"}, None, {"id": 2, "name": "b"}, {"id": 1, "name": "c", "item_count": 7, "mode": "m"}, {"name": "no id"}]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) if x else "  " for x in lines) + "\n\n")
    got = sorted(map(tuple, store.read_sources(spark, str(tmp_path / "s.jsonl")).collect()))
    assert got == [(1, "c", 7, "m"), (2, "b", None, None)]
    (tmp_path / "log").mkdir()
    for k in (1, 2, 9, 10, 11):
        (tmp_path / "log" / f"part-{k}.jsonl").write_text(json.dumps({"id": 1 + k % 2, "name": f"n{k}"}) + "\n")
    assert sorted((r["id"], r["name"]) for r in store.read_sources(spark, str(tmp_path / "log")).collect()) == [(1, "n10"), (2, "n11")]
    (tmp_path / "f.jsonl").write_text('{"id": "x"}\n{"id": "y", "kind": "pdf", "width": 3}\n')
    got = {r["id"]: (r["code"], r["kind"], r["width"], r["height"]) for r in store.read_feature_index(spark, str(tmp_path / "f.jsonl")).collect()}
    assert got == {"x": (None, "image", 0, 0), "y": (None, "pdf", 3, 0)}
    (tmp_path / "g.jsonl").write_text('{"id": "x", "grid": "1"}\n{"id": "y"}\n')
    assert [tuple(r) for r in store.read_sidecar(spark, str(tmp_path / "g.jsonl")).collect()] == [("x", "1")]


def test_matches_and_progress(spark, tmp_path):
    rows = [(1, 2, "qrbin:4"), (1, 1, "qrbin:9"), (2, 1, "qrbin:4")]
    store.write_matches(spark.createDataFrame(rows, "target_id long, rank int, id string"), str(tmp_path))
    back = spark.read.json(f"{tmp_path}/matches")
    assert sorted((r["target_id"], r["rank"], r["id"]) for r in back.collect()) == sorted(rows)
    store.write_progress(spark.createDataFrame([(3, 1)], "indexed long, failed long"), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/progress").count() == 1


def flood(bits):
    seen, out = set(), []
    for start in zip(*np.nonzero(bits), strict=True):
        if start in seen:
            continue
        todo, part = [start], {start}
        while todo:
            y, x = todo.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= q[0] < bits.shape[0] and 0 <= q[1] < bits.shape[1] and bits[q] and q not in part:
                    part.add(q)
                    todo.append(q)
        seen |= part
        out.append(frozenset((int(y), int(x)) for y, x in part))
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.55, 0.8, 1.0])
def test_regions_as_a_flood_fill(share):
    bits = (np.random.default_rng(int(share * 10)).random((33, 40)) < share).astype(np.uint8)
    number, many = K.labelled(bits)
    mine = {frozenset(zip(*(v.tolist() for v in np.nonzero(number == k + 1)), strict=True)) for k in range(many)}
    want = flood(bits)
    assert mine == set(want) and many == len(want)
    r = K.regions(bits)
    boxes = Counter((min(x for _, x in p), min(y for y, _ in p), max(x for _, x in p) - min(x for _, x in p) + 1, max(y for y, _ in p) - min(y for y, _ in p) + 1, len(p)) for p in want)
    assert Counter(zip(*(r[c].tolist() for c in ("left", "top", "width", "height", "area")), strict=True)) == boxes


def test_white_damage_is_masked():
    bits = np.ones((40, 40), np.uint8)
    bits[10:20, 10:20] = 0  # compact and inside: damage
    bits[0:12, 30:40] = 0  # touches the border
    bits[30:34, 5:9] = 0  # too small
    mask = K.without_white_damage(bits, np.ones((40, 40), np.uint8))
    assert mask.sum() == 1600 - 100 and not mask[10:20, 10:20].any()
    assert K.without_white_damage(np.ones((9, 9), np.uint8), np.ones((9, 9), np.uint8)).all()


def test_crops_from_text_one_by_one(spark):
    """Every page of sf0.001 against sums over its items, one at a time."""
    items, half = X.text_items(spark, "/root/testdata/sf0.001"), lambda v: int(np.floor(v + 0.5))
    pages = {}
    for r in items.collect():
        text = r["str"].strip()
        if text.isascii() and text.isdigit() and len(text) >= 6 and r["width"] > 10:
            pages.setdefault(r["page_id"], []).append((r["y"], r["x"], text, r["width"], r["height"]))
    want = Counter()

    def spacing(values, fallback):
        clusters = []
        for v in sorted(values):
            if clusters and abs(sum(clusters[-1]) / len(clusters[-1]) - v) <= 60:
                clusters[-1].append(v)
            else:
                clusters.append([v])
        mid = [sum(c) / len(c) for c in clusters]
        gaps = sorted(b - a for a, b in zip(mid, mid[1:]) if b > a)
        return gaps[len(gaps) // 2] if gaps else fallback(len(mid))

    for page, some in pages.items():
        across = spacing([x + w / 2 for _, x, _, w, _ in some], lambda n: 900 / max(n, 4))
        down = spacing([y for y, *_ in some], lambda n: 1200 / max(n, 3))
        for k, (y, x, text, w, h) in enumerate(sorted(some), 1):
            size = max(48, min(0.58 * w, min(0.42 * across, 0.68 * down)))
            left, top = half(max(0, x + w / 2 - size / 2)), half(max(0, y - max(6, 0.35 * h) - size))
            width, height = half(min(size, 900 - left)), half(min(size, 1200 - top))
            if width >= 32 and height >= 32:
                want[page, k, text, left, top, width, height] += 1
    crops = C.crops_from_text(items)
    assert want and Counter(map(tuple, crops.collect())) == want
    pixels = spark.createDataFrame([(-1, 1, "p", 0, 0, 50, 50), (next(iter(want))[0], 1, "p", 0, 0, 50, 50)], f"page_id long, {C.BOX}")
    chosen = C.chosen_crops(crops, pixels)
    assert chosen.where("text = 'p'").count() == 1 and chosen.count() == sum(want.values()) + 1
    assert C.upper_median([3.0, -1.0, 5.0, float("nan"), 4.0], 9) == 4.0 and C.upper_median([3.0, 5.0], 9) == 5.0 and C.upper_median([0.0], 9) == 9


def test_grid_by_area_and_black_box():
    g = np.random.default_rng(2)
    bits, mask = (g.random((5, 8, 8)) < 0.5).astype(np.uint8), (g.random((5, 8, 8)) < 0.5).astype(np.uint8)
    bits[0] = 0
    cells, known = V.grid_by_area(bits, mask, 4)
    boxes = V.black_box(bits)
    for i in range(5):
        for y in range(4):
            for x in range(4):
                part = slice(2 * y, 2 * y + 2), slice(2 * x, 2 * x + 2)
                assert cells[i, 4 * y + x] == (bits[i][part].mean() >= 0.5) and known[i, 4 * y + x] == (mask[i][part].mean() >= 0.45)
        ys, xs = np.nonzero(bits[i])
        assert boxes[i].tolist() == ([xs.min(), ys.min(), xs.max(), ys.max()] if len(xs) else [0, 0, 7, 7])


def test_one_fixed_record():
    """Cell 0, 62, 63 and 440 set; offset 258, length 3, source 7, page 0, item 9."""
    grid = bytearray(56)
    for cell in (0, 62, 63, 440):
        grid[cell // 8] |= 1 << cell % 8
    raw = bytes(grid) + (258).to_bytes(6, "little") + struct.pack("<HIHH", 3, 7, 0, 9) + bytes(8)
    assert len(raw) == P.RECORD.itemsize == 80
    r = np.frombuffer(raw, P.RECORD)
    assert P.to_words(r["grid"])[0].tolist() == [1 | 1 << 62, 1, 0, 0, 0, 0, 1 << 440 - 378]
    assert (r["source_id"][0], r["page"][0], r["item_index"][0], r["code_length"][0]) == (7, 0, 9, 3)


def test_shards_with_a_cut_off_tail(spark, tmp_path):
    one = np.zeros(3, P.RECORD)
    one["source_id"], one["item_index"] = [1, 2, 3], [0, 5, 6]
    (tmp_path / "shard-2.bin").write_bytes(one.tobytes()[:-10])
    got = P.parse_records(P.read_shards(spark, str(tmp_path))).orderBy("record_no").collect()
    assert [(r["record_no"], r["source_id"], r["page"], r["item_index"]) for r in got] == [(200_000, 1, None, None), (200_001, 2, None, 5)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_tables_on_the_way_are_removed(spark):
    there = lambda df: [Path(f.removeprefix("file:")).exists() for f in df.inputFiles()]
    before = written(spark.range(3), "kept")
    with tables_removed(spark):
        outer = written(spark.range(5), "gone")
        with tables_removed(spark):
            inner = written(outer, "gone")
            count, files = inner.count(), inner.inputFiles()
        assert count == 5 and not any(Path(f.removeprefix("file:")).exists() for f in files) and all(there(outer))
        files = outer.inputFiles()
    assert not any(Path(f.removeprefix("file:")).exists() for f in files) and all(there(before)) and before.count() == 3
    with pytest.raises(ZeroDivisionError), tables_removed(spark):
        files = written(spark.range(2), "gone").inputFiles()
        raise ZeroDivisionError
    assert not any(Path(f.removeprefix("file:")).exists() for f in files)


def test_text_crops_of_all_pages_together(spark):
    """Pages cut by batches and a page longer than a batch give what one page at a time gives; no call for each page."""
    g = np.random.default_rng(6)
    pages = [g.normal(0, 300, n).round(1) for n in (1, 2, 900, *g.integers(1, 9, 200))]
    pages[1][:] = np.nan
    first = np.cumsum([0, *map(len, pages)])[:-1]
    want = [C.upper_median(list(np.diff(C.centres(v))), 900 / max(len(C.centres(v)), 4)) for v in pages]
    assert C.spacings(np.concatenate(pages), first, 900, 4).tolist() == want
    items = spark.createDataFrame([(f"p{k}", "123456", float(x), float(y), 90.0, 12.0) for k, v in enumerate(pages) for x, y in zip(v, v[::-1], strict=True)], "page_id string, str string, x double, y double, width double, height double")
    whole, most = sorted(map(tuple, C.crops_from_text(items).collect())), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        crops = C.crops_from_text(items)
        assert sorted(map(tuple, crops.collect())) == whole and len(whole) > 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert "FlatMapGroupsInPandas" not in crops._jdf.queryExecution().toString()
