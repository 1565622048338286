"""From a folder of files to answers: imports by batches, resumed documents, page marks, a search of the store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmatch.functions import bits as B
from gridmatch.jobs import build
from gridmatch.operators import crops as C
from gridmatch.operators import order as O
from gridmatch.operators import raster as R
from gridmatch.sources import records as P
from gridmatch.sources import store as images
from gridmatch.sources.living import Store
from test_store import png

MODE = "m1"
PAGES = "hash string, page int, page_width int, pixels binary, page_count int"
TEXTS = "hash string, page int, str string, x double, y double, width double, height double"


def framed(cells, scale=12, quiet=30):
    return np.pad(np.kron(1 - cells, np.full((scale, scale), 255)).astype(np.uint8), quiet, constant_values=255)


def grid_words(cells):
    return [int(sum(int(v) << i for i, v in enumerate(cells.ravel()[k * 63 : k * 63 + 63]))) for k in range(7)]


@pytest.fixture(scope="module")
def grids():
    g = np.random.default_rng(7)
    out = (g.random((30, 21, 21)) < 0.5).astype(np.uint8)
    out[:, [0, 0, -1, -1], [0, -1, 0, -1]] = 1  # the box around the dark pixels is the grid
    return out


def page(cells):
    """A page of 900 pixels with a grid in each place of a row of four."""
    raster = np.full((300, 900), 255, np.uint8)
    for k, c in enumerate(cells):
        raster[40 : 40 + 84, 40 + 220 * k : 40 + 220 * k + 84] = np.kron(1 - c, np.full((4, 4), 255)).astype(np.uint8)
    return raster.tobytes()


def found(store):
    return {r["record_no"]: r for r in store.gallery().collect()}


def test_folder_to_search(spark, tmp_path, grids):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    (source / "deep").mkdir(parents=True)
    for i in range(12):
        (source / "deep" / f"img {i}.png").write_bytes(png(framed(grids[i])))
    (source / "Img 3 copy.PNG").write_bytes(png(framed(grids[3])))
    (source / "broken.png").write_bytes(b"no image")
    (source / "notes.txt").write_bytes(b"text")
    for name in ("b.pdf", "c.PDF", "d.pdf"):
        (source / name).write_bytes(name.encode())
    hashes = {r["path"].split("/")[-1]: r["hash"] for r in build.listed(spark, str(source)).collect()}
    b, c = hashes["b.pdf"], hashes["c.PDF"]
    rows = [(b, 1, 900, page(grids[12:16]), 4), (b, 2, 900, None, 4), (b, 4, 900, page(grids[16:17]), 4), (c, 1, 900, page([]), 1)]
    texts = [(b, 1, "  123456 ", 40.0 + 220 * k, 134.0, 84.0, 12.0) for k in range(1)] + [(b, 1, "12345", 0.0, 0.0, 50.0, 9.0)]
    args = (spark.createDataFrame(rows, PAGES), spark.createDataFrame(texts[1:], TEXTS))
    report = build.import_folder(store, "day1", MODE, str(source), *args).first().asDict()
    # 19 files; the txt and the copy are skipped; broken.png, the page without raster, c (no code) and d (no page) failed
    assert report == {"scanned": 18, "total_files": 17, "indexed": 17, "skipped": 2, "failed": 4}
    got, s = found(store), {r["name"]: r for r in store.sources().collect()}
    # in natural order: b.pdf, then Img 3 copy before img 0 (a space sorts before the digits' end), then by number
    assert sorted(got) == list(range(17)) and [got[k]["page"] for k in range(5)] == [1, 1, 1, 1, 4]
    names = {v["id"]: k for k, v in s.items()}
    order = ["b.pdf", "c.PDF", "img 0.png", "img 1.png", "img 2.png"]
    assert [names[k] for k in range(5)] == order and "broken.png" not in s and "d.pdf" not in s
    assert s["b.pdf"].asDict().items() >= {"item_count": 5, "start_record": 0, "page_count": 4, "completed_page": 2, "status": "importing"}.items()
    assert s["c.PDF"].asDict().items() >= {"item_count": 0, "page_count": 1, "completed_page": 1, "status": "completed"}.items()
    for n, cells in [(0, grids[12]), (4, grids[16]), (5, grids[0]), (7, grids[2])]:
        assert [got[n][f"w{k}"] for k in range(7)] == grid_words(cells)
    assert sorted((r["page"], r["detected"], r["indexed"], r["failed"]) for r in store.pages().where(F.col("hash") == b).collect()) == [(1, 4, 4, 0), (2, 0, 0, 1), (4, 1, 1, 0)]

    # again, under the same name and under another: nothing is added
    assert build.import_folder(store, "day1", MODE, str(source), *args).first()["indexed"] == 0
    assert build.import_folder(store, "day2", MODE, str(source), *args).first().asDict()["indexed"] == 0
    assert found(store).keys() == got.keys()
    # page 3 comes, with a printed number: the document is complete, numbers go on
    rows.append((b, 3, 900, page(grids[17:18]), 4))
    texts = [(b, 3, " 1234567 ", 10.0, 160.0, 260.0, 12.0)]
    report = build.import_folder(store, "day3", MODE, str(source), spark.createDataFrame(rows, PAGES), spark.createDataFrame(texts, TEXTS)).first()
    now, s = found(store), {r["name"]: r for r in store.sources().collect()}
    assert report["indexed"] == 1 and sorted(now) == list(range(18)) and (now[17]["page"], now[17]["code"], now[17]["source_id"]) == (3, "1234567", 0)
    assert s["b.pdf"].asDict().items() >= {"id": 0, "item_count": 6, "start_record": 0, "completed_page": 4, "status": "completed"}.items()

    # a part painted gray: the damaged image finds its origin, first and with a score near 100
    hurt = framed(grids[5])
    hurt[90:210, 90:180] = 150
    (tmp_path / "asked").mkdir()
    (tmp_path / "asked" / "5.png").write_bytes(png(hurt))
    targets = build.image_targets(images.read_images(spark, str(tmp_path / "asked")), F.lit(5))
    best = {r["rank"]: r for r in build.search_store(store, targets, MODE).collect()}
    assert len(best) == 5 and best[1]["display"].startswith("img 5.png") and best[1]["final"] >= 98.5 and best[1]["high_confidence"]
    assert best[2]["final"] < 80 and build.search_store(store, targets, "other mode").count() == 0


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path, grids):
    store = Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("a/x1.png", "h1"), ("a/x2.png", "h2"), ("a/y.png", None)], "path string, hash string")
    pictures = spark.createDataFrame([(f"a/x{k}.png", 312, 312, framed(grids[k]).tobytes()) for k in (1, 2)], "path string, width int, height int, pixels binary")
    store.write("gallery", spark.createDataFrame([(n, 0, "h", 1, 1, None, *[0] * 7) for n in range(3)], "record_no long, source_id long, hash string, page int, item_index int, code string, " + ", ".join(f"w{k} long" for k in range(7))), "broken")
    assert store.gallery().count() == 0 and store.totals() == (0, 0, 0)
    assert build.import_batch(store, "broken", MODE, files, pictures).first()["indexed"] == 2
    assert sorted(found(store)) == [0, 1] and store.totals() == (2, 2, 1)
    more = spark.createDataFrame([("b/z.png", "h3")], "path string, hash string")
    build.import_batch(store, "next", MODE, files.union(more), pictures.union(spark.createDataFrame([("b/z.png", 312, 312, framed(grids[9]).tobytes())], pictures.schema)))
    assert sorted(found(store)) == [0, 1, 2] and found(store)[2]["source_id"] == 2
    empty = Store(spark, str(tmp_path / "none"))
    assert build.import_batch(empty, "e", MODE, files.limit(0), pictures.limit(0)).first().asDict() == {"scanned": 0, "total_files": 0, "indexed": 0, "skipped": 0, "failed": 0}


def test_last_whole_page(spark):
    rows = [("a", p) for p in (1, 2, 2, 4, 5)] + [("b", p) for p in (2, 3)] + [("c", 1), ("d", 0), ("e", None)] + [("f", p) for p in range(1, 60)]
    got = {r[0]: r[1] for r in build.last_whole_page(spark.createDataFrame(rows, "hash string, page int")).collect()}
    assert got == {"a": 2, "b": 0, "c": 1, "d": 0, "e": 0, "f": 59}


def test_places(spark):
    g = np.random.default_rng(5)
    rows = [(int(v), i) for i, v in enumerate(g.integers(0, 30, 700))] + [(7, 1000 + i) for i in range(700)]
    t = spark.createDataFrame(rows, "k int, i int").repartition(5)
    got = {(r["k"], r["i"]): r["place"] for r in O.placed(t, ["k", "i"], parts=6).collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows))}
    assert O.placed(t.limit(0), ["k"]).count() == 0


def test_crops_that_fail_and_pages_that_are_not_there(spark, grids):
    pages = spark.createDataFrame([("p", 900, page(grids[:2])), ("q", 900, b"12345"), ("r", 900, page(grids[2:3]))], "page_id string, page_width int, pixels binary")
    boxes = [("p", 1, "a", 38, 38, 88, 88), ("p", 2, None, 850, 10, 90, 90), ("p", 3, "c", -1, 0, 50, 50), ("q", 1, "d", 0, 0, 40, 40), ("zz", 1, "e", 0, 0, 40, 40)]
    got = {(r["page_id"], r["index"]): (r["status"], r["error"], r["text"], r["known"]) for r in C.crop_grids(pages, spark.createDataFrame(boxes, f"page_id string, {C.BOX}")).collect()}
    assert got == {("p", None): ("page", None, None, None), ("p", 1): ("indexed", None, "a", 441), ("p", 2): ("failed", "outside the page", None, None), ("p", 3): ("failed", "outside the page", "c", None), ("q", None): ("failed", "no raster", None, None), ("zz", None): ("failed", "no raster", None, None), ("r", None): ("page", None, None, None), ("r", 1): ("indexed", None, None, 441)}
    by_pixels = C.crop_grids(pages).where("index is not null").select("page_id", F.col("index").alias("i"), *[f"w{k}" for k in range(B.WORDS)])
    assert sorted(tuple(r) for r in by_pixels.collect()) == [("p", 1, *grid_words(grids[0])), ("p", 2, *grid_words(grids[1])), ("r", 1, *grid_words(grids[2]))]
    assert C.crop_grids(pages.limit(0)).count() == 0 and R.GALLERY["black"] == 95 and P.SHARD == 100_000


def test_a_packed_index_is_taken_over(spark, tmp_path, grids):
    """Shards, codes and sources byte by byte, two shards, lines of several bytes a letter; then an import goes on after them."""
    store, codes, records = Store(spark, str(tmp_path / "store")), b"", [[], []]
    at = {0: "123456", 1: "", 2: "ключ 7", 3: "9" * 70, 4: ""}
    for n, text in at.items():
        r = np.zeros(1, P.RECORD)
        bits = np.zeros(448, np.uint8)
        bits[:441] = grids[n].ravel()
        r["grid"], r["code_offset"] = np.packbits(bits, bitorder="little"), np.frombuffer(len(codes).to_bytes(6, "little"), np.uint8)
        r["code_length"], r["source_id"], r["page"], r["item_index"] = len(text.encode()), n % 2, n, n + 1
        codes += text.encode() + b"\n"
        records[n >= 3].append(r.tobytes())
    (tmp_path / "shards").mkdir()
    for k, part in enumerate(records):
        (tmp_path / "shards" / f"codes-{k}.bin").write_bytes(b"".join(part) + b"cut" * k)
    (tmp_path / "codes.txt").write_bytes(codes)
    log = ['{"id":0,"name":"a","path":"/x/a.pdf","hash":"ha","startRecord":0,"itemCount":0,"extractionMode":"m1"}', "", '{"id":1,"name":"b","path":"/x/b.png","hash":"h9","startRecord":1,"itemCount":2,"extractionMode":"m1"}', '{"id":0,"name":"a","path":"/x/a.pdf","hash":"ha","startRecord":0,"itemCount":3,"extractionMode":"m1"}']
    (tmp_path / "sources.jsonl").write_text("\n".join(log) + "\n")
    for _ in range(2):  # the second time does nothing
        build.import_packed_index(store, "old", str(tmp_path / "shards"), str(tmp_path / "codes.txt"), str(tmp_path / "sources.jsonl"))
    got = found(store)
    assert {n: (r["source_id"], r["page"], r["item_index"], r["code"]) for n, r in got.items()} == {n + 99_997 * (n >= 3): (n % 2, n or None, n + 1, t or None) for n, t in at.items()}
    assert [got[100_000][f"w{k}"] for k in range(7)] == grid_words(grids[3]) and store.totals()[:2] == (5, 2)
    # b.png is known, c.png is not
    files = spark.createDataFrame([("in/b.png", "h9"), ("in/c.png", "h10"), ("in/a.pdf", "ha")], "path string, hash string")
    pictures = spark.createDataFrame([(f"in/{n}.png", 312, 312, framed(grids[9]).tobytes()) for n in "bc"], "path string, width int, height int, pixels binary")
    assert build.import_batch(store, "more", MODE, files, pictures).first().asDict() == {"scanned": 3, "total_files": 3, "indexed": 1, "skipped": 2, "failed": 0}
    assert {r["name"]: r["id"] for r in store.sources().collect()} == {"a": 0, "b": 1, "c.png": 2}
    with pytest.raises(ValueError):
        build.import_packed_index(store, "again", str(tmp_path / "shards"), str(tmp_path / "codes.txt"), str(tmp_path / "sources.jsonl"))


def test_images_that_come_in(spark, tmp_path, grids):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()

    def come(*numbers):
        for i in numbers:
            (source / f"img {i}.png").write_bytes(png(framed(grids[i])))
        for _ in range(2):  # the second trigger finds nothing new
            build.import_stream(store, str(source), MODE, str(tmp_path / "checkpoint"), files=2).awaitTermination()

    come(0, 1, 2)
    assert sorted(found(store)) == [0, 1, 2]
    (source / "copy.png").write_bytes(png(framed(grids[1])))
    (source / "bad.png").write_bytes(b"none")
    come(3)
    names = {r["id"]: r["name"] for r in store.sources().collect()}
    assert sorted(found(store)) == [0, 1, 2, 3] and sorted(names.values()) == [f"img {i}.png" for i in range(4)]
    for r in found(store).values():
        assert [r[f"w{k}"] for k in range(7)] == grid_words(grids[int(names[r["source_id"]][4])])


def edged(seed: int) -> np.ndarray:
    """Pages of twelve random grids; four of them have a white line or two at an edge."""
    cells = (np.random.default_rng(seed).random((12, 21, 21)) < 0.5).astype(np.uint8)
    cells[:, [0, 0, 20, 20], [0, 20, 0, 20]] = 1
    cells[1, :, 20] = cells[4, :, :2] = cells[6, 0] = cells[11, 19:] = 0
    return cells


def gallery_of(spark, cells: np.ndarray):
    rows = [(k, *(int(w) for w in P.to_words(np.packbits(np.pad(c.ravel(), (0, 7)), bitorder="little")[None])[0])) for k, c in enumerate(cells)]
    return spark.createDataFrame(rows, "record_no long, " + ", ".join(f"w{k} long" for k in range(7)))


def test_codes_with_white_edges_under_printed_numbers(spark):
    """printed_codes: the square of a code whose outermost lines are white comes from the page's others."""
    g = gallery_of(spark, edged(3))
    boxes = [(0, k + 1, f"70000{k}", k % 4 * 220 + 29, k // 4 * 220 + 28, 87, 87) for k in range(12)]
    found = C.crop_grids(R.drawn_pages(g), spark.createDataFrame(boxes, f"page_id long, {C.BOX}")).where("index is not null")
    assert sorted((r["index"] - 1, *[r[f"w{k}"] for k in range(7)]) for r in found.collect()) == sorted(map(tuple, g.collect()))
    assert found.where("known = 441").count() == 12


def test_codes_with_white_edges_found_by_pixels(spark):
    """grids_of_pages: so it does where pixels tell where codes are; without others on the page, nothing is known."""
    for seed in (3, 4):
        g = gallery_of(spark, edged(seed))
        found = C.crop_grids(R.drawn_pages(g)).where("index is not null")
        assert sorted((r["index"] - 1, *[r[f"w{k}"] for k in range(7)]) for r in found.collect()) == sorted(map(tuple, g.collect()))
    gray = np.full((300, 700), 255, np.uint8)
    gray[30:114, 30:110] = gray[200:284, 240:324] = gray[30:114, 500:584] = 0
    boxes = [(25, 25, 95, 95), (235, 195, 95, 95), (495, 25, 95, 95)]
    assert C.whole_squares(gray, boxes, 95) == [None] * 3 and C.whole_squares(gray, boxes[:1], 95) == [None]
    gray[200:284, 26:110] = 0
    assert C.whole_squares(gray, [*boxes, (20, 195, 95, 95)], 95) == [(26, 30, 84), None, None, None]


def test_pages_are_drawn_across_batches(spark):
    """Pages that batches cut, some not full, one by one; no call for each page."""
    cells, numbers = (np.random.default_rng(8).random((90, 21, 21)) < 0.5).astype(np.uint8), [k for k in range(100, 300) if k % 12 and k % 7 < 3][:90]
    words = P.to_words(np.packbits(np.pad(cells.reshape(90, -1), ((0, 0), (0, 7))), 1, bitorder="little"))
    g = spark.createDataFrame([(n, *w) for n, w in zip(numbers, words[: len(numbers)].tolist(), strict=True)], "record_no long, " + ", ".join(f"w{k} long" for k in range(7)))
    want = {}
    for n, c in zip(numbers, cells, strict=False):
        y, x = (v * 220 + 30 for v in divmod(n % 12, 4))
        want.setdefault(n // 12, np.full((690, 910), 255, np.uint8))[y : y + 84, x : x + 84] = 255 * (1 - np.kron(c, np.ones((4, 4))))
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
        pages = R.drawn_pages(g)
        got = {r["page_id"]: (r["page_width"], bytes(r["pixels"])) for r in pages.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert got == {k: (910, v.tobytes()) for k, v in want.items()} and len(got) > 10
    assert "FlatMapGroupsInPandas" not in pages._jdf.queryExecution().toString() and R.drawn_pages(g.limit(0)).count() == 0


def test_rasters_are_read_in_short_groups_and_not_sorted(spark, tmp_path):
    """imported_in_parts: a task holds few rasters at once, and no sort or window holds any."""
    from pyarrow import parquet

    from gridmatch.sources.tables import written

    pages = R.drawn_pages(gallery_of(spark, edged(3)).crossJoin(spark.range(100).withColumnRenamed("id", "n")).selectExpr("record_no + n * 12 as record_no", "40 as page_count", *[f"w{k}" for k in range(7)]).coalesce(1), keep=("page_count",))
    table = written(pages.withColumns({"hash": F.lit("h"), "page": (F.col("page_id") + 1).cast("int")}).coalesce(1), "pages", long_rows=True)
    groups = [g.num_rows for f in table.inputFiles() for m in [parquet.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(groups) == 100 and max(groups) <= 48 and table.where("page_count = 40 and length(pixels) = 910 * 690").count() == 100
    fresh, threshold = spark.createDataFrame([("a.pdf", "h", "pdf")], "path string, hash string, kind string"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    gone = spark.createDataFrame([("h", p) for p in range(1, 31)], "hash string, page int")
    boxes = spark.createDataFrame([(p, 1, "123456", 29, 28, 87, 87) for p in range(100)], f"page_id long, {C.BOX}")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = build.pdf_outcomes(fresh, table, None, gone, (900, 1200))
        plans = [d._jdf.queryExecution().executedPlan().inputPlan() for d in (found, C.crop_grids(table, boxes))]
        assert found.where("item_index is not null").count() == 840 and {r["page"] for r in found.collect()} == set(range(31, 101))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def nodes(plan):
        below = plan.children()
        return [(plan.nodeName(), plan.output().mkString(","))] + [n for k in range(below.size()) for n in nodes(below.apply(k))]

    with_rasters = [name for plan in plans for name, columns in nodes(plan) if "pixels" in columns]
    assert with_rasters.count("ShuffledHashJoin") == 2 and not {"Sort", "Window", "SortMergeJoin"} & set(with_rasters)
