"""Features and sidecar grids brought up to date: kept rows aren't written, a second run writes nothing."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from gridmatch.jobs import backfill as BF
from gridmatch.jobs import fine as FS


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def pictures(spark, numbers, bad=()):
    g = np.random.default_rng(1)
    out = []
    for n in range(max(numbers) + 1):
        gray = np.kron(g.integers(0, 2, (21, 21)) * 255, np.ones((6, 6))).astype(np.uint8)
        out.append((n, 126, b"xx" if n in bad else gray.tobytes()))
    return spark.createDataFrame([r for r in out if r[0] in numbers], "record_no long, width int, pixels binary")


def test_features(spark, tmp_path):
    at = str(tmp_path / "features")
    whole = FS.image_features(pictures(spark, range(8)))
    old = whole.withColumn("finders", F.when(F.col("record_no") % 2 == 0, F.col("finders"))).withColumn("grid21", F.when(F.col("record_no") != 4, F.col("grid21")))
    BF.write_features(old, at, "first")
    kept = files(f"{at}/whole=true")
    assert BF.read_features(spark, at, True).count() == 3 and BF.read_features(spark, at).count() == 8
    report = {r["status"]: r["n"] for r in BF.backfill_features(spark, at, pictures(spark, range(1, 8), bad=(5,)), "second").collect()}
    assert report == {"kept": 3, "built": 4, "failed": 1}
    assert {k: v for k, v in files(f"{at}/whole=true").items() if k in kept} == kept  # not written again
    want, got = ({r["record_no"]: r for r in t.collect()} for t in (whole, BF.read_features(spark, at, True)))
    assert got == {n: r for n, r in want.items() if n != 5}
    assert [(r["record_no"], r["error"]) for r in BF.read_features(spark, at, False).collect()] == [(5, "no raster")]
    before = files(at)
    assert {r["status"]: r["n"] for r in BF.backfill_features(spark, at, pictures(spark, range(8), bad=(5,)), "third").collect()} == {"kept": 7}
    assert files(at) == before
    report = {r["status"]: r["n"] for r in BF.backfill_features(spark, at, pictures(spark, range(8)), "fourth").collect()}  # the image is whole now
    assert report == {"kept": 7, "built": 1} and BF.read_features(spark, at, False).count() == 0
    assert {r["record_no"]: r for r in BF.read_features(spark, at).collect()} == want


def test_sidecar(spark, tmp_path):
    at = str(tmp_path / "side")
    items = pictures(spark, range(6)).select(F.col("record_no").cast("string").alias("id"), "width", F.lit(126).alias("height"), F.when(F.col("record_no") != 3, F.col("pixels")).alias("pixels"))
    run = lambda t, name: {r["status"]: r["n"] for r in BF.backfill_sidecar(spark, at, t, name).collect()}
    assert run(items.where("id < '2'"), "a") == {"built": 2}
    assert run(items, "b") == {"kept": 2, "built": 3, "failed": 1}
    before = files(at)
    assert run(items, "c") == {"kept": 5, "failed": 1} and files(at) == before
    side = {r["id"]: r["known"] for r in spark.read.parquet(at).collect()}
    assert side == {str(n): 441 for n in (0, 1, 2, 4, 5)}
