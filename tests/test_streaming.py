import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmatch.jobs import search as S
from gridmatch.streaming import imports


@pytest.mark.parametrize("by", [None, "source_hash"])
def test_resume_adds_nothing_twice(spark, tmp_path, by):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "source_hash string, page int, item int, v int"
    rows = [("a", p, i, p * 10 + i) for p in (1, 2) for i in (1, 2)]
    half = spark.createDataFrame(rows[:3], schema).write  # a half-written page
    (half.partitionBy(by) if by else half).parquet(out)
    expected = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 3, 1), ("b", 1, 1)], "source_hash string, page int, items int")
    assert sorted(r["page"] for r in imports.unfinished(expected, spark.read.parquet(out)).where("source_hash = 'a'").collect()) == [2, 3]
    spark.createDataFrame(rows, schema).write.parquet(src)
    for n in (1, 2):
        imports.resumable_import(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / f"cp{n}"), by=by).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("source_hash", "page", "item", "v").collect())) == rows
    left = imports.unfinished(expected, spark.read.parquet(out))
    assert sorted((r["source_hash"], r["page"]) for r in left.collect()) == [("a", 3), ("b", 1)]


def words(cells):
    return [int(sum(int(v) << i for i, v in enumerate(cells[k * 63 : k * 63 + 63]))) for k in range(7)]


def test_queue_searches_each_target_once_and_drops_old_answers(spark, tmp_path):
    g = np.random.default_rng(2)
    cells = g.random((40, 441)) < 0.5
    columns = ", ".join(f"{c} long" for c in S.G)
    gallery = spark.createDataFrame([(i, 1 + i % 2, None, None, None, *words(c)) for i, c in enumerate(cells)], f"record_no long, source_id int, page int, item_index int, code string, {columns}")
    sources = spark.createDataFrame([(1, "one", 20, "m"), (2, "two", 0, "m")], "id int, name string, item_count long, mode string")
    schema = f"target_id long, asked_at timestamp, {', '.join(f'{c} long' for c in [*S.T, *S.M])}"
    searched = []

    def ask(rows, folder):
        data = [(t, f"2024-01-{day} 10:00:00", *words(cells[t] ^ (g.random(441) < 0.02)), *words([True] * 441)) for t, day in rows]
        text = schema.replace("timestamp", "string")
        spark.createDataFrame(data, text).withColumn("asked_at", F.to_timestamp("asked_at")).coalesce(1).write.mode("append").parquet(folder)

    def search(t):
        searched.extend(r["target_id"] for r in t.select("target_id").collect())
        return S.search(gallery, t, sources, "m")

    src, out = str(tmp_path / "q"), str(tmp_path / "answers")

    def run(checkpoint):
        imports.search_queue(spark.readStream.schema(schema).parquet(src), search, out, str(tmp_path / checkpoint)).awaitTermination()

    ask([(2, 11), (4, 12), (4, 12), (5, 12)], src)
    run("cp")
    first = imports.answers(spark, out)
    assert sorted({r["target_id"] for r in first.collect()}) == [2, 4, 5] and first.count() == 15
    best = {r["target_id"]: (r["id"], r["score"]) for r in first.where("rank = 1").collect()}
    assert best[2][0] == "qrbin:2" and best[2][1] > 95 and best[5][0] != "qrbin:5"  # source 2 has no records
    ask([(2, 13), (6, 13)], src)
    run("cp")  # goes on where it was
    run("new")  # starts over, but everything is answered
    assert sorted(searched) == [2, 4, 5, 6]
    every = imports.answers(spark, out)
    assert every.count() == 20 and every.dropDuplicates(["target_id", "rank"]).count() == 20
    assert imports.drop_answers(spark, out, 0, "2024-02-01T00:00:00") == 0
    assert imports.drop_answers(spark, out, 24, "2024-01-14T00:00:00") == 2  # the 11th and the 12th are over for 24 hours
    assert sorted({r["target_id"] for r in imports.answers(spark, out).collect()}) == [6]
