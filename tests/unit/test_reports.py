"""Reports, random draws, corrections, axes and sinks on small inputs."""

import json

from pyspark.sql import functions as F

from treeline.operators import events, paths, search, serving, timescale
from treeline.streaming import ingest, settle


def test_report_page():
    page = events.report_page({"weighted": 1, "sessions": 2, "worst": 4}, {"Top <b>": [("a&b", 1200)], "Empty": []})
    assert "1 event in 2 sessions" in page and "up to 4" in page and "<td>a&amp;b</td><td>1,200</td>" in page and "Top &lt;b&gt;" in page and "none" in page
    assert "Sampled" not in events.report_page({"weighted": 2, "sessions": 1, "worst": 1}, {})


def test_correction(spark):
    answers = {"helo": [], "hello": [(0,), (2,)], "few": [(3,)], "many": [(3,)] * 9, "best": [(1,)]}
    ask = lambda q: spark.createDataFrame(answers[q], "band long")
    rows, used = search.corrected(ask, "hello", "helo")
    assert rows.count() == 2 and used == "hello"
    rows, used = search.corrected(ask, "hello", "few")
    assert rows.count() == 1 and used == "hello"
    assert search.corrected(ask, "hello", "many")[1] is None and search.corrected(ask, "hello", "best")[1] is None and search.corrected(ask, None, "helo")[1] is None


def test_pick_and_notability(spark):
    pool, taken = spark.range(10).withColumnRenamed("id", "idx"), spark.createDataFrame([(0,), (9,)], "idx long")
    assert [search.pick(pool, taken, r).first()["idx"] for r in (0.0, 0.5, 0.999)] == [1, 5, 8] and search.pick(taken, pool, 0.3).count() == 0
    df = spark.createDataFrame([(None, False, False), (True, True, True), (False, False, True)], "e boolean, d boolean, b boolean")
    assert [r[0] for r in df.select(search.notability(F.col("e"), F.col("d"), F.col("b"))).collect()] == [6, 9, 3]


def test_axis():
    assert [timescale.nice_step(s, 5) for s in (5, 9, 23, 100, 0.4)] == [1, 2, 5, 20, 0.1]
    got = timescale.ticks(0, 10, 5, 1.0, lambda x: x)
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10] and timescale.ticks(0, 10, 5, 3.0, lambda x: x) == [0, 4, 8]


def test_legend_and_windows(spark):
    edges = spark.createDataFrame([(0, False), (2, True), (0, False)], "tier long, unbounded boolean")
    order = spark.createDataFrame([(1, 2, True), (0, 0, False), (2, 1, False)], "place long, tier long, unbounded boolean")
    assert sorted(map(tuple, serving.legend(edges, order).collect())) == [(0, 0, False), (1, 2, True)]
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "g string, v long")
    assert sorted(map(tuple, paths.best_in_window(rows, ["g"], ["v"]).collect())) == [("a", 1), ("b", 3)]
    timed = spark.createDataFrame([("x", "2024-01-01 00:10:00", 2), ("x", "2024-01-01 00:50:00", 3), ("y", "2024-01-01 01:10:00", 5)], "kind string, at string, weight long").withColumn("ts", F.to_timestamp("at"))
    assert sorted((r["kind"], r["weighted"]) for r in settle.windowed(timed).collect()) == [("x", 5), ("y", 5)]


def test_dual_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "v": "x"}\n{"k": 2, "v": "y"}')
    stream = spark.readStream.schema("k long, v string").json(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        q = ingest.dual_sink(stream, str(tmp_path / "table"), str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 2]
    assert sorted(json.loads(r["value"])["v"] for r in spark.read.text(str(tmp_path / "log"), recursiveFileLookup=True).collect()) == ["x", "y"]
