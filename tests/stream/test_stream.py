"""The stream form of settled queries against the pure function, and ingestion."""

import json
import os
import random

from pyspark.sql import functions as F

from treeline.streaming import ingest, settle


def streamed(spark, tmp_path, rows, schema, make, name):
    """Each list of rows is one micro-batch, in the order given."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for n, batch in enumerate(rows):
        file = tmp_path / "in" / f"{n:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def at(seconds):
    return f"2024-01-01T00:{int(seconds) // 60:02}:{seconds % 60:06.3f}"


def test_stream_matches_twin(spark, tmp_path):
    rows = [(0.0, 1, "do"), (9.0, 1, "cat"), (1.0, 1, "dog"), (1.0, 2, "ab"), (60.0, 2, "zz"), (120.0, 3, "end")]
    batches = [[{"ts": at(t), "session": s, "subject": q}] for t, s, q in rows]
    got = {(r[0], r[2]) for r in streamed(spark, tmp_path, batches, "ts timestamp, session long, subject string", settle.stream_queries, "settled")}
    assert {(1, "dog"), (1, "cat"), (2, "ab")} <= got <= {(1, "dog"), (1, "cat"), (2, "ab"), (2, "zz"), (3, "end")}


def test_out_of_order_batches_match_twins(spark, tmp_path):
    """Rows up to 14 seconds late, in random batches: both stream forms give what the batch twins give."""
    rng = random.Random(5)
    rows = sorted((round(rng.uniform(0, 100), 3), rng.randint(1, 3), rng.choice(["do", "dog", "dogs", "ca", "cat", "x", "ca t"]), ",".join(rng.sample("abc", rng.randint(1, 3)))) for _ in range(60))
    events = [{"event_id": n, "ts": at(t), "session": s, "subject": q, "tree": k, "cause": "add"} for n, (t, s, q, k) in enumerate(rows)]
    order = sorted(range(60), key=lambda n: rows[n][0] + rng.uniform(0, 14))
    batches = [[events[n] for n in order[a : a + 12]] for a in range(0, 60, 12)]
    end = [{"event_id": 99, "ts": at(600.0), "session": 9, "subject": "end", "tree": "y,z", "cause": "add"}]
    schema = "event_id long, ts timestamp, session long, subject string, tree string, cause string"
    static = spark.createDataFrame([(e["event_id"], e["session"], e["subject"], e["tree"], e["cause"], e["ts"]) for e in events], "event_id long, session long, subject string, tree string, cause string, at string").withColumn("ts", F.to_timestamp_ntz("at"))
    want = {(r["session"], str(r["ts"])[:23], r["query"]) for r in settle.settled_queries(static).collect()}
    got = {(r[0], str(r[1])[:23], r[2]) for r in streamed(spark, tmp_path, [*batches, end, end], schema, settle.stream_queries, "queries") if r[0] != 9}
    assert got == want and len(want) > 10
    words = {s: settle.settle_words([(t, q) for t, x, q, _ in rows if x == s]) for s in (1, 2, 3)}
    assert {(s, q) for s, _, q in want} == {(s, q) for s, out in words.items() for _, q in out} and len(want) == sum(map(len, words.values()))
    (tmp_path / "trees").mkdir()
    want = {(r["session"], str(r["ts"])[:23], r["key"], r["cause"]) for r in settle.settled_trees(static).collect()}
    got = {(r[0], str(r[1])[:23], r[2], r[3]) for r in streamed(spark, tmp_path / "trees", [*batches, end, end], schema, settle.stream_trees, "trees") if r[0] != 9}
    assert got == want and len(want) > 10


def test_sessions(spark):
    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 01:00:00"), ("v", "2024-01-01 00:00:00")], "user string, at string").withColumn("ts", F.to_timestamp("at"))
    assert sorted((r["user"], r["events"]) for r in settle.stream_sessions(rows).collect()) == [("u", 1), ("u", 2), ("v", 1)]


def test_ingest(spark):
    good = json.dumps({"session": "s" * 99, "events": [{"kind": "search", "subject": "x" * 500}, {"kind": "evil"}, {"kind": "tree", "tree": "a,b", "cause": "add"}]})
    many = json.dumps({"session": "t", "events": [{"kind": "add", "subject": str(i)} for i in range(50)]})
    posts = spark.createDataFrame([(b, "2024-01-01") for b in (good, many, "{", json.dumps({"session": "u", "events": [{"kind": "add", "subject": "y" * 9000}]}))], "body string, ts string")
    out = ingest.validated(posts).collect()
    assert len(out) == 34 and {len(r["session"]) for r in out} == {64, 1} and max(len(r["subject"] or "") for r in out) == 128
    assert [r["size"] for r in out if r["kind"] == "tree"] == [2]


def test_stream_of_draws(spark, tmp_path):
    """Queue events that arrive out of order are heard in order."""
    rows = [(1, "ask", "a"), (2, "ask", "b"), (3, "arrive", "a"), (4, "arrive", "b"), (5, "done", ""), (6, "ask", "c"), (7, "flush", "")]
    order = [2, 0, 1, 4, 3, 6, 5]
    event = lambda t, s, n, kind, key: {"ts": at(float(t)), "session": s, "n": n, "kind": kind, "key": key}
    batches = [[event(rows[n][0], 1, n, *rows[n][1:])] for n in order] + [[event(600, 2, 0, "ask", "z")]] * 2
    got = streamed(spark, tmp_path, batches, "ts timestamp, session long, n long, kind string, key string", ingest.stream_draws, "draws")
    queue = ingest.DrawQueue()
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [k for _, kind, key in rows for k in queue.hear(kind, key)] == ["a", "b", "c"]
