"""The subword quality classifier against plain versions, and its held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from treeline.llm import queries, subword

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M
    return x ^ x >> 33


def plain_features(word):
    base = 0x9E3779B97F4A7C15
    points = [mix(ord(c) + 1) for c in f"<{word}>"]
    grams = [sum(p * base**k for k, p in enumerate(points[i : i + n])) + n for n in subword.GRAMS for i in range(len(points) - n + 1)]
    grams.append(sum(mix((p + k * base) & M) for k, p in enumerate(points)))
    return sorted(max(mix(g & M) >> (64 - subword.BITS), 1) for g in grams)


def test_features_and_logits():
    words = ["a", "the", "Überß", "🙂🙂", "x" * 50, "12.3", "thé"]
    bucket, offsets = subword.features(words)
    for i, w in enumerate(words):
        assert sorted(bucket[offsets[i] : offsets[i + 1]].tolist()) == plain_features(w)
    rng = np.random.default_rng(1)
    model = subword.Model(rng.normal(size=1 << subword.BITS), 0.25)
    texts = ["a the the the a", None, "", " \n\t", "thé a\nthé thé", "Überß"]
    want = []
    for t in texts:
        own = (t or "").split()
        bag = [b for w in own for b in plain_features(w)] + [subword.AGAIN for x, y in zip(own, own[1:], strict=False) if x == y]
        want.append(np.mean(model.weight[bag]) + 0.25 if bag else 0.25)
    assert np.allclose(model.logits(pa.array(texts, pa.string())), want)


def test_cut():
    z, y = np.array([0.1, 0.4, 0.5, 0.9, 2.0]), np.array([0, 0, 1, 0, 1])
    right = {c: ((z[y == 1] >= c).mean() + (z[y == 0] < c).mean()) / 2 for c in (0.0, 0.25, 0.45, 0.7, 1.45, 3.0)}
    assert right[0.45] == max(right.values()) and abs(subword.best_cut(z, y) - 0.45) < 1e-9
    assert subword.best_cut(z, np.ones(5, int)) == 0.0


def test_one_step_is_the_gradient(monkeypatch):
    monkeypatch.setattr(subword, "STEPS", 1)
    monkeypatch.setattr(subword, "BATCH", 2)
    bags = [(np.array([3, 9]), np.array([2.0, 1.0], np.float32)), (np.array([9]), np.array([4.0], np.float32))]
    model = subword.fit(bags, np.array([1, 0]))
    start = np.random.default_rng(5)
    start.permutation(2)  # the embeddings are drawn first
    embed = np.random.default_rng(5).uniform(-1 / subword.DIM, 1 / subword.DIM, (1 << subword.BITS, subword.DIM)).astype(np.float32)
    mean = [(2 * embed[3] + embed[9]) / 3, embed[9]]
    out = subword.RATE * (0.5 * mean[0] * 0.5 - 0.5 * mean[1] * 0.5)  # of label 1; label 0 has its negative
    assert np.allclose(model.weight[[3, 9, 20]], embed[[3, 9, 20]] @ (2 * out), atol=1e-6) and model.bias == 0


def test_held_out_accuracy(spark, sf):
    data = sf.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op12_quality_classifier"](spark, data)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count()
    right = [(r["quality"], rows[r["doc_id"]]["predicted"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert sum(a == b for a, b in right) >= 0.95 * len(right)


def test_labels_of_the_held_out_are_not_read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    turned = labels.withColumn("quality", F.when(usable, F.col("quality")).otherwise(1 - F.col("quality")))
    one, two = (sorted(map(tuple, subword.quality(docs.select("doc_id", "text"), x, usable).select("doc_id", "score").collect())) for x in (labels, turned))
    assert one == two


def test_odd_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate(["good plain words here", "bad | | | |", None, "", "w " * 100_000, "good plain words here"])] + [(None, "no id", "s"), (1, "other text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (1, 1), (4, None), (5, 1), (None, 1), (77, 1), (0, 3)], "doc_id long, quality int")
    got = subword.quality(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    of = {(r["doc_id"], r["text"]): r["score"] for r in got}
    assert of[0, "good plain words here"] == of[5, "good plain words here"] and of[2, None] == of[3, ""]
    assert {r["score"] for r in subword.quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.7}
    assert subword.quality(docs.limit(0), labels, F.lit(True)).count() == 0
    texts, y, _ = subword.labelled_sample(docs, labels, F.lit(True))
    assert list(zip(texts, y.tolist(), strict=True)) == [("good plain words here", 1), ("bad | | | |", 0), ("bad | | | |", 1), ("good plain words here", 1)]
