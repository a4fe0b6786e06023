"""Numbering by doubling and running sums against a recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import tree as trees


def walked(parents, key):
    children = {}
    for v, p in parents.items():
        children.setdefault(p, []).append(v)
    out = {}

    def visit(v, depth):
        at = len(out)
        out[v] = None
        below = sorted(children.get(v, []), key=lambda c: (key[c], c))
        tips = sum(visit(c, depth + 1) for c in below) if below else 1
        out[v] = (at, len(out) - at, depth, len(below), tips)
        return tips

    for root in children[None]:
        visit(root, 0)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star", "single"])
def test_numbers(spark, shape):
    rng = random.Random(5)
    n = {"random": 700, "chain": 150, "star": 400, "single": 1}[shape]
    ids = rng.sample(range(10_000), n)
    parents = {v: None if k == 0 else {"random": rng.choice(ids[:k]), "chain": ids[k - 1]}.get(shape, ids[0]) for k, v in enumerate(ids)}
    key = {v: rng.randint(0, 3) for v in ids}
    rows = [(v, p, key[v]) for v, p in parents.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, parent long, rank int")
    for by, keys in (("id", {v: v for v in ids}), ("rank", key)):
        t = trees.preorder(df, by)
        got = t.join(trees.metrics(t), "id").collect()
        want = walked(parents, keys)
        assert {r["id"]: (r["idx"], r["size"], r["depth"], r["child_count"], r["tip_count"]) for r in got} == want
        assert all(r["is_tip"] == (r["child_count"] == 0) and r["subtree_out"] == r["idx"] + r["size"] for r in got)


def test_cycles_are_refused_and_running_sums(spark):
    with pytest.raises(ValueError, match="cycle"):
        trees.preorder(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 5).alias("v"), (F.col("id") % 500 > 40).cast("int").alias("g"))
    for group in ([], ["g"]):
        totals = {}
        for r in sorted(trees.running(df, group, ["k"], "v").collect()):
            of = r["g"] if group else 0
            assert r["before"] == totals.get(of, 0)
            totals[of] = totals.get(of, 0) + r["v"]
