"""Folds by layers against walks on small trees, and operators that no longer grow with groups."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import ages, paths, propagate, resolve
from treeline.operators import tree as trees
from treeline.plans import inputs, served


def shaped(shape, n, rng):
    """Parents of nodes 0.. : a random tree, a chain with a leaf at every node, or one hub."""
    return [None] + [{"random": rng.randrange(i), "comb": (i - 1) if i % 2 else max(i - 3, 0), "hub": 0}[shape] for i in range(1, n)]


def lines(parents):
    out = []
    for v in range(len(parents)):
        at, line = v, []
        while at is not None:
            line.append(at)
            at = parents[at]
        out.append(line)
    return out


@pytest.fixture(scope="module", params=["random", "comb", "hub"])
def grown(request, spark):
    rng = random.Random(3)
    parents = shaped(request.param, 90, rng)
    t = trees.numbered(spark.createDataFrame(list(enumerate(parents)), "id long, parent long")).cache()
    return parents, lines(parents), t, rng


def test_lineages(grown):
    _, above, t, _ = grown
    assert {r["id"]: r["lineage"] for r in trees.lineages(t).collect()} == dict(enumerate(above))


def test_layers_are_few(grown):
    parents, above, t, _ = grown
    tips = set(range(len(parents))) - set(parents)
    got = {r["id"]: r for r in t.collect()}
    assert all((r["layer"] == 0) == (v in tips) and r["depth"] == len(above[v]) - 1 for v, r in got.items())


def test_node_ages(grown, spark):
    parents, above, t, rng = grown
    length = {v: rng.randrange(9) + 0.5 for v in range(len(parents)) if v % 7}
    d = [sum(length.get(a, 0.0) for a in line) for line in above]
    tips = set(range(len(parents))) - set(parents)
    below = [[d[x] for x in tips if v in above[x]] for v in range(len(parents))]
    got = {r["id"]: (r["oldest"], r["youngest"]) for r in ages.node_ages(t, spark.createDataFrame(list(length.items()), "id long, length double")).collect()}
    assert got == {v: (max(b) - d[v], min(b) - d[v]) for v, b in enumerate(below)}


def test_nearest_drawn_and_bounds(grown, spark):
    parents, above, t, rng = grown
    seeds = {v: 100 + v for v in rng.sample(range(1, 90), 9)}
    info = {r["id"]: r for r in t.collect()}
    best = {}
    for v in range(90):
        below = [x for x in seeds if v in above[x]]
        if below:
            best[v] = min(below, key=lambda x: (-info[x]["tip_count"], info[x]["depth"], x))
    want = {}
    for v, line in enumerate(above):
        clade = v if v in seeds else next(a for a in line if a in best)
        source = v if v in seeds else best[clade]
        method = "exact" if v == source else "ancestor" if source in line else "descendant" if v in above[source] else "relative"
        want[v] = (seeds[source], source, clade, line.index(clade), method, info[clade]["tip_count"])
    s = spark.createDataFrame(list(seeds.items()), "id long, asset long")
    got = propagate.nearest_drawn(t, s, claims=True)
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want
    assert {r["id"]: r["source"] for r in propagate.exemplars(t, s).collect()} == best
    dated = spark.createDataFrame([(v, 1.0) for v in range(90) if v % 11 == 5], "id long, age double")
    low = {v: max(seeds[x] for x in seeds if v in above[x]) for v in best if not any(v in above[x] for x in range(90) if x % 11 == 5)}
    bounds = spark.createDataFrame([(v, float(a)) for v, a in seeds.items()], "id long, bound double")
    found = ages.bound_propagation(t, bounds, dated)
    assert {r["id"]: r["bound"] for r in found.collect()} == low
    layout = spark.createDataFrame([(v, 150.0 - len(above[v])) for v in range(90)], "id long, age_layout double")
    wish = {v: max(150.0 - len(above[v]), low.get(v, 0.0)) for v in range(90)}
    least = {v: min(wish[a] for a in above[v]) for v in range(90)}
    assert {r["id"]: (r["age_layout"], r["short"]) for r in ages.bound_layout(t, layout, found).collect()} == {v: (x, x < low.get(v, 0.0)) for v, x in least.items()}


def test_spread_and_common_ancestor(grown, spark):
    parents, above, t, rng = grown
    age = {v: float(rng.randrange(50)) for v in range(90) if v % 4 == 1}
    a = spark.createDataFrame([(v, age.get(v)) for v in range(90)], "id long, age double")
    want = {}
    for v, line in enumerate(above):
        if v not in age:
            up = [(k, age[x]) for k, x in enumerate(line) if x in age]
            below = [age[x] for x in age if v in above[x] and age[x] > 0]
            want[v] = (up[0][1] if up else None, up[0][0] if up else None, max(below, default=None))
    assert {r["id"]: (r["above"], r["above_hops"], r["below"]) for r in paths.layout_spread(t, a).collect()} == want
    groups = [(k, v) for k in range(12) for v in rng.sample(range(90), 1 + k % 4)] + [(20, 3), (20, 999)]
    mrca = {k: next(x for x in above[next(v for g, v in groups if g == k)] if all(x in above[v] for g, v in groups if g == k)) for k in range(12)}
    got = paths.common_ancestor(trees.lineages(t), spark.createDataFrame(groups, "grp long, id long"), "grp")
    assert {r["grp"]: r["mrca"] for r in got.collect()} == mrca


def test_names_of_many_taxa_stay_in_proportion(spark):
    """2,000 taxa share a name that 2,000 titles ask for: no 4,000,000 pairs, and the cited one is meant."""
    taxa = spark.range(1, 2001).select(F.col("id").alias("ext"), F.lit(None).cast("long").alias("parent"), F.lit("g").alias("name"), F.array("id").alias("lineage"))
    nodes = spark.createDataFrame([(7, 70, 5)], "ext long, node long, tips long")
    cited = spark.createDataFrame([(1, 7), (2, 7), (3, 9)], "asset long, ext long")
    nodes9 = nodes.unionByName(spark.createDataFrame([(11, 110, 5)], "ext long, node long, tips long"))
    moved = spark.createDataFrame([(9, 11)], "old long, new long")
    titles = spark.range(1, 2001).select(F.col("id").alias("asset"), F.lit("g").alias("title"))
    got = resolve.seed_passes(nodes9, cited, moved, taxa, titles)
    assert sorted(tuple(r) for r in got.collect()) == [(70, 1, 0), (70, 2, 0), (110, 3, 1)]
    assert "count(distinct ext" in got._jdf.queryExecution().optimizedPlan().toString()  # names are counted before titles meet them


def test_lineages_beside_the_taxonomy(spark):
    """Names don't travel with the lineages, and of a name's taxa two meet the count of distinct ones."""
    taxa = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "b"), (4, 1, "c"), (4, 1, "c"), (5, 3, "d")], "ext long, parent long, name string")
    lines = spark.createDataFrame([(1, [1]), (2, [2, 1]), (3, [3, 2, 1]), (4, [4, 1]), (5, [5, 3, 2, 1])], "ext long, lineage array<long>")
    nodes = spark.createDataFrame([(2, 20, 5), (4, 40, 500)], "ext long, node long, tips long")
    cited = spark.createDataFrame([(1, 2), (2, 1), (3, 5)], "asset long, ext long")
    moved = spark.createDataFrame([(9, 2)], "old long, new long")
    titles = spark.createDataFrame([(2, "c"), (3, "b"), (4, "b"), (5, "c x"), (6, "c")], "asset long, title string")
    got = resolve.seed_passes(nodes, cited, moved, taxa, titles, lines=lines)
    assert sorted(tuple(r) for r in got.collect()) == [(20, 1, 0), (40, 2, 3), (40, 6, 3)]
    assert sorted(tuple(r) for r in resolve.seed_passes(nodes, cited, moved, taxa.join(lines, "ext"), titles).collect()) == [(20, 1, 0), (40, 2, 3), (40, 6, 3)]
    assert "array(min(ext" in got._jdf.queryExecution().optimizedPlan().toString()


def test_time_scale_builds_no_search_tables(spark, sf, monkeypatch):
    monkeypatch.setattr(inputs, "_made", {})
    assert served.QUERIES["served_timescale"](spark, sf).count() > 0
    assert not {name for _, _, name in inputs._made} & {"terms", "hot", "served"}


def test_tasks_follow_rows(grown, spark, monkeypatch):
    """More tasks, not larger ones: with 20 rows a task the tree is the same, and is sorted in five ranges."""
    from treeline import runtime

    parents, above, t, rng = grown
    plain = t.select("id", "parent")
    want = {r["id"]: (r["idx"], r["size"], r["depth"]) for r in trees.numbered(plain).collect()}
    monkeypatch.setattr(runtime, "TASK_ROWS", 20)
    assert {r["id"]: (r["idx"], r["size"], r["depth"]) for r in trees.numbered(plain).collect()} == want
    sums = trees.running(t.select("id", "idx", F.lit(1).cast("long").alias("one")), [], ["idx"], "one")
    assert {r["id"]: r["before"] for r in sums.collect()} == {r["id"]: r["idx"] for r in t.collect()}
    assert runtime.tasks(90) == 5
