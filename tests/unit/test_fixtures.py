"""Operators on small inputs with answers worked by hand, and against naive twins."""

import random

import pytest
from pyspark.sql import functions as F

from treeline import catalogue
from treeline.functions import lit
from treeline.operators import ages, gates, paths, propagate, resolve, search, spelling, timescale
from treeline.operators import tree as trees
from treeline.plans import hierarchy
from treeline.sources import newick, turtle
from treeline.streaming import settle


def parsed(text):
    return list(newick.parse(text))


def built(spark, parents):
    t = spark.createDataFrame([(i, p) for i, p in enumerate(parents)], "id long, parent long")
    n = trees.preorder(trees.lineages(t))
    return n.join(trees.metrics(n), "id")


@pytest.mark.parametrize(
    ("text", "labels", "parents"),
    [("((A,B)X,C)Y;", "Y X A B C", [None, 0, 1, 1, 0]), ("(A,B,C)R;", "R A B C", [None, 0, 0, 0]), ("A;", "A", [None]), ("(((A)B)C)D;", "D C B A", [None, 0, 1, 2])],
)
def test_newick(text, labels, parents):
    got = parsed(text)
    assert [r[2] for r in got] == labels.split() and [r[1] for r in got] == parents


def test_newick_details():
    assert [r[2] for r in parsed("((A,B),C);")] == ["", "", "A", "B", "C"]
    assert [r[4] for r in parsed("((A:1.5,B:2)X:0.25,C:3)Y;")] == [None, 0.25, 1.5, 2, 3]
    ids = [newick.split_label(x)[1] for x in ("ott770315", "Homo_sapiens_ott770315", "mrcaott83926ott3607676", "", "Nameless")]
    assert ids == [770315, 770315, None, None, None]
    for bad in ("((A,B);", "(A,B));", "('A name',B)R;"):
        with pytest.raises(ValueError):
            parsed(bad)


def test_newick_files(spark, tmp_path):
    t = built(spark, [None, 0, 1, 1, 0, 4])
    up = t.select(F.col("id").alias("parent"), F.col("subtree_out").alias("p_out"))
    t = t.withColumn("label", F.concat(F.lit("n"), F.col("id").cast("string"))).join(up, "parent", "left").withColumn("is_last", F.col("subtree_out") == F.col("p_out"))
    newick.save(t, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert "".join(text.split()) == newick.write(t).first()["value"] == "((n2,n3)n1,(n5)n4)n0;"
    assert [(r[1], r[2]) for r in parsed(text)] == [(None, "n0"), (0, "n1"), (1, "n2"), (1, "n3"), (0, "n4"), (4, "n5")]


def test_numbers_against_naive(spark):
    rng = random.Random(5)
    parents = [None] + [rng.randrange(0, i) for i in range(1, 120)]
    kids = {i: [k for k, p in enumerate(parents) if p == i] for i in range(120)}
    order = []

    def walk(i, depth):
        order.append((i, len(order), depth))
        for k in kids[i]:
            walk(k, depth + 1)

    walk(0, 0)
    got = {r["id"]: (r["idx"], r["depth"]) for r in built(spark, parents).collect()}
    assert got == {i: (n, d) for i, n, d in order}


@pytest.mark.parametrize(
    ("chosen", "want"),
    [
        ([4], {4: (None, [])}),
        ([4, 5], {3: (None, []), 4: (3, []), 5: (3, [])}),
        ([4, 5, 7], {1: (None, []), 3: (1, [2]), 4: (3, []), 5: (3, []), 7: (1, [])}),
    ],
)
def test_induced_subtree(spark, chosen, want):
    # ((((A,B)C,D)E,F)G,H)R with R0 G1 E2 C3 A4 B5 D6 F7 H8
    t = built(spark, [None, 0, 1, 2, 3, 3, 2, 1, 0])
    out = paths.induced_subtree(t, spark.createDataFrame([(i,) for i in [*chosen, *chosen, 99]], "id long"))
    assert {r["id"]: (r["anc"], list(r["suppressed"])) for r in out.collect()} == want


def test_layout_fill(spark):
    t = built(spark, [None, 0, 1, 2])
    fill = lambda a: {r["id"]: round(r["age_layout"], 2) for r in ages.layout_fill(t, spark.createDataFrame(list(enumerate(a)), "id long, age double"), 4247.0).collect()}
    assert fill([100.0, None, None, 20.0]) == {0: 100, 1: 73.33, 2: 46.67, 3: 20}
    assert fill([50.0, 90.0, None, None])[1] == 50
    assert fill([None] * 4)[0] == 4247


def test_tiers(spark):
    t = built(spark, [None, 0, 1])
    m = spark.createDataFrame([(0, 100.0, "identical"), (1, 50.0, "identical"), (1, 50.0, "conflict"), (2, 96.0, "subset")], "id long, other_age double, class string")
    assert {r["id"]: (r["age"], r["tier"]) for r in ages.tiers(t, m).collect()} == {0: (100, 0), 1: (None, 2), 2: (96, 1)}


def test_nearest_drawn(spark):
    t = built(spark, [None, 0, 1, 2, 1, 0, 5, 5])
    seeds = spark.createDataFrame([(1, 10), (4, 11), (7, 12)], "id long, asset long")
    got = {r["id"]: (r["asset"], r["source"], r["clade"], r["climb"], r["method"]) for r in propagate.nearest_drawn(t, seeds).collect()}
    methods = "descendant exact ancestor ancestor exact descendant relative exact".split()
    want = zip([10, 10, 10, 10, 11, 12, 12, 12], [1, 1, 1, 1, 4, 7, 7, 7], [0, 1, 1, 1, 4, 5, 5, 7], [0, 0, 1, 2, 0, 0, 1, 0], methods, strict=True)
    assert got == dict(enumerate(want))


def test_attach(spark):
    facts = spark.createDataFrame([(4, 3, 4), (3, 2, 3), (2, 1, 2), (1, None, 1), (8, 9, 8), (9, 8, 9)], "id long, parent_id long, accepted_id long")
    got = {r["id"]: (r["idx"], r["walk"], r["via"]) for r in resolve.attach(facts, spark.createDataFrame([(1, 70, 2)], "id long, idx long, method long")).collect()}
    assert [got[i] for i in (4, 3, 2, 1)] == [(70, 3, 1), (70, 2, 1), (70, 1, 1), (70, 0, 1)]
    assert got[8] == (0, 2, None)


def test_young_ends(spark):
    rows = [(1, None, 0, 150.0, 120.0, 93.9, 86, None)] + [(i, 1, 1, 160.0, 150.0, 143.1, 5, None) for i in range(2, 6)]
    rows += [(11, None, 0, 1700.0, 1650.0, 1600.0, 1, None), (12, 11, 1, 1700.0, 10.0, 5.333, 1, None)]
    got = {r["id"]: r for r in propagate.young_ends(spark.createDataFrame(rows, "id long, parent_id long, level long, fea double, lea double, lla double, n_occs long, flags string")).collect()}
    assert not got[1]["unwitnessed"] and got[1]["lla_drawn"] == 93.9
    assert got[11]["unwitnessed"] and got[11]["refused_sparse"] and got[11]["lla_drawn"] == 1600.0


def naive_young_ends(facts):
    """id -> (identified, end_occs, lla_drawn, lea_drawn, clamped), a fact at a time, children first."""
    kids, out, below = {}, {}, {}
    for f in facts:
        kids.setdefault(f["parent_id"], []).append(f)
    for f in sorted(facts, key=lambda f: -f["level"]):
        mine = kids.get(f["id"], [])
        own = max(0, f["n_occs"] - sum(k["n_occs"] for k in mine))
        ends = sorted((below[k["id"]][0], k["id"], *below[k["id"]][1:]) for k in mine if below[k["id"]][0] is not None)
        end, end_lea = (ends[0][0], ends[0][2]) if ends else (None, None)
        n_at = sum(e[3] for e in ends if e[0] == end) if ends else None
        lla = f["lla"]
        unseen = None not in (end, lla) and end < lla
        clamp = unseen and not {"I", "F"} & set(f["flags"] or "") and n_at >= 5 and end <= f["fea"]
        drawn = end if clamp else lla
        low = min([x for x in (drawn, end if clamp or lla is None else None) if x is not None], default=None)
        below[f["id"]] = (low, f["lea"] if low is not None and low == lla else end_lea, (own if None not in (lla, low) and lla == low else 0) + (n_at if None not in (end, low) and end == low else 0))
        out[f["id"]] = (end if unseen else None, n_at if unseen else None, drawn, end_lea if clamp else f["lea"], clamp)
    return out


def test_young_ends_of_the_whole_table(spark, tmp_path):
    spark.range(12_500).selectExpr("id AS p_partkey", "id * 7919 % 50 + 1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    facts = [r.asDict() for r in hierarchy.rows(spark, str(tmp_path), hierarchy.ENDS).collect()]
    got = hierarchy.QUERIES["young_ends"](spark, str(tmp_path)).collect()
    assert len(got) == len(facts) == 12_500 and max(f["level"] for f in facts) == 4
    assert {r["id"]: (r["identified"], r["end_occs"], r["lla_drawn"], r["lea_drawn"], r["clamped"]) for r in got} == naive_young_ends(facts)


def test_sibling_distance_against_all_pairs(spark):
    rng = random.Random(8)
    place = lambda m, r: tuple(m[k] + rng.uniform(-r, r) for k in range(3))
    groups = {
        1: [place((0.5, 0, 0), 0.3) for _ in range(300)],
        2: [place((0.5, 0, 0), 0.001) for _ in range(200)] + [place((0.1, 0.2, -0.2), 0.2) for _ in range(20)],
        3: [place((0.5, 0, 0), 0.3) for _ in range(20)] + [(0.25, 0.1, 0.1)] * 2,
        4: [(1.0, 0.0, 0.0), (0.0, 0.3, -0.3)],
        5: [(0.1, 0.1, 0.1)],
        6: [(0.2, 0.0, 0.0), (0.2 + 1e-7, 0.0, 0.0), (0.9, 0.0, 0.0)],
        7: [(-0.001, 0.001, 0.5), (0.001, -0.001, 0.5)],
        8: [(k / 64, 0.0, 0.0) for k in range(64)],
    }
    rows = [(p * 1000 + k, p, *x) for p, xs in groups.items() for k, x in enumerate(xs)]
    want = {p: round(min(sum((u - v) ** 2 for u, v in zip(x, y)) ** 0.5 for i, x in enumerate(xs) for y in xs[:i]), 6) for p, xs in groups.items() if len(xs) > 1}
    got = timescale.sibling_distance(spark.createDataFrame(rows, "id long, parent long, l double, a double, b double")).collect()
    assert {r["parent"]: r["least"] for r in got} == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("name", "cut"), [("forward_closure", "p_partkey < 300"), ("mrca", "c_custkey % 5 = 1"), ("seed_cascade", "c_custkey % 7 = 0"), ("rank_fallback", "p_partkey % 40 = 1"), ("homonym_agreement", "c_custkey % 60 = 7"), ("sibling_colours", "id < 150"), ("young_ends", "BETWEEN 1 AND 999")])
def test_whole_inputs(name, cut):
    assert cut not in catalogue.ORACLES[name] and name in catalogue.QUERIES


def test_forwards_of_the_whole_table(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {r["old"]: r["new"] for r in hierarchy.QUERIES["forward_closure"](spark, str(tmp_path)).collect()}
    want = {}
    for old in range(1000):
        seen = [old]
        while (to := (seen[-1] * 7 + 3) % 400) not in seen:
            seen.append(to)
        if len(seen) > 1:
            want[old] = seen[-1]
    assert got == want and max(got) == 999


def test_match_band(spark):
    cases = [("dog family", "dog", 1), ("dogbane family", "dog", 3), ("mackerel sharks", "shark", 1), ("butterfly orchid", "butterfly", 2), ("Oak moss", "oak", 2), ("Sessile Oak", "oak", 1), ("goes nowhere", "go", 3), ("Homo sapiens", "homo sap", 3), ("Can-opener Smoothdream", "can", 3), ("", "dog", 4)]
    df = spark.createDataFrame(cases, "name string, q string, want long")
    assert df.select(search.match_band(F.col("name"), F.col("q")).alias("b"), "want", "name").where("b <> want").collect() == []


def test_abbreviation(spark):
    df = spark.createDataFrame([("Tyrannosaurus rex", "T. rex"), ("Canis lupus familiaris", "C. l. familiaris"), ("Mammalia", None), ("T. rex", None)], "name string, want string")
    assert df.where(~search.abbreviation(F.col("name")).eqNullSafe(F.col("want"))).collect() == []


def test_spelling(spark):
    df = spark.createDataFrame([("aardvark", "ardvrk"), ("ardvark", "ardvrk"), ("dolphin", "dlfn"), ("dolfin", "dlfn")], "w string, k string")
    assert df.where(spelling.phonetic(F.col("w")) != F.col("k")).collect() == []
    pairs = spark.createDataFrame([("betual", "betula", 1), ("ca", "abc", 3), ("abc", "", 3), ("", "ab", 2), ("kitten", "sitting", 3)], "a string, b string, d long")
    assert [r for r in pairs.select("d", spelling.osa(F.col("a"), F.col("b")).alias("x")).collect() if r["d"] != r["x"]] == []
    names = spark.createDataFrame([("betula pendula",), ("betula nana",), ("dolphin",)], "name string")
    asked = spark.createDataFrame([("betual nana",), ("dolfin",), ("betula",), ("dog",)], "query string")
    assert {r["query"]: r["fixed"] for r in spelling.correct_queries(asked, spelling.index(names)).collect()} == {"betual nana": "betula nana", "dolfin": "dolphin"}


def test_settle():
    run = lambda *w: [q for _, q in settle.settle_words([(0.5 * i, x) for i, x in enumerate(w)])]
    assert run("do", "dog") == ["dog"] and run("do", "dog", "dogs", "dog") == ["dogs"] and run("dog", "cat") == ["dog", "cat"] and run("d") == []
    assert settle.settle_words([(0, "dog"), (9, "dog")]) == [(0, "dog")]


def test_gates(spark, tmp_path):
    g = gates.Gates("p")
    df = spark.range(3)
    g.rules(df, {"positive": F.col("id") > 0})
    assert g.failures == ["positive"] and '"failed"' in g.report()
    with pytest.raises(ValueError):
        g.publish(df, str(tmp_path / "x"))
    out = gates.package(spark, [g.report(), "{"], {"t": df})
    assert set(out.failures) == {"phase_p", "report_readable"}


def test_banded_distance(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abch") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    pairs = [(a, b, c) for a, b, c in zip(words, words[1:], [1, 2] * 200, strict=False)]
    pairs += [(a, a[:k] + a[k + 1 : k + 2] + a[k : k + 1] + a[k + 2 :], c) for a, k, c in zip(words, [0, 1, 2, 3] * 100, [1, 2] * 200, strict=True)]
    df = spark.createDataFrame(pairs, "a string, b string, cap int")
    got = df.select("cap", spelling.osa(F.col("a"), F.col("b")).alias("full"), spelling.within(F.col("a"), F.col("b"), F.col("cap")).alias("banded")).collect()
    assert all(r["banded"] == r["full"] if r["full"] <= r["cap"] else r["banded"] > r["cap"] for r in got) and sum(r["full"] <= r["cap"] for r in got) > 100


def test_lengths_four_apart_are_corrected(spark):
    idx = spelling.index(spark.createDataFrame([("phosphorescence",)], "name string"))
    asked = spark.createDataFrame([("fosforescnc",)], "word string")
    assert [tuple(r) for r in spelling.correct_words(asked, idx).collect()] == [("fosforescnc", "phosphorescence")]


def test_drift_over_many_siblings(spark):
    rng = random.Random(1)
    rows = [(i, 0, *(rng.random() for _ in range(6))) for i in range(200)] + [(1000, 1, *[0.5] * 6), (2000, 2, *[0.5] * 6), (2001, 2, *[0.5] * 6)]
    got = {r["parent"]: r["drift"] for r in timescale.sibling_drift(spark.createDataFrame(rows, "id long, parent long, l double, a double, b double, dl double, da double, db double")).collect()}
    own = [r[2:] for r in rows[:200]]
    dist = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) ** 0.5
    want = max(abs(dist(x[3:], y[3:]) - timescale.DIM_K * dist(x[:3], y[:3])) for x in own for y in own)
    assert got == {0: round(want, 6), 2: 0.0}


def test_turtle_and_figures(spark):
    text = '@prefix g: <http://g/> .\ng:a a g:Age ; g:label "Erste"@de , "First"@en ; g:note """long "text" here""" ; g:begin [ g:value 538.8 ; g:error "0.6"^^g:d ] .'
    got = list(turtle.parse(text))
    assert ("http://g/a", turtle.TYPE, "http://g/Age", "iri", None, None) in got and ("_:b1", "http://g/value", "538.8", "number", None, None) in got
    assert any(r[2] == 'long "text" here' for r in got)
    assert spark.range(1).select(lit(F.lit("Sharks and shark"), F.lit("shark")).alias("r")).first()["r"] == "0-6,11-16"
    assert timescale.ticks(0, 100, 5, 5, lambda x: x)[:3] == [0, 10, 20]


def test_forward_cycles(spark):
    f = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (7, 8), (8, 7)], "old long, new long")
    assert {r["old"]: r["new"] for r in trees.forward_closure(f).collect()} == {1: 3, 2: 3, 7: 8, 8: 7}
