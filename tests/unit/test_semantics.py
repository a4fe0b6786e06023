"""Rules on small inputs with answers worked by hand."""

import random

import pytest
from pyspark.sql import functions as F

from treeline import phases
from treeline.functions import fuzzy, lit
from treeline.operators import ages, gates, layout, names, paths, propagate, resolve, search, serving
from treeline.operators import tree as trees
from treeline.streaming import ingest


def numbered(spark, parents):
    t = trees.preorder(trees.lineages(spark.createDataFrame(list(enumerate(parents)), "id long, parent long")))
    return t.join(trees.metrics(t), "id")


def test_congruence(spark):
    # ours ((a,b)X,(c,d)Y)R; theirs ((a,b)X,(c,e)Y,d)R: X identical, Y against theirs' Y in conflict, R identical
    ours = numbered(spark, [None, 0, 0, 1, 1, 2, 2])  # 0 R, 1 X, 2 Y, 3 a, 4 b, 5 c, 6 d
    theirs = numbered(spark, [None, 0, 0, 1, 1, 2, 2, 0])  # 0 R, 1 X, 2 Y, 3 a, 4 b, 5 c, 6 e, 7 d
    pairs = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 7)]
    got = lambda p: {r["id"]: (r["shared"], r["class"]) for r in ages.congruence(ours, theirs, spark.createDataFrame(p, "id long, other long")).collect()}
    assert got(pairs) == {0: (4, "identical"), 1: (2, "identical"), 2: (2, "conflict")}
    # X matched with the whole of theirs: contained, so a subset
    assert got([(1, 0) if p == (1, 1) else p for p in pairs if p != (0, 0)])[1] == (2, "subset")


@pytest.mark.parametrize(
    ("query", "name", "score", "ranges"),
    [
        ("cat", "cat", 1700, "0-3"),
        ("cat", "a cat", 1298, "2-5"),
        ("cat", "concatenate", 997, "3-6"),
        ("hs", "homo sapiens", 10 + 10 - 4 - 1, "0-1,5-6"),
        ("ab", "a-b", 10 + 10 - 1, "0-1,2-3"),
        ("zz", "cat", None, None),
        ("", "cat", 0, ""),
    ],
)
def test_fuzzy(spark, query, name, score, ranges):
    row = spark.createDataFrame([(name, query)], "n string, q string").select(fuzzy("n", "q").alias("m")).select("m.*").first()
    assert (row["score"], row["ranges"]) == (score, ranges)


def test_match_parts(spark):
    assert spark.range(1).select(fuzzy(F.lit("h_o_m"), F.lit("hom")).alias("m")).first()["m"]["score"] == 10 + (10 - 1) + (10 - 1)
    pairs = [("swallowtail butterflies", "butterfly", "12-23"), ("goes", "go", "0-2"), ("x", " ", ""), ("Banana", "an", "1-5"), ("Homo sapiens", "homo sapiens", "0-4,5-12"), ("a-b-c", "abc", ""), ("aaa", "aa", "0-2"), ("Bamboo sharks", "shark", "7-13"), (None, "x", ""), ("x.*(y", ".*(", "1-4")]
    got = spark.createDataFrame(pairs, "n string, q string, r string").select(lit("n", "q").alias("told"), "r").collect()
    assert all(r["told"] == r["r"] for r in got)
    assert spark.sql("SELECT fuzzy('Homo sapiens', 'HOMO').score AS s, match_band('Tyrannosaurus rex', 'rex') AS b, lit('Sharks', 'shark') AS l").first() == (1700.0, 1, "0-6")


def plain_match(name, query):
    """The rule letter by letter: streaks, starts and gaps."""
    h, n = name.lower(), query.lower()
    starts = lambda k: k == 0 or h[k - 1] in " ._-"
    if n in h:
        k = h.index(n)
        return 1000 - k + 300 * starts(k) + 400 * (k == 0)
    places = []
    for c in n:
        k = h.find(c, places[-1] + 1 if places else 0)
        if k < 0:
            return None
        places.append(k)
    total, streak = 0, 0
    for i, k in enumerate(places):
        streak = streak + 1 if i and k == places[i - 1] + 1 else 0
        total += 12 + 4 * streak if streak else (10 if starts(k) else 2) - min(k - (places[i - 1] + 1 if i else 0), 12)
    return total - len(h) // 12


def test_fuzzy_equals_the_rule(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc .-") for _ in range(rng.randint(1, 40))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))) for _ in range(400)]
    got = spark.createDataFrame(pairs, "n string, q string").select("n", "q", fuzzy("n", "q").alias("m")).collect()
    assert all((r["m"]["score"] if r["m"] else None) == plain_match(r["n"], r["q"]) for r in got)


def test_folding(spark):
    index = search.postings(spark.createDataFrame([(1, "Café-Ñandú Öl"), (2, "Việt ĂČ"), (3, "O'Neil")], "id long, name string"))
    assert [r["id"] for r in search.matching(index, "CAFE").collect()] == [1] and [r["id"] for r in search.matching(index, "café nandu").collect()] == [1]
    assert [r["id"] for r in search.matching(index, "viet ac").collect()] == [2] and [r["id"] for r in search.matching(index, "o'neil").collect()] == [3]
    assert search.matching(index, "'--").count() == 0


def test_shape(spark):
    cases = [("Felidae", "Felis", 2, False), ("the cat", "Felis", 1, False), ("cats (big),", "Felis", 5, False), ("T-Rex", "Tyrannosaurus rex", 1, False), ("T. rex", "Tyrannosaurus rex", 0, False), ("big cat of the woods", "Felis", 1, False), ("lepidopteran", "Lepidoptera", 0, True), ("a Lepido", "Lepidoptera", 1, False), ("éléphant", "Elephas", 0, True)]
    df = spark.createDataFrame(cases, "name string, sci string, shape long, stem boolean")
    got = df.select("name", "shape", "stem", names.shape(F.col("name"), F.col("sci")).alias("s"), names.stem_shared(F.col("name"), F.col("sci")).alias("t")).collect()
    assert [(r["name"], r["s"], r["t"]) for r in got] == [(n, p, t) for n, _, p, t in cases]


def test_boost_of_a_date_to_come(spark):
    row = spark.range(1).select(search.boost(F.lit(3), F.lit(-400)).alias("a"), search.boost(F.lit(3), F.lit(0)).alias("b"), search.boost(F.lit(99), F.lit(21)).alias("c")).first()
    assert row["a"] == row["b"] == 3 * 14 + 40 and row["c"] == 12 * 14 / 2 + 20


def test_picture_of_a_tree_without_seeds(spark):
    t = numbered(spark, [None, 0])
    got = propagate.nearest_drawn(t, spark.createDataFrame([], "id long, asset long")).collect()
    assert [(r["id"], r["method"], r["asset"]) for r in sorted(got)] == [(0, "none", None), (1, "none", None)]


def test_witness_filters(spark):
    t = numbered(spark, [None, 0, 0])
    a = spark.createDataFrame([(0, 100.0, 100.0), (1, None, 1.0), (2, None, 1.0)], "id long, age double, age_layout double")
    facts = spark.createDataFrame([(7, 1, 0, 5, True, True, 90.0, 80.0), (8, 1, 1, 5, True, True, 101.0, 99.0)], "fact long, attach long, walk long, n_occs long, is_primary boolean, is_extinct boolean, oldest double, youngest double")
    none = spark.createDataFrame([], "id long")
    got = lambda **k: [tuple(r) for r in propagate.witness(t, a, facts, none, **k).collect()]
    assert got() == [(0, 8, 0.0)] and got(drawn=facts.where("fact = 7")) == [(0, 7, 10.0)] and got(drawn=facts.where("fact = 7"), near=0.05) == []


def test_batches_of_paths(spark):
    t = numbered(spark, [None, 0, 1])
    n = spark.createDataFrame([("a", 2)], "ext string, id long")
    f = spark.createDataFrame([("old", "a")], "old string, new string")
    ask = lambda keys: paths.batch_paths(t, spark.createDataFrame([(k,) for k in keys], "key string"), n, f, n.limit(0))
    assert {r["key"]: (r["status"], r["path"]) for r in ask(["a", "old", "x"]).collect()} == {"a": ("node", [0, 1, 2]), "old": ("forwarded", [0, 1, 2]), "x": ("unknown", None)}
    with pytest.raises(ValueError, match="200"):
        ask([str(k) for k in range(201)])


def test_manual_reason(spark):
    c = spark.createDataFrame([("s", "1", 5, "name_exact", 1)], "source string, source_id string, idx long, method string, input_pos long")
    m = lambda why: spark.createDataFrame([("s", "1", None, why)], "source string, source_id string, idx long, reason string")
    assert [tuple(r) for r in resolve.precedence(resolve.with_manual(c, m("wrong"))).collect()] == [("s", "1", None, "manual")]
    with pytest.raises(ValueError, match="reason"):
        resolve.with_manual(c, m(" "))


def test_queue_and_batches():
    q = ingest.DrawQueue()
    told = [q.hear(*x) for x in [("ask", "a"), ("ask", "b"), ("ask", "a"), ("arrive", "b"), ("arrive", "a"), ("done", None), ("ask", "c"), ("done", None), ("ask", "d"), ("flush", None), ("arrive", "e")]]
    assert told == [[], [], [], [], ["a"], ["b"], [], [], [], ["c", "d"], []]
    assert ingest.plan(["a", "b", "c"]) == (["a"], ["b", "c"]) and ingest.plan(["a", "b"], True) == (["a", "b"], []) and ingest.plan([]) == ([], [])
    assert ingest.batches([0, 1, 2.9, 3.1, 3.2, 9], most=3) == [0, 0, 0, 1, 1, 2]


def test_lane_and_licences(spark):
    rows = [(1, f"n{k:02}", k, k < 10) for k in range(17)]
    got = layout.lane(spark.createDataFrame(rows, "g long, name string, o long, dated boolean"), "g", ["o"], F.col("dated")).first()
    assert (got["shown"], got["total"], got["listed"]) == (15, 17, "n10, n11, n12, n13, n14 and 2 more") and got["placed"].endswith("n07")
    assert serving.brightness(F.lit(0)) is not None and propagate.shown_asset(F.lit("leaf"), F.lit(1), F.lit(2)) is not None


def test_package_gates(spark):
    a, b = spark.range(3), spark.range(1, 4)
    g = gates.package(spark, ['{"phase": "x", "failed": []}', "{"], {"a": a, "b": b}, [("a", "b", "id")], {"a": 5})
    assert set(g.failures) == {"report_readable", "keys_a_b", "rows_a"}


def test_phases(spark, tmp_path):
    b = phases.Build(spark, "/root/testdata/sf0.001", str(tmp_path))
    with pytest.raises(ValueError, match="needs tree"):
        phases.run(b, "ages")
    assert all(phases.run(b, p) for p in phases.PHASES)
    assert not any(phases.run(b, p) for p in phases.PHASES)
    assert b.read("postings").count() > 0 and "build_id" in b.report("package")


def test_rebuild_never_compounds(spark, tmp_path):
    first = ages.rebuild(spark.range(3).withColumn("age", F.lit(1.0)), str(tmp_path), "ages", "2")
    for _ in range(2):
        again = ages.rebuild(first.withColumn("age", F.col("age") * 2), str(tmp_path), "ages", "4")
    assert {r["age"] for r in again.collect()} == {2.0}
