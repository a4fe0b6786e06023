"""The SQL functions, the term index and the hot names on small inputs."""

import itertools
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from treeline import serve
from treeline.operators import search, term_index

WORDS = ["small", "smart", "smalls", "widget", "widow", "été", "42nd", "4", "x", "bolt-on", "Ñandú", "über"]


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(7)
    rows = [(k, k % 150, k % 4, " ".join(rng.choice(WORDS).title() if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(rng.randint(1, 4))), k % 9 == 0) for k in range(600)]
    return spark.createDataFrame(rows, "id long, idx long, kind long, name string, title boolean")


@pytest.fixture(scope="module")
def terms(names, tmp_path_factory):
    return term_index.save(names, str(tmp_path_factory.mktemp("index") / "terms"))


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["all_tokens", "phrase"])
def test_pruned_answers_are_the_same(spark, names, terms, mode):
    whole = search.postings(names)
    for query in ["small wid", "x", "4", "42", "ete sm", "bolt on", "Ñandu", "zzz", "", "w s", "smalls small x"]:
        want = sorted(r["id"] for r in search.matching(whole, query, mode).collect())
        assert sorted(r["id"] for r in search.matching(term_index.pruned(terms, query), query, mode).collect()) == want, query


def test_a_query_reads_its_folders(terms):
    some = term_index.pruned(terms, "small wid")
    assert {re.search("bucket=([^/]*)/", r[0])[1] for r in some.select(F.input_file_name()).distinct().collect()} == {"sm", "wi"}
    plan = explained(some.select("id"))
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and "GreaterThanOrEqual(term,small)" in plan
    folders = {r["bucket"] for r in terms.select("bucket").distinct().collect()}
    assert {"42", "4", "sm", "wi"} <= folders and terms.schema["bucket"].dataType.simpleString() == "string"
    for row in terms.select("term", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("term").alias("t")).collect():
        assert row["t"] == sorted(row["t"])


def test_hot_names_equal_the_scan(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abAB") for _ in range(rng.randint(1, 6))), rng.choice([1, 2, 3, 50, 900])) for k in range(800)] + [(900, None, 10**6), (901, "", 10**5)]
    nodes = spark.createDataFrame(rows, "idx long, name string, tips long")
    hot = term_index.hot_names(nodes, 300)
    assert hot.count() == 300 and hot.agg(F.min("tips")).first()[0] >= 1
    skipped = 0
    for query in ["".join(p) for n in (1, 2) for p in itertools.product("abAc", repeat=n)] + [""]:
        got, scanned = term_index.prefix_hot(hot, nodes, query, 20)
        assert {r["idx"] for r in got.collect()} == {r["idx"] for r in search.prefix_top(nodes, query, 20).collect()}, query
        skipped += len(search.spellings(query)) - len(scanned)
    assert skipped > 5


def test_search_as_sql(spark, names, terms):
    rng = random.Random(1)
    nodes = [(k, f"k{k}", names_of, "species" if k % 3 else "genus", k // 3 if k else None, rng.choice([1, 2, 400]), "Small widgets" if k % 7 == 0 else None, f"Q{k}", [k], rng.random(), k % 2 == 0, k % 5 == 0) for k, names_of in enumerate(rng.choices(WORDS, k=150))]
    nodes = spark.createDataFrame(nodes, "idx long, key string, name string, rank string, parent long, tips long, headline string, page string, lineage array<long>, score double, has_image boolean, measured boolean")
    facts = spark.createDataFrame([(1, "small", 3, 1, True, 4, 9), (2, "small widget", 3, 0, True, 0, 1), (3, "Widget small", 4, 2, True, 0, 1), (4, "small", 5, 1, True, 2, 9)], "fact long, name string, attach long, walk long, is_primary boolean, penalty long, n_occs long")
    broken = spark.createDataFrame([("b1", "Small"), ("b2", "other")], "key string, name string")
    serve.serve(spark, nodes=nodes, names=names, terms=terms, facts=facts, broken=broken)
    got = spark.sql("EXECUTE IMMEDIATE search_rows USING '  small ' AS q, 10 AS n").collect()
    rows = sorted((r for r in got if r["corpus"] == 0), key=lambda r: r["pos"])
    assert len(rows) == 10 and [r["pos"] for r in rows] == list(range(1, 11)) and [r["band"] for r in rows] == sorted(r["band"] for r in rows)
    assert [(r["key"], r["place"]) for r in rows if r["key"] == "b1"] == [("b1", None)]
    assert sorted(r["place"] for r in got if r["place"]) == list(range(1, len(got)))
    assert [r["fact"] for r in sorted((r for r in got if r["corpus"] == 1), key=lambda r: r["pos"])] == [4, 3]  # one a name, the notable one; walk 0 is a node's own
    merged = sorted((r for r in got if r["place"]), key=lambda r: r["place"])
    assert [r["band"] for r in merged] == sorted(r["band"] for r in merged)
    for odd in ["", " ", "zzzzzz", "'\"%\\", "(", "é"]:
        spark.sql(serve.SEARCH, args={"q": odd, "n": 0}).collect()
    assert spark.sql("SELECT * FROM hits(array('k3', 'b1', 'k3', 'k1'))").count() == 2
    assert spark.sql("SELECT rows FROM about() WHERE name = 'broken'").first()[0] == 2
    assert spark.sql("SELECT * FROM segment(5, 1)").count() == 0


def test_another_spelling(spark, names, terms):
    serve.serve(spark, names=names.where("name NOT LIKE '%Widow%'"), terms=terms, nodes=spark.createDataFrame([(k, f"k{k}", "none", "r", None, 5, None, None, [k], 1.0, False, False) for k in range(150)], "idx long, key string, name string, rank string, parent long, tips long, headline string, page string, lineage array<long>, score double, has_image boolean, measured boolean"))
    answer, told = serve.search(spark, "wiidget", 5)
    assert told == {"corrected": "widget"} and answer.count() == 5
    assert serve.search(spark, "widget", 5)[1] == {} and serve.search(spark, string.ascii_lowercase, 5)[1] == {}
