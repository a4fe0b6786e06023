"""Sources read from small files, escapes and sizes worked by hand."""

import io
import itertools
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import gates
from treeline.sources import newick, tables, turtle


def test_delimited(spark, tmp_path):
    (tmp_path / "piped").write_text("1\t|\tRoot\t|\trank\t|\nx\t|\tbad\t|\t\t|\n2\t|\tshort\n3\t|\tLeaf\t|\tgenus\t|\n")
    got = tables.piped(spark, str(tmp_path / "piped"), ["uid", "name", "rank"], "uid")
    assert sorted(map(tuple, got.collect())) == [(1, "Root", "rank"), (3, "Leaf", "genus")]
    (tmp_path / "fwd").write_text("1\t2\n3\t4\n")
    assert sorted(map(tuple, tables.forwards(spark, str(tmp_path / "fwd")).collect())) == [(1, 2), (3, 4)]
    (tmp_path / "head.csv").write_text("a,b,c\n1,,yes\n2,x,no\n3,y,maybe\n")
    got = tables.headed(spark, str(tmp_path / "head.csv"), "a long, b string, c string", {"c": ("yes", "no")})
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, None, True), (2, "x", False), (3, "y", None)]
    (tmp_path / "fixed").write_text("1\t\\N\nbad\tx\n3\tz\n")
    good, bad = tables.fixed_fields(spark, str(tmp_path / "fixed"), "a long, b string")
    assert sorted(map(tuple, good.collect())) == [(1, None), (3, "z")] and bad.count() == 1


def test_checkpoints_and_pages(spark, tmp_path):
    (tmp_path / "page_1.jsonl").write_text('{"k": 1, "v": "old"}\n{"k": 2, "v": "b"}\n')
    (tmp_path / "page_2.jsonl").write_text('{"k": 1, "v": "new"}\n{"k": 3, "v')
    assert sorted(map(tuple, tables.pages(spark, str(tmp_path), "k long, v string", "k").collect())) == [(1, "new"), (2, "b")]
    (tmp_path / "map.json").write_text(json.dumps({"items": {"a": 1, "b": 2}}))
    assert sorted(map(tuple, tables.json_map(spark, str(tmp_path / "map.json"), "items", "int").collect())) == [("a", 1), ("b", 2)]


def test_zip_and_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("Names.tsv", "id\tname\textra\n7\tcat\t.\n8\tdog\t.\n")
    got = tables.zipped(spark, str(tmp_path / "x.zip"), "Names.tsv", "id string, name string")
    assert sorted(map(tuple, got.collect())) == [("7", "cat"), ("8", "dog")]
    assert tables.plain_ids(got, "id").count() == 2
    with pytest.raises(ValueError, match="1 rows"):
        tables.plain_ids(got.union(spark.createDataFrame([("9#1", "x")], "id string, name string")), "id")
    np.save(tmp_path / "a.npy", np.array([1, 5, 9], dtype="<u4"))
    assert sorted((r["idx"], r["value"]) for r in tables.arrays(spark, str(tmp_path / "a.npy")).collect()) == [(0, 1.0), (1, 5.0), (2, 9.0)]
    buffer = io.BytesIO()
    np.save(buffer, np.zeros((2, 2)))
    for bad in (b"no", buffer.getvalue(), (tmp_path / "a.npy").read_bytes()[:-2]):
        with pytest.raises(ValueError):
            tables.array_file(bad)


def test_shards(spark):
    rows = spark.createDataFrame([(a, b, f"{a}{b}{k}") for a, b, n in (("x", "p", 3), ("x", "q", 9), ("y", "p", 2)) for k in range(n)], "a string, b string, key string")
    plan = tables.shards(rows.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], 5)
    assert sorted((r["a"], r["b"] or "", r["size"], r["over"]) for r in plan.collect()) == [("x", "p", 3, False), ("x", "q", 9, True), ("y", "", 2, False)]
    got = tables.covered(tables.distinct_keys(rows.union(rows).where("key <> 'xq4'"), "key"), plan.drop("over"), ["a", "b"], "key")
    assert sorted((r["a"], r["got"], r["complete"]) for r in got.collect()) == [("x", 3, True), ("x", 8, False), ("y", 2, True)]


def test_items(spark):
    item = {"uuid": "u", "_links": {"specificNode": {"title": "Cat"}, "resolvedExternalIds": [{"href": "/resolve/a/1?x", "title": ""}, {"href": "/resolve/a/1?y", "title": ""}]}}
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(item)]))
    assert [tuple(r) for r in tables.flat_items(df).collect()] == [("u", "Cat", ["a/1"])]


def test_manifest(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_text("one")
    (tmp_path / "f" / "b").write_text("two")
    found = gates.manifest(spark, str(tmp_path / "f"))
    sums = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in found.collect()}
    wanted = spark.createDataFrame([("a", sums["a"]), ("b", "0"), ("c", "0")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in gates.verified(found, wanted).collect()} == {"a": "ok", "b": "changed", "c": "missing"}


def test_turtle_escapes():
    told = lambda x: next(turtle.parse(f'@prefix e: <http://e/> . e:a e:b "{x}" .'))[2]
    assert told(r"café \U0001F600 \t \" \\") == 'café 😀 \t " \\'
    with pytest.raises(ValueError, match="unknown escape"):
        told(r"\q")


def _random_tree(rng, n):
    kids: dict = {}
    for i in range(1, n):
        kids.setdefault(rng.randrange(max(0, i - rng.choice([1, 3, 50])), i), []).append(i)

    def text(i):
        label = rng.choice(["", f"n{i}", f"Homo x_ott{i}", f"mrcaott1ott{i}", f"a:b:{i}.5", "q:x", f" sp{i} :1e-3"])
        return ("(" + ",".join(text(k) for k in kids[i]) + ")" if i in kids else "") + label

    return text(0) + ";"


@pytest.fixture
def short_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "40")
    spark.conf.set(names[1], "0")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("nodes,files", [(1, 1), (90, 1), (60, 4)])
def test_newick_by_ranges(spark, short_ranges, tmp_path, nodes, files):
    """Ranges of 40 bytes cut labels and brackets anywhere, and files end within them."""
    rng = random.Random(nodes + files)
    text = "\n " + _random_tree(rng, nodes)
    ends = [0, *sorted(rng.sample(range(1, len(text)), files - 1)), len(text)]
    for i, (a, b) in enumerate(itertools.pairwise(ends)):
        (tmp_path / f"part-{i}.txt").write_text(text[a:b] + "\n")
    assert sorted(map(tuple, newick.read(spark, str(tmp_path)).collect())) == list(newick.parse(text))


@pytest.mark.parametrize(
    "text,message",
    [("((A,B);", "unclosed"), ("(A,B));", "unbalanced"), ("('A name',B)R;", "quoted"), ("A,B;", "unbalanced"), ("", "unclosed tree"), ("(A)(B);", "opening"), ("(A,B);C", "text after"), ("(A,B)", "unclosed tree")],
)
def test_newick_by_ranges_refuses(spark, tmp_path, text, message):
    (tmp_path / "t.txt").write_text(text)
    with pytest.raises(ValueError, match=message):
        newick.read(spark, str(tmp_path))
