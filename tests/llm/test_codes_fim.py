"""Vector codes and fill-in-middle against brute-force versions on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import common, fim, queries, vector_codes

# ---- 11

ROW = "vec_id long, embedding array<float>, label int, code string, error string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, v, lab in rows], ROW)


def lloyd(x, parts, entries, rounds):
    """Plain rounds over all pairs."""
    w = x.shape[1] // parts
    books = [x[:entries, p * w : (p + 1) * w].copy() for p in range(parts)]
    for r in range(rounds + 1):
        d = [((x[:, None, p * w : (p + 1) * w] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        code, error = np.stack([e.argmin(axis=1) for e in d], axis=1), sum(e.min(axis=1) for e in d)
        for p in range(parts if r < rounds else 0):
            for k in range(len(books[p])):
                own = x[code[:, p] == k, p * w : (p + 1) * w]
                if len(own):
                    books[p][k] = [int(s) // len(own) for s in own.sum(axis=0)]
    return books, code, error


@pytest.mark.parametrize("scale", [0.02, 0.3, 900.0])
def test_codes_equal_plain_lloyd(spark, scale):
    rng = np.random.default_rng(int(scale * 100))
    x = (rng.normal(0, scale, (700, 32)) + rng.integers(0, 4, (700, 1)) * scale).astype(np.float32)
    x[300:340] = x[5]  # copies, and ties at the small scale
    rows = [(int(i), x[k].tolist(), [None, 1, 2][k % 3]) for k, i in enumerate(rng.permutation(5000)[:700])]
    order = sorted(range(700), key=lambda k: rows[k][0])
    ints = np.floor(x.astype(np.float64) * 256).astype(np.int64)[order]
    books, code, error = lloyd(ints, 16, 64, 2)
    extra = [(9001, None, 1), (9002, [float("nan")] * 32, 1), (9003, [1.0] * 31 + [float("inf")], 1), (9004, [1.0] * 31 + [None], None), (9005, [1.0] * 16, 1), (9006, [], 1)]
    found, got = vector_codes.compress(vectors(spark, rows + extra))
    assert all((g == b).all() for g, b in zip(got, books, strict=True))
    told = {r["id"]: (bytes(r["code"]).hex(), r["error"]) for r in found.collect()}
    assert told == {rows[k][0]: ("".join(f"{c:02x}" for c in code[j]), int(error[j])) for j, k in enumerate(order)}


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(3)
    centre = rng.integers(-4000, 4000, (32, 4))
    x = centre[rng.integers(0, 32, 3000)] + rng.integers(-5, 6, (3000, 4))
    e = centre[rng.permutation(np.repeat(np.arange(32), 2))] + rng.integers(-3, 4, (64, 4))
    book = vector_codes.Codebook(e, vector_codes.grouped(e, 8), np.zeros(64))
    own, _, bound, first = vector_codes.assign(x, book, None, None)
    for _ in range(4):
        e2 = e + rng.integers(-2, 3, e.shape)
        book = vector_codes.Codebook(e2, book.group, np.sqrt(vector_codes.square(e2, e).astype(float)))
        own, found, bound, scans = vector_codes.assign(x, book, own, bound)
        d = ((x[:, None] - e2[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all() and (found == d.min(axis=1)).all() and scans < first / 3
        for g in range(8):  # a bound never exceeds the distance to the group's other entries
            rest = np.where((book.group == g)[None] & (np.arange(64)[None] != own[:, None]), d, 1 << 60).min(axis=1)
            assert (bound[:, g].astype(float) ** 2 <= rest + 1e-6).all()
        e = e2


def test_codes_odd_tables(spark, tmp_path):
    assert vector_codes.compress(vectors(spark, []))[0].count() == 0
    few = [(None, [0.5] * 16, None), (2, [-0.001] * 16, None), (2, [-0.5] * 16, 7)]
    vectors(spark, few).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["vec_id"], r["label_error"]): r for r in vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()}
    assert sorted(r["code"] for r in vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()) == ["00" * 16, "01" * 16, "02" * 16]
    books = ",".join(f"{e}" for p in range(16) for e in (-128, -1, 128))
    assert {r["codebooks_sha256"] for r in got.values()} == {hashlib.sha256(books.encode()).hexdigest()}
    with pytest.raises(Exception, match="2\\^20"):
        vector_codes.compress(vectors(spark, [(1, [2.0**20] * 16, 0)]))


# ---- 13


def test_elias_fano():
    rng = random.Random(5)
    for n in [0, 1, 2, 7, 8, 9, 100, 1000]:
        for most in [n, n + 3, 50 * n + 1, 10**6]:
            values = sorted(rng.sample(range(1, max(most, n) + 1), n))
            packed = fim.EliasFano.pack(np.array(values, np.int64))
            assert [fim.EliasFano.select(packed, n, k) for k in range(n + 1)] == [0, *values]
            if n:
                assert len(packed) <= 3 + n * (2 + np.log2(values[-1] / n + 1)) / 8


def test_line_ends():
    some = ["", "\n", "a", "é\n\nü🙂", "a\r\nb\n", "\n\n\nx" * 50, "y" * 10_000 + "\n" + "z"]
    want = [np.cumsum([len(u) for u in re.findall("[^\n]*\n|[^\n]+", t)]).tolist() for t in some]
    assert [e.tolist() for e in fim.line_ends(pa.array(["skip", *some])[1:])] == want


def cut(i, text, rate=100, spm=50):
    t = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def many(spark):
    rng = random.Random(2)
    lines = ["one line\n", "é\n", "\n", "🙂 smile", "<", "<S", ">\n", "P>", "x" * 300 + "\n", "a\r\n", "<P\n"]
    rows = ["".join(rng.choice(lines) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    rows += [None, "", "\n", "has <S> in it\nmore", "long line\n" * 30_000, "z" * 200_000]
    rows += ["the same\ntext\nof many\n"] * 500  # a hot text: several copies of its entry
    return [(i, t) for i, t in enumerate(rows)] + [(None, "no\nid\n"), (3, rows[3]), (3, "other\ntext")]


@pytest.mark.parametrize("rate, spm, hot", [(100, 50, 128), (60, 20, 7)])
def test_fill_in_middle(spark, rate, spm, hot):
    rows = many(spark)
    df = spark.createDataFrame([(i, t, "kept", "old", 5) for i, t in rows], "doc_id long, text string, lang string, form string, copies int")
    made = fim.fill_in_middle(df, rate=rate, spm=spm, hot=hot)
    assert made.columns == ["doc_id", "text", "lang", "copies", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got], key=key) == sorted([(i, t, *cut(i, t, rate, spm)) for i, t in rows], key=key)
    assert all(r["back"] == (r["text"] or "") and r["lang"] == "kept" and r["copies"] == 5 for r in got)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_one_digest_of_two_texts_is_refused(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ac")], "doc_id long, text string")
    with pytest.raises(Exception, match="one digest"):
        fim.fill_in_middle(df, digest=lambda t: F.substring(t, 1, 1).cast("binary")).collect()


def test_registered(spark, sf):
    got = queries.QUERIES["op13_fill_in_middle"](spark, sf)
    rows = {r["doc_id"]: r["text"] for r in common.read(spark, sf, "documents").collect()}
    found = {r["doc_id"]: r for r in got.collect()}
    assert found.keys() == rows.keys()
    for i, t in rows.items():
        n, form, prefix, middle, output = cut(i, t)
        assert tuple(found[i]) == (i, n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert queries.QUERIES["op11_vector_codes"](spark, sf).count() == common.read(spark, sf, "embeddings").count()
