"""The training-data operators against brute-force versions on small fixtures."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import ann, bytebpe, common, html_text, language_model, merging, neardup, packing, pii, quality, tokens, toxicity

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string, score string"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def texts(seed, n):
    rng = random.Random(seed)
    base = ["the", "of", "and", "Haus", "maison", "a@b.c", "1.2.3.4", "+1 (017) 555-7713", "4417744280351547", "4111 1111 1111 1111", "idiot", "x" * 40, "é", "🙂", "###", "$", "A" * 9]
    out = [" ".join(rng.choice(base) for _ in range(rng.randint(0, 60))).replace(" of ", rng.choice([" ", "\n", "  ", "\t"])) for _ in range(n)]
    out += [None, "", " \n\t", "one", "word " * 3000, "y" * 30_000, "same line here\nsame line here\n" * 4]
    return out + out[:3]


def frame(spark, rows):
    """documents with extra columns that clash with what operators add."""
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "x", "y", "z") for i, t in enumerate(rows)], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts(1, 60)
    return frame(spark, rows), rows


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(t):
    found = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, t or "") if valid(list(PATTERNS)[k], m.group()))
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{e}" for a, k, e in found)


def test_pii(spark, docs):
    df, rows = docs
    found = common.materialise(pii.pii(df))
    for r in found.collect():
        want = base_spans(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r["spans"].split(",")) and r["n_email"] == want.count("email")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert all("a@b.c" not in (t or "") for t in clean.values()) and clean[62] == " \n\t"
    assert pii.pii(empty(spark)).count() == 0


def test_pii_parts_of_base_spans_are_no_negatives(spark):
    """The national part of '+1 (487) 555-7209' must not speak against '(487) 555-7209' standing alone."""
    base = [f"Please call us: +1 ({200 + i % 700}) 555-{1000 + i * 7 % 9000} today" for i in range(400)]
    rows = [*base, "Please call us: (487) 555-7209 today"]
    alone = len(rows) - 1
    got = {r["doc_id"]: r["spans"] for r in pii.pii(frame(spark, rows)).collect()}
    assert got[alone] == "phone:16:30" and all("," not in got[i] for i in range(alone))


def test_pii_trees_and_thresholds(spark):
    """The SQL expression of the trees against their sum in Python for every code; thresholds by trial of every score."""
    rng = random.Random(4)
    rows = [(rng.randrange(5 << len(pii.FEATURES)), int(rng.random() < 0.4), float(rng.randint(1, 9))) for _ in range(300)]
    trees = pii.Trees(rows)
    codes = spark.range(5 << len(pii.FEATURES)).select(F.col("id").cast("int").alias("code"))
    got = {r["code"]: r["score"] for r in codes.withColumn("score", trees.column(F.col("code"))).collect()}
    assert all(abs(got[c] - trees.score(c)) < 1e-9 for c in got)
    for _ in range(50):
        found = [(rng.choice([0.5, 1.0, 2.0, -1.0, 3.5]), rng.random() ** 0.3, rng.randint(1, 20)) for _ in range(12)]
        share = lambda t: sum(p * n for s, p, n in found if s >= t) / sum(n for s, _, n in found if s >= t)
        assert pii._threshold(found) == min((s for s, _, _ in found if share(s) >= pii.PRECISION), default=math.inf)
    assert pii._threshold([]) == math.inf


def test_pii_adds_what_the_base_misses(spark):
    """Unusual writings are added, look-alikes and clean texts are left alone, base spans stay."""
    key = hashlib.sha1(b"key").hexdigest()
    rows = [f'the config has token = "{key}" in it', f"see commit {key} of the repository", "please call (212) 555-0187 today", "mail to anna [at] mailhost [dot] com, please", "the server fe80:12ab:0000:0000:02aa:98ff:fe28:9c5a is up"]
    rows += ["order 0007687199101951 was sent", "part some_variable_name_22_and_more of it", "plain words only, 1 2 3", "", None, "1.2.3.4 and a@b.cc"] * 20
    found = common.materialise(pii.pii(frame(spark, rows)))
    got = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert got[0] == f"secret:24:{24 + len(key)}" and got[1] == "" and got[2] == "phone:12:26" and got[3].startswith("email:8:") and got[4].startswith("ip:11:")
    assert all(got[i] == base_spans(rows[i]) for i in range(5, len(rows)))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert clean[0] == 'the config has token = "[SECRET]" in it' and clean[5] == rows[5] and clean[9] is None


# ---- 2


def test_html():
    page = '<html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav><!-- <p>x</p> --><div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One  two<br>three<p>Four</article><div class="comments"><p>Nice</p></div><footer>&copy; us</footer>'
    net = html_text.train([page] * 5)
    found = html_text.blocks(page)
    e = html_text.Encoder()
    keep = net.probabilities(net.inputs([e.path(p) for p, _, _ in found], e.figures(found)), np.array([0, len(found)])) >= 0.5
    assert [t for (_, t, _), k in zip(found, keep, strict=True) if k] == ["Head & tail", "One two three", "Four"]
    assert html_text.blocks("") == [] and html_text.blocks("plain") == [((), "plain", 0)]
    words = [f"w{k}" for k in range(50)]

    def wrong(pages):
        told = [html_text.labelled(p) for p in pages]
        out = [(net.probabilities(net.inputs([e.path(x) for x, _, _ in b], e.figures(b)), np.array([0, len(b)])) >= 0.5) != (y == 1) for b, y in told if b]
        return np.concatenate(out).mean()

    assert wrong(html_text.skeletons(words, 60, seed=77, neutral=0, misleading=0)) <= 0.03
    assert wrong(html_text.skeletons(words, 60, seed=78, neutral=1)) <= 0.08, "pages whose classes say nothing"
    assert wrong(html_text.skeletons(words, 40, seed=79, neutral=0, misleading=1)) <= 0.1, "pages whose classes mislead"


def test_html_cell_against_a_loop():
    """The batched network against one block and one gate at a time."""
    rng = np.random.default_rng(3)
    net = html_text.Labeller()
    rows = rng.normal(size=(9, html_text.PATH + html_text.WORDS + html_text.FIGURES)).astype(np.float32)
    offsets = np.array([0, 4, 4, 9])
    sig = lambda v: 1 / (1 + math.exp(-v))
    h_ = html_text.HIDDEN

    def states(part, d):
        h, c, out = [0.0] * h_, [0.0] * h_, []
        for x in part:
            z = [sum(x[a] * net.p[f"x{d}"][a, k] for a in range(len(x))) + sum(h[a] * net.p[f"h{d}"][a, k] for a in range(h_)) + net.p[f"c{d}"][k] for k in range(4 * h_)]
            c = [sig(z[h_ + k]) * c[k] + sig(z[k]) * math.tanh(z[3 * h_ + k]) for k in range(h_)]
            h = [sig(z[2 * h_ + k]) * math.tanh(c[k]) for k in range(h_)]
            out.append(h)
        return out

    want = []
    for a, z in zip(offsets, offsets[1:]):
        f, b = states(rows[a:z], "f"), states(rows[a:z][::-1], "b")[::-1]
        want += [sig(sum(v * w for v, w in zip([*f[k], *b[k], *rows[a + k]], net.p["out"])) + net.p["shift"][0]) for k in range(z - a)]
    assert np.allclose(net.probabilities(rows, offsets), want, atol=1e-4)


def test_html_deep_and_long(spark):
    deep = "<div>" * 3000 + "<p>Inner text of the page</p>" + "</div>" * 3000
    long = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    assert [t for _, t, _ in html_text.blocks(deep)] == ["Inner text of the page"]
    df = spark.createDataFrame([(1, "u", long), (2, "u", deep)], "page_id long, url string, html string")
    got = {r["page_id"]: r["n_chars"] for r in html_text.main_text(df).collect()}
    assert got[1] == 200_000 * 5 - 1 and got[2] in (0, 22)


def test_html_nesting_takes_linear_time():
    for page, want in [("<div>" * 100_000 + "Inner" + "</div>" * 100_000, 1), ("<div>t" * 20_000 + "</q></table></nav>" * 20_000, 20_000), ("".join(f"<div class=c{k}>t" for k in range(10_000)), 10_000)]:
        start = time.process_time()
        found = html_text.blocks(page)
        assert len(found) == want and time.process_time() - start < 5 and max(len(p) for p, _, _ in found) <= html_text.LONGEST
    assert html_text.blocks("<div><p>a</b></div></div>b<nav>c")[-1] == (("nav",), "c", 0)
    wide = "".join(f"<div class=c{k}>" for k in range(2_000)) + "<nav>x"
    assert "nav" in html_text.blocks(wide)[0][0]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>One <svg class="i"/> two</p><p>Three</p></article><p>Four</p>', ["One two", "Three", "Four"]),
        ("<p>One <math/> two</p><p>Three</p>", ["One two", "Three"]),
        ("<p>One <svg><g><title>no</title><text>no</text></g><svg>no</svg>no</svg> two</p>", ["One two"]),
        ("<div><p>One <span><svg><path d='x'/></span> two</p></div><p>Three</p>", ["One two", "Three"]),
        ("<div>One<svg><path/>no</div><div>Two</div>", ["One", "Two"]),
        ("<div>One<svg><path/><p>Two</p></div>", ["One", "Two"]),
        ("<p>One<svg><foreignObject><p>no</p></foreignObject></svg> two</p>", ["One two"]),
        ("<p>Let <math><mi>a</mi><mo>=</mo><mn>2</mn></math> be.</p>", ["Let a=2 be."]),
        ('<p><math><semantics><mi>a</mi><annotation encoding="t">\\no</annotation></semantics></math> is</p>', ["a is"]),
        ("<article><object data='x'>Shown</object><p>One</p></article>", ["Shown", "One"]),
        ("<article><div><object data='x'><param name='y'>Two</div><p>Three</p></article>", ["Two", "Three"]),
        ("<div><canvas>Alt</div><p>One</p>", ["Alt", "One"]),
        ("<p>One<script>if (a</b) no</script> two</p>", ["One two"]),
    ],
)
def test_html_keeps_text_about_foreign_elements(page, want):
    assert [t for _, t, _ in html_text.blocks(page)] == want


def test_html_stack_after_unclosed_object():
    assert html_text.blocks("<article><div><object>One</div><p>Two</p></article>")[1][0] == ("article", "p")
    assert html_text.blocks("<p>One<object>Two</object>Three</p>")[2][0] == ("p",)


def test_html_frame(spark):
    rows = [(1, "u", "<article><p>Text</p></article>", "t"), (2, "u", None, "t"), (2, "u", None, "t"), (3, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect())
    assert got == [(1, "Text", 4), (2, "", 0), (2, "", 0), (3, "", 0)]
    assert html_text.main_text(df.limit(0)).count() == 0


# ---- 3


def counted(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(windows)
    cover = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs):
    df, rows = docs
    for r in quality.quality_rules(df).collect():
        n, chars, symbols, dup, rep = counted(rows[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_thresholds(spark):
    """Blended quantiles against counted lists: small and large sources, null languages, one hot source."""
    rng = random.Random(2)
    values = [(lang, source, stat, rng.randint(0, 60) + 100 * (source == "c")) for lang, source, n in (("en", "a", 300), ("en", "b", 3), ("en", "c", 40), (None, "a", 2), ("de", None, 1)) for stat in quality.SLACK for _ in range(n)]
    sketch = spark.createDataFrame(values, "lang string, source string, stat string, bucket long").groupBy("lang", "source", "stat", "bucket").agg(F.count("*").alias("n"))
    got = {(r["t_lang"], r["t_source"]): r for r in quality.thresholds(sketch).collect()}
    for lang, source in {v[:2] for v in values}:
        for stat, slack in quality.SLACK.items():
            own = collections.Counter(v[3] for v in values if v[:3] == (lang, source, stat))
            wide = collections.Counter(v[3] for v in values if (v[0], v[2]) == (lang, stat))
            w = {b: own[b] * sum(wide.values()) + quality.PRIOR * wide[b] for b in wide}
            at = lambda q: min(b for b in w if 100 * sum(x for c, x in w.items() if c <= b) >= q * sum(w.values()))
            assert got[lang, source][f"max_{stat}"] == at(50) + max(slack, quality.SPREAD * (at(50) - at(10)))


def test_quality_exact_path(spark):
    rows = ["a b c d e a b c d e f", "a b c d", "q " * 40, "a b c d e f g h"]
    out = spark.createDataFrame([(t,) for t in rows], "t string").select("t", quality._repeat_exact(F.split(F.trim("t"), " ")).alias("n")).where(F.size(F.split(F.trim("t"), " ")) > 5)
    assert all(r["n"] == counted(r["t"])[4] for r in out.collect())


# ---- 4


def clusters(rows, size, percent):
    sets = []
    for t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(a), find(i)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(6, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [None, "", " ", "solo", "SOLO", "solo"]
    want = clusters(rows, size, 80)
    got = neardup.near_duplicates(frame(spark, rows), shingle=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (n, c, c == i) for i, (n, c) in enumerate(want)}


def test_near_duplicates_large_groups(spark, monkeypatch):
    """2,000 exact copies and 2,000 near copies of one text, some of which are only linked through others or not at all."""
    monkeypatch.setattr(neardup, "BLOCK", 20_000)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = [" ".join(base)] * 2000
    for _ in range(2000):
        copy = list(base)
        for _ in range(int(rng.random() ** 2 * 14)):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append(" ".join(copy))
    firsts = {}
    for i, t in enumerate(rows):
        firsts.setdefault(t, i)
    distinct = list(firsts)
    want = dict(zip(distinct, clusters_by_matrix(distinct, 2, 80), strict=True))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert len(set(want.values())) > 20
    assert got == {i: firsts[distinct[want[t]]] for i, t in enumerate(rows)}


def clusters_by_matrix(rows, size, percent):
    """The least row linked with each row (distinct texts), from the whole matrix of intersections."""
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in map(str.split, rows)]
    number = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[g] for g in s]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    linked = 100 * both >= percent * (n[:, None] + n - both)
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label, len(rows)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_near_duplicates_of_odd_rows(spark):
    """Null ids, repeated rows, an empty table and clashing column names."""
    df = spark.createDataFrame([(None, "a b c d", 1), (3, "a b c d", 1), (3, "a b c d", 1), (None, None, 1), (5, None, 1), (7, "x " * 50_000, 1)], "doc_id long, text string, digest int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, shingle=2).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 0, None, True), (5, 0, 5, True), (7, 1, 7, True)], key=str)
    assert neardup.near_duplicates(df.limit(0), shingle=2).count() == 0


def test_chance_and_registers():
    value, offsets = neardup.shingle_sets(pa.array(["a b c d e f g h", "a", None]), 2)
    regs = neardup.registers(value, offsets)
    assert np.diff(offsets).tolist() == [7, 1, 0] and (regs[:2] > 0).all() and not regs[2].any()
    assert 0 < neardup.chance(np.array([500]), np.array([500]))[0] < 2e-3


# ---- 5


def test_lm(spark, docs):
    df, rows = docs
    cut = {i: [*WORD.findall(low(t)), None] for i, t in enumerate(rows)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in cut}
    c = collections.Counter(w for i, ws in cut.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    flag = common.crc_mod("doc_id", 7) == 2
    language_model.HEAD, old = 5, language_model.HEAD  # so that the join is used
    try:
        got = language_model.lm_scores(df, ~flag, flag).collect()
    finally:
        language_model.HEAD = old
    assert len(got) == len(rows)
    for r in got:
        ws = cut[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6) and r["score"] < 0


def test_lm_score_by_hand(spark, docs):
    """The neural score of every document, from the model's vectors with a loop over all classes for each token."""
    df, rows = docs
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(rows))}
    flag = common.crc_mod("doc_id", 7) == 2
    model, counts = language_model.learn(df, ~flag, "doc_id", "text")
    c = collections.Counter(w for i, t in enumerate(rows) if not held[i] for w in [*WORD.findall(low(t)), ""])
    classes, net = model.classes, model.net
    member = collections.defaultdict(list)
    for w in c:
        member[int(classes.of([w])[0])].append(w)
    context, target = net.context.astype(float), net.target.astype(float)
    got = {r["doc_id"]: r["score"] for r in language_model.score(df, model, counts, "doc_id", "text", flag).collect()}
    for i in list(range(0, 60, 7)) + [60, 61, 63]:
        total, c1, c2 = 0.0, 0, 0
        for w in [*WORD.findall(low(rows[i])), ""]:
            k = int(classes.of([w])[0])
            logits = (context[c1] * net.position[0] + context[c2] * net.position[1]) @ target.T + net.bias
            total += (logits[k] - np.log(np.exp(logits).sum())) / math.log(10)
            if k >= classes.first:
                total += math.log10((c[w] + 1) / (sum(c[x] + 1 for x in member[k]) + 1))
            c1, c2 = k, c1
        assert got[i] == pytest.approx(total, abs=2e-3 + 1e-4 * abs(total))


def test_lm_is_normalised():
    net = language_model.LogBilinear(np.full(30, 1 / 30))
    net.fit(np.random.default_rng(1).integers(0, 30, (3000, 3)))
    a, b, z = net.tables()
    total = np.exp(a[:, None, :] + b[None, :, :] - z[:, :, None]).sum(axis=2)
    assert np.allclose(total, 1, atol=1e-3)


def test_lm_contexts_of_all_rows(spark):
    """What follows 'p' differs in the 2,000 documents of lowest hashed id; the model reads the others too."""
    low_hash = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) // 3
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(low_hash, "p r").otherwise("p q").alias("text"))
    model, _ = language_model.learn(df.repartition(3), F.lit(True), "doc_id", "text")
    end, p, q, r = model.classes.of(["", "p", "q", "r"])
    a, b, z = model.net.tables()
    assert np.exp(a[p, q] + b[end, q] - z[p, end]) > 0.4 > np.exp(a[p, r] + b[end, r] - z[p, end])


def test_lm_counts_every_triple(spark, docs):
    df, rows = docs
    classes = language_model.Classes(["the", "of"])
    want = collections.Counter()
    for t in rows:
        ks = [0, 0, *classes.of([*WORD.findall(low(t)), ""]).tolist()]
        want.update(zip(ks, ks[1:], ks[2:]))
    got = collections.Counter()
    for row in language_model.triple_counts(df.repartition(3), "text", classes, 4).collect():
        for x, c in zip(np.frombuffer(row["code"], np.int64).tolist(), np.frombuffer(row["count"], np.int64).tolist()):
            v = classes.size
            assert (x // (v * v), x // v % v, x % v) not in got
            got[x // (v * v), x // v % v, x % v] = c
    assert got == want


def test_lm_means_in_levels(spark, docs, monkeypatch):
    """Seven shards averaged two at a time in tasks and at once on the driver are one model."""
    df, _ = docs
    share = np.full(language_model.Classes(["the", "of"]).size, 1.0)
    states = []
    for fan in (2, 64):
        monkeypatch.setattr(language_model, "FAN", fan)
        net = language_model.LogBilinear(share / share.sum())
        shards = language_model.triple_counts(df, "text", language_model.Classes(["the", "of"]), 7)
        assert shards.count() == 7
        language_model.fit_all(net, shards, 7)
        states.append(net.state())
    assert np.allclose(*states, atol=1e-3)


# ---- 6


def test_ann(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 8)).round(1)
    m[50:120] = m[3]  # a hot vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] * 4), (1080, [])]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = m.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and all(abs(s[v] - score) < 1e-12 for _, v, score in got[q])
        hit += len(set(order) & {v for _, v, _ in got[q]})
    assert set(got) == set(range(0, 400, 20)) and hit >= 0.9 * 400
    base, spread = ann._shelves(np.array([0, 40_000, 3, 16_384, 5, 5, 16_380]))
    assert spread == [1, 3, 1, 1, 1, 1, 1] and base == [0, 0, 3, 4, 5, 5, 6]
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert ann.nearest(few, F.col("id") == 0).count() == 4 and ann.nearest(few.limit(0), F.col("id") == 0).count() == 0


# ---- 7, 9, 10


ODD = ["", " ", "a  b", "▁x ▁", "\n \n", "tab\tx", "中🙂", "</s><|endoftext|>", "x" * 2000, "don't we're", "é  ", "12345 !!!"]


def test_token_counts(spark, docs):
    import sentencepiece

    df, rows = docs
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in tokens.token_counts(df, P.path("piece_bpe_32k.model"), limit=50).collect()}
    for i, t in enumerate(rows):
        n = len(model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 50)
    counter = tokens.PieceCounter(P.path("piece_bpe_32k.model"))
    assert counter.count(pa.array(ODD)).tolist() == [len(x) for x in model.encode(ODD)]
    assert tokens.token_counts(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_merge_paths_agree():
    table = merging.PairTable.of_pieces({p: i for i, p in enumerate("a b c ab bc abc aba".split())}, {"ab": 0, "bc": 1, "abc": 2, "aba": 3})
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 3, n) for n in rng.integers(0, 40, 50)]
    out, ends = merging.merge(table, np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))))
    for i, r in enumerate(rows):
        assert out[ends[i] : ends[i + 1]].tolist() == merging._merge_long(table, r).tolist()


def test_byte_bpe(spark, docs, monkeypatch):
    import tiktoken

    df, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bytebpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        t = rows[r["doc_id"]] or ""
        assert list(r["ids"]) == own.encode_ordinary(t) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    long = [" ".join(rows[k] or "" for k in range(20)), " " * 700, "7" * 900 + " x", "é🙂" * 300 + "\n\n\n   y", "don't" * 150]
    monkeypatch.setattr(bytebpe, "CHUNK", 23)
    monkeypatch.setattr(bytebpe, "OVERLAP", 12)
    codec = bytebpe.ByteCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in [*ODD, *long, *(x or "" for x in rows)]:
        assert np.frombuffer(codec.encode_batch([t])[0], "<u4").tolist() == own.encode_ordinary(t)
    monkeypatch.setattr(bytebpe, "SPAN", 70)
    codec = bytebpe.ByteCodec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in [*long, *(x or "" for x in rows[:40])]:
        cuts = bytebpe._cuts(len(t)) or [(0, 0)]
        spans = [[e + a for e in codec.boundaries(t[a:z])] for a, z in cuts]
        assert codec.stitched(t, len(t), cuts, spans) == codec.boundaries(t)


def test_byte_bpe_of_a_long_text(spark):
    """Spans of texts over the real limits are dealt out and stitched; runs longer than an overlap too."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "Beta's", "12345", " ", "\n", "été", "🙂🙂", "...", "x" * 9])
    rows = [" ".join(word() for _ in range(120_000)), " " * (bytebpe.SPAN + 4_000) + "end", "short", None]
    for r in bytebpe.encode_documents(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        t = rows[r["doc_id"]] or ""
        assert list(r["ids"]) == own.encode_ordinary(t) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_packing_takes_the_least_sum_of_squares():
    """Every choice against a trial of all sequences, with counts from scratch."""
    rng = random.Random(7)
    sizes = sorted((rng.randint(1, 40) for _ in range(200)), reverse=True)
    sequence, offset = packing.sum_of_squares(np.array(sizes), 40)
    gaps: dict[int, int] = {}

    def cost(state):
        return sum(n * n for g, n in collections.Counter(state.values()).items() if g > 0)

    for s, place, at in zip(sizes, sequence.tolist(), offset.tolist()):
        fresh = max(gaps, default=-1) + 1
        trials = {p: cost(gaps | {p: gaps.get(p, 40) - s}) for p in [*[p for p, g in gaps.items() if g >= s and g > 0], fresh]}
        assert trials[place] == min(trials.values()) and at == 40 - gaps.get(place, 40)
        gaps[place] = gaps.get(place, 40) - s
    assert min(gaps.values()) >= 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    df, rows = docs
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: model.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(rows)}
    bins = collections.defaultdict(list)
    seen = collections.Counter()
    for r in packing.best_fit_packing(df, P.path("word_bpe_49k.json"), length=256).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 256 and r["start"] == 256 * r["piece"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 256
    encoder = packing.WordEncoder(P.path("word_bpe_49k.json"))
    flat, ends = encoder.encode(pa.array(ODD))
    assert [flat[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)] == [model.encode(t, add_special_tokens=False).ids + [0] for t in ODD]
    assert packing.best_fit_packing(empty(spark), P.path("word_bpe_49k.json")).count() == 0


# ---- 8


def forward(net, text):
    """A document's score, word by word and filter by filter."""
    words = [w.strip(toxicity.STRIP).lower() for w in WORD.findall(low(text))]
    kinds = [(int(toxicity._bucket([w], 0)[0]), int(toxicity._bucket([w[: toxicity.PREFIX] if len(w) >= toxicity.PREFIX else ""], 1)[0])) for w in words]
    at = {int(b): k + 1 for k, b in enumerate(net.buckets)}
    zero = np.zeros(toxicity.DIM)
    vectors = [net.embed[at.get(a, 0)].astype(float) + net.embed[at.get(b, 0)] for a, b in kinds] + [zero] * toxicity.PAD
    columns = []
    for w, f in net.filters.items():
        for c in range(toxicity.FILTERS):
            windows = [sum(float(vectors[k + j] @ f[j, :, c]) for j in range(w)) for k in range(len(words))] + [0.0] * toxicity.PAD
            columns.append(sorted(windows, reverse=True)[: toxicity.TOP])
    logit = float(net.shift)
    for c, top in enumerate(columns):
        for t in range(toxicity.TOP):
            value = top[t] if t < len(top) else -np.inf
            logit += max(value + net.bias[c], 0) * net.dense[t, c]
    votes = [sum(w in words_.split() for w in words) for words_ in toxicity.FUNCTION_WORDS.values()]
    language = votes.index(max(votes)) if max(votes) else -1
    return 1 / (1 + math.exp(-min(max(logit - net.limit[language], -40), 40)))


def test_toxicity_against_a_loop(spark):
    rng = random.Random(9)
    rows = [" ".join(rng.choice(["idiot", "the", "of", "Haus", "der", "maison", "les", "fine,", "day", "!!", "Überraschung"]) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    y = np.array([int("idiot" in r) for r in rows])
    lexicon = toxicity.Lexicon()
    kinds, codes, offsets = lexicon.buckets(pa.array(rows))
    docs = [kinds[codes[a:z]] for a, z in zip(offsets, offsets[1:])]
    net = toxicity.train(docs, y, np.arange(80) % 5 == 0)
    rows += [None, "", "idiot " * 3000]
    got = net.scores(*toxicity.Lexicon().buckets(pa.array(rows)))
    assert np.allclose(got, [forward(net, r) for r in rows], atol=1e-4)


def test_toxicity_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "the day", "x", 5), (2, None, "y", 6)], "doc_id long, text string, of string, toxic int")
    lab = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab, F.lit(True))
    assert got.columns == [*df.columns, "score"] and got.count() == 2


def test_toxicity(spark):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(200)] + ["the", "of", "and"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        y = i % 4 == 0
        if y:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron,", "CLOWN"])
        rows.append(" ".join(w))
        labels.append((i, 1, int(y)))
    rows += [None, "", rows[0]]
    df = frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, lab, common.crc_mod("doc_id", 5) != 0).collect()}
    fresh = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.5) == (i % 4 == 0) for i in fresh) >= 0.95 * len(fresh)
    assert out[400] == out[401] and out[402] == out[0] and 0 <= min(out.values()) and max(out.values()) <= 1
    assert {r["score"] for r in toxicity.toxicity(df, lab.limit(0), F.lit(True)).collect()} == {0.0}


def test_a_language_threshold_has_no_least_number_of_rows():
    net = toxicity.Network(np.zeros(0, np.int64), np.zeros(0))
    cut = lambda n: (np.concatenate([np.full(n, 5.0), np.full(n, 4.0), np.full(60, 1.0), np.full(60, -1.0)]), np.array([1, 0] * 0 + [1] * n + [0] * n + [1] * 60 + [0] * 60), np.array([0] * (2 * n) + [1] * 120))
    found = []
    for n in (1, 5, 9, 10, 11, 40):
        z, y, lang = cut(n)
        net.calibrate(z, y, lang)
        overall = toxicity._threshold(z, y)
        assert net.limit[0] == pytest.approx(overall + n / (n + toxicity.PRIOR) * (4.5 - overall))
        found.append(net.limit[0])
    assert found == sorted(found)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Counts of all shards: a word of two rows, wherever they are, has a row; shards of all sizes tell the kinds apart."""
    rng = random.Random(8)
    rows = [" ".join([f"own{i // 2}", "moron" if i % 5 == 0 else "friend", *(f"word{rng.randrange(300)}" for _ in range(20))]) for i in range(9_000)]
    df = frame(spark, rows)
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(len(rows))], "doc_id long, toxic int")
    net = toxicity.learn(df, lab, F.lit(True))
    fit = [i for i in range(len(rows)) if common.hash64([str(i)], 3)[0] % np.uint64(5) != 0]
    twice = [k for k, c in collections.Counter(i // 2 for i in fit).items() if c == 2]
    assert set(toxicity._bucket([f"own{k}" for k in twice], 0).tolist()) <= set(net.buckets.tolist())
    z = net.scores(*toxicity.Lexicon().buckets(pa.array(rows[:500])))
    assert ((z >= 0.5) == (np.arange(500) % 5 == 0)).mean() > 0.99


def test_one_shard_is_the_fit_of_the_whole(spark):
    rows = [f"the {'idiot' if i % 3 == 0 else 'day'} of word{i % 17} and word{i % 5}" for i in range(200)]
    df, lab = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    a, b = toxicity.learn(df, lab, F.lit(True)), toxicity.train(*toxicity.labelled_sample(df, lab, F.lit(True)))
    assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.embed, b.embed, atol=1e-5) and np.allclose(a.dense, b.dense, atol=1e-5) and np.allclose(a.limit, b.limit, atol=1e-2)


def test_sample_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b words"), (1, "a words"), (1, "a words"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    texts, y, _ = toxicity.labelled_sample(docs, labels, F.lit(True))
    assert [len(t) for t in texts] == [2, 1] and y.tolist() == [1, 0]
