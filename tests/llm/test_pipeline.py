"""Every stage of the pipeline on odd rows and against brute force, and the whole of it."""

import collections
import re

import corpus_pipeline
import pytest
from test_operators import P, base_spans, clusters, counted, forward

from treeline.llm import packing, quality, toxicity
from treeline.llm.common import crc_mod, read

EXTRA = "gone long, toxic int, of string, score double, spans string, n_words long, kept boolean, row string, _row string, words string, redactions string, base_failed boolean"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def bucket(v):
    return v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0)


def kept_by_quality(rows):
    """rows (doc_id, text, lang, source, n_chars) -> those the rules keep, from lists."""
    stats, failed = {}, {}
    for k, (_, t, *_rest) in enumerate(rows):
        n, chars, symbols, dup, rep = counted(t)
        lines = sum(bool(re.search(r"[^ \t-\r]", x)) for x in (t or "").split("\n"))
        failed[k] = n < 10 or rep * 100 > n * 20
        stats[k] = {"symbols": symbols * 1000 // n if n else None, "dup_lines": dup * 1000 // lines if lines else None, "upper": len(re.findall("[A-Z]", t or "")) * 1000 // chars if n else None, "word_len": chars * 10 // n if n else None}
    out = []
    for k, r in enumerate(rows):
        good = not failed[k]
        for s, slack in quality.SLACK.items():
            values = lambda same: collections.Counter(bucket(stats[j][s]) for j, x in enumerate(rows) if same(x) and stats[j][s] is not None)
            own, wide = values(lambda x: x[2:4] == r[2:4]), values(lambda x: x[2] == r[2])
            w = {b: own[b] * sum(wide.values()) + quality.PRIOR * wide[b] for b in wide}
            at = lambda q: min(b for b in w if 100 * sum(c for a, c in w.items() if a <= b) >= q * sum(w.values()))
            if stats[k][s] is not None:
                good &= stats[k][s] <= at(50) + max(slack, quality.SPREAD * (at(50) - at(10)))
        if good:
            out.append(r)
    return out


def kept_once(rows):
    label = clusters([r[1] for r in rows], 5, 80)
    first = {}
    for k, (n, root) in enumerate(label):
        if n:
            first[root] = min(first.get(root, rows[k][0]), rows[k][0])
    return [r for r, (n, root) in zip(rows, label) if not n or r[0] == first[root]]


def redacted(text):
    out, at = [], 0
    for kind, a, e in (x.split(":") for x in base_spans(text).split(",") if x):
        a, e = max(int(a), at), int(e)
        if e > at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = e
    return "".join(out) + (text or "")[at:] if text else text


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory, sf):
    """A folder with 150 documents of all kinds and their labels."""
    folder = tmp_path_factory.mktemp("small")
    docs = read(spark, sf, "documents").select(*corpus_pipeline.COLUMNS).orderBy("doc_id").limit(150)
    docs.write.parquet(f"{folder}/documents.parquet")
    read(spark, sf, "labels").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_whole_run_against_brute_force(spark, small):
    """Every stage on what the brute-force stage before it kept, then the pieces of the whole run."""
    rows = rows_of(read(spark, small, "documents"))
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    want = kept_by_quality(rows)
    assert rows_of(STAGES["quality rules"](spark, frame(rows), small)) == sorted(want, key=str) and len(want) < len(rows)
    net = toxicity.train(*toxicity.labelled_sample(frame(want), read(spark, small, "labels"), crc_mod("doc_id", 5) != 0))
    scores = [forward(net, r[1]) for r in want] if net else [0.0] * len(want)
    clean = [r for r, x in zip(want, scores) if x < 0.5]
    assert rows_of(STAGES["toxicity"](spark, frame(want), small)) == sorted(clean, key=str)
    once = kept_once(clean)
    assert rows_of(STAGES["MinHash near-dedup"](spark, frame(clean), small)) == sorted(once, key=str) and len(once) < len(clean)
    plain = [(r[0], redacted(r[1]), *r[2:]) for r in once]
    got = rows_of(STAGES["PII"](spark, frame(once), small))
    assert [re.sub(r"\[SECRET\]", "*", r[1]) for r in got if "[SECRET]" not in r[1]] == [r[1] for r in sorted(plain, key=str) if r[0] in {g[0] for g in got if "[SECRET]" not in g[1]}]
    assert all(r[4] == len(r[1]) for r in got)
    pieces = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pieces(frame(got), P.path("word_bpe_49k.json")).collect()}
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = out.collect()
    assert {tuple(r[:5]) for r in found} == pieces and len(found) == len(pieces)
    places = collections.defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, sf, name):
    """Nulls, empty and very long texts, ties, repeats and clashing columns; then an empty table."""
    prose = "The quick brown fox jumps over the lazy dog and runs far away from here to there."
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n", None, "s", 2), (4, prose, "en", "s", len(prose)), (4, prose, "en", "s", len(prose)), (5, prose, "en", "s", 1), (None, prose + " Not more.", "en", "s", 1), (6, prose + " " + "other words follow here " * 20_000, "en", "s", None), (7, prose + " Mail a.b@c.de now.", None, None, 3)]
    extra = (9, 1, "x", 0.9, "y", 3, True, "r", "r", "w", "z", False)
    df = spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {EXTRA}")
    out = STAGES[name](spark, df, sf)
    empty = STAGES[name](spark, df.limit(0), sf)
    assert empty.count() == 0 and empty.columns == out.columns
    got = out.collect()
    if name == "best-fit packing":
        assert sum(r["doc_id"] == 4 for r in got) == 2 and {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7, None}
        return
    assert out.columns == df.columns and all(tuple(r[5:]) == extra for r in got)
    ids = collections.Counter(r["doc_id"] for r in got)
    if name == "quality rules":
        assert ids[4] == 2 and ids[5] == ids[7] == 1 and not ids[1] + ids[2] + ids[3] + ids[6]
    elif name == "toxicity":
        assert ids == collections.Counter(r[0] for r in rows)
    elif name == "MinHash near-dedup":
        assert ids[4] == 2 and ids[5] == 0 and ids[1] == ids[2] == ids[3] == ids[6] == 1
    else:
        texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got}
        assert texts[7][0].endswith("Mail [EMAIL] now.") and texts[7][1] == len(texts[7][0]) and texts[1] == (None, None) and texts[2] == ("", 0)


def test_one_id_with_several_texts(spark, sf):
    """Only the text that is a copy goes, not what shares its id."""
    prose = "The quick brown fox jumps over the lazy dog and runs far away from here to there."
    own, more = prose.replace("fox", "cat").upper(), "Another text that nobody else has written before, with words of its own and no copy at all."
    rows = [(3, prose), (7, prose), (7, more), (8, own), (9, own), (9, own), (None, prose), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in STAGES["MinHash near-dedup"](spark, df, sf).collect()), key=str)
    assert (7, more) in got and sum(t == prose for i, t in got if i) == 1 and [i for i, t in got if t == own] == [8]
    assert (5, None) in got and (5, "") in got and (None, prose) in got
