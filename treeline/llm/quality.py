"""Quality rules with adaptive thresholds.  [native: DataFrame functions only]

Per-document statistics are integers.  Their distribution per (lang, source) is
kept as a mergeable quantile sketch: a histogram over log-linear buckets (six
significant bits, so a quantile is at most 1/32 off), whose counts add up.  The
sketches of a language's sources merge into the language's sketch.  A threshold
is ``median + max(slack, spread * (median - p10))``: it uses only the lower half
of a distribution, so up to half of a source may be junk without moving it.
A source's sketch is blended with ``PRIOR`` documents that are spread as its
language's are, so a small source follows its language and a large one itself, with
no step between.  The thresholds are joined back to the documents and decide
``kept``.

Defined cases: null text is the empty text (no words, base fails); null ``lang``
and ``source`` form a group of their own; repeated rows are judged alike; an
empty table gives an empty result; other columns pass through, and columns that
the operator adds replace ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bind, materialise, read, small

PRIOR = 50
SPREAD = 8
#: statistic -> least distance between median and threshold (permille, or tenths of a character for word_len).
SLACK = {"symbols": 200, "dup_lines": 450, "upper": 300, "word_len": 60}
#: Words longer than this window position need the exact path (24 index bits).
INDEX_BITS = 24
SYMBOLS = "#*$%&|<>"
#: Columns that the operator adds.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _covered(starts: Column) -> Column:
    """Words covered by five-word windows at the sorted, distinct ``starts``."""
    steps = F.zip_with(F.slice(starts, 2, F.size(starts)), starts, lambda b, a: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x)


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more.

    Each window's hash (upper 40 bits) and index (lower 24) share one long.  If
    the hashes are all distinct, nothing repeats.  Otherwise a primitive sort
    brings equal windows together; neighbours with equal hashes are compared
    word by word, and if any pair differs (a hash collision), or the text is too
    long for the index bits, windows are sorted as strings.
    """
    mask = (1 << INDEX_BITS) - 1
    hi = lambda x: F.shiftright(x, INDEX_BITS)
    ix = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]).bitwiseAND(F.lit(~mask)))

    def fast(s: Column) -> Column:
        same = lambda k: hi(F.get(s, k)) == hi(F.get(s, k - 1))
        twins = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.coalesce(same(k), F.lit(False)))

        def judged(t: Column) -> Column:
            clash = F.exists(t, lambda k: F.slice(words, ix(F.get(s, k)) + 1, 5) != F.slice(words, ix(F.get(s, k - 1)) + 1, 5))
            starts = F.sort_array(F.array_distinct(F.flatten(F.transform(t, lambda k: F.array(ix(F.get(s, k)), ix(F.get(s, k - 1)))))))
            return F.when(clash, _repeat_exact(words)).otherwise(bind(starts, _covered))

        return bind(twins, judged)

    def unless_distinct(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseOR(i.cast("long"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(packed, fast))

    return F.when(F.size(words) < 6, F.lit(0).cast("long")).when(F.size(words) > mask, _repeat_exact(words)).otherwise(bind(hashes, unless_distinct))


def _repeat_exact(words: Column) -> Column:
    windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.struct(F.array_join(F.slice(words, i + 1, 5), " ").alias("w"), i.alias("i"))))

    def judged(s: Column) -> Column:
        at = lambda k: F.get(s, k)["w"]
        twin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False)))
        return bind(F.sort_array(F.transform(twin, lambda k: F.get(s, k)["i"])), lambda x: F.when(F.size(x) == 0, F.lit(0).cast("long")).otherwise(_covered(x)))

    return bind(windows, judged)


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)).cast("long") - 1


def features(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", carry: list[str] | None = None, repeats: bool = True) -> DataFrame:
    """Statistics of every document, with the carried columns (default: all) in a
    struct ``row``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    words = F.when(body.rlike(r"[^ \t-\r]"), F.split(F.trim(body, F.lit(SPACE)), r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))
    counted = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), (_repeat_words(w) if repeats else F.lit(None).cast("long")).alias("rep")))
    row = [c for c in (docs.columns if carry is None else carry) if c.lower() not in MADE]
    shaped = docs.select(
        (F.struct(*row) if row else F.lit(None)).alias("row"), F.col(lang).alias("q_lang"), F.col(source).alias("q_source"),
        counted.alias("w"), _count(body, f"[{SYMBOLS}]").alias("n_symbols"), _count(body, "[A-Z]").alias("n_upper"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    )
    return shaped


def _statistics() -> dict[str, Column]:
    """Integer statistics from the columns of ``features``; null where undefined."""
    return {
        "symbols": F.expr("CASE WHEN w.n > 0 THEN (n_symbols * 1000) div w.n END"),
        "dup_lines": F.expr("CASE WHEN lines.n > 0 THEN (lines.dup * 1000) div lines.n END"),
        "upper": F.expr("CASE WHEN w.n > 0 THEN (n_upper * 1000) div w.chars END"),
        "word_len": F.expr("CASE WHEN w.n > 0 THEN (w.chars * 10) div w.n END"),
    }


def _bucket(value: Column) -> Column:
    """Lower end of the value's bucket: its six leading bits."""
    cut = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(shaped: DataFrame) -> DataFrame:
    """(lang, source, stat, bucket, n): the mergeable sketches of all documents."""
    stats = F.array(*[F.struct(F.lit(n).alias("stat"), c.alias("value")) for n, c in _statistics().items()])
    return (
        shaped.select(F.col("q_lang").alias("lang"), F.col("q_source").alias("source"), F.inline(stats))
        .where("value IS NOT NULL")
        .groupBy("lang", "source", "stat", _bucket(F.col("value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def blended(sketch: DataFrame) -> DataFrame:
    """(lang, source, stat, bucket, w): each source's sketch, times its language's
    rows, plus ``PRIOR`` times the language's sketch: integers in the proportions of
    the source's documents and ``PRIOR`` more of its language."""
    long = lambda c: c.cast("decimal(38,0)")
    wide = sketch.groupBy("lang", "stat", "bucket").agg(F.sum("n").alias("n_wide")).selectExpr("lang AS of", "stat AS kind", "bucket AS cut", "n_wide", "sum(n_wide) OVER (PARTITION BY lang, stat) AS rows")
    pairs = sketch.select("lang", "source", "stat").distinct()
    each = pairs.join(wide, F.col("lang").eqNullSafe(F.col("of")) & (F.col("stat") == F.col("kind"))).drop("of", "kind")
    own = sketch.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("stat").alias("k"), F.col("bucket").alias("b"), F.col("n").alias("n_own"))
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("stat") == F.col("k")) & (F.col("cut") == F.col("b"))
    w = long(F.coalesce("n_own", F.lit(0))) * long(F.col("rows")).cast("decimal(18,0)") + PRIOR * long(F.col("n_wide")).cast("decimal(18,0)")
    return each.join(own, same, "left").select("lang", "source", "stat", F.col("cut").alias("bucket"), long(w).alias("w"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(t_lang, t_source, max_<stat>...), from the blended sketches."""
    by = "lang, source, stat"
    run = blended(sketch).selectExpr("lang", "source", "stat", "bucket", f"sum(w) OVER (PARTITION BY {by} ORDER BY bucket) AS upto", f"sum(w) OVER (PARTITION BY {by}) AS total")
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    fence = run.groupBy("lang", "source", "stat").agg(at(50).alias("mid"), at(10).alias("low")).withColumn("limit", F.col("mid") + F.greatest(slack[F.col("stat")], SPREAD * (F.col("mid") - F.col("low"))))
    return fence.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*[F.max(F.when(F.col("stat") == n, F.col("limit"))).alias(f"max_{n}") for n in SLACK])


def quality_rules(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Add the base statistics, ``base_failed`` and ``kept`` to every document.

    The documents are read twice, once for the sketches (without the repeated
    windows, which no sketch needs) and once to be judged, so that no copy of them
    is stored.
    """
    return judge(features(docs, lang, source, text), features(docs, lang, source, text, carry=[], repeats=False))


def judge(shaped: DataFrame, counted: DataFrame) -> DataFrame:
    """Documents with their verdict; thresholds from ``counted``."""
    limits = small(materialise(thresholds(materialise(sketches(counted)))))
    failed = F.expr("w.n < 10 OR w.rep * 100 > w.n * 20")
    stats = shaped.select("*", F.struct(*[c.alias(n) for n, c in _statistics().items()], failed.alias("failed")).alias("v"))
    joined = stats.join(limits, F.col("q_lang").eqNullSafe(F.col("t_lang")) & F.col("q_source").eqNullSafe(F.col("t_source")), "left")
    within = F.lit(True)
    for n in SLACK:
        within = within & ~F.coalesce(F.col(f"v.{n}") > F.col(f"max_{n}"), F.lit(False))
    kept = F.when(F.col("v.failed"), F.lit(False)).otherwise(within)  # one condition, which stays above the join and the statistics
    return joined.select(
        "row.*", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", F.col("lines.dup").alias("n_dup_lines"),
        F.col("w.rep").alias("n_repeat_words"), F.col("v.failed").alias("base_failed"), kept.alias("kept"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    shaped = materialise(features(docs, carry=["doc_id"]))  # figures and ids only
    return judge(shaped, shaped)
