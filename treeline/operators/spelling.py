"""Conservative spelling correction by phonetic key and edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least lengths to index and to correct, distance caps.
INDEXED, CORRECTED, LONG = 4, 6, 10


def words(text: Column) -> Column:
    """ASCII words in lower case; none if the text has other characters."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def phonetic(word: Column) -> Column:
    """ph -> f, later h dropped, later vowels dropped, runs collapsed."""
    out = F.regexp_replace(word, "ph", "f")
    out = F.regexp_replace(out, "(?<=.)h", "")
    out = F.regexp_replace(out, "(?<=.)[aeiouy]", "")
    return F.regexp_replace(out, r"(.)\1+", "$1")


def index(names: DataFrame) -> DataFrame:
    """(key, word, n): in how many distinct names each indexed word stands."""
    distinct = names.select("name").distinct()
    exploded = distinct.select("name", F.explode(F.array_distinct(words(F.col("name")))).alias("word")).where(F.length("word") >= INDEXED)
    return exploded.groupBy("word").agg(F.count("*").alias("n")).select(phonetic(F.col("word")).alias("key"), "word", "n")


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits and swaps of neighbours, no
    substring edited twice.  Row by row over arrays of the last two rows."""
    la, lb = F.length(a), F.length(b)
    ch = lambda s, i: F.substring(s, i, F.lit(1))
    first = F.sequence(F.lit(0), lb)
    start = F.struct(first.alias("back"), first.alias("last"))

    def row(t: Column, i: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            cost = F.when(ch(a, i) == ch(b, j), 0).otherwise(1)
            base = F.least(F.element_at(made, -1) + 1, F.get(t["last"], j) + 1, F.get(t["last"], j - 1) + cost)
            swap = (i > 1) & (j > 1) & (ch(a, i) == ch(b, j - 1)) & (ch(a, i - 1) == ch(b, j))
            return F.concat(made, F.array(F.when(swap, F.least(base, F.get(t["back"], j - 2) + 1)).otherwise(base)))

        now = F.aggregate(F.when(lb > 0, F.sequence(F.lit(1), lb)).otherwise(F.array().cast("array<int>")), F.array(i), cell)
        return F.struct(t["last"].alias("back"), now.alias("last"))

    return F.when(la == 0, lb).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(la, F.lit(1))), start, row, lambda t: F.element_at(t["last"], -1)))


def within(a: Column, b: Column, cap: Column) -> Column:
    """``osa`` where it is at most ``cap`` (1 or 2), else more than ``cap``.

    Only the 2 * cap + 1 cells about the diagonal are made: cell k of row i stands
    for the first i letters of a and the first i - cap + k of b.  A row without
    a cell up to the cap ends the work; the rows after it are passed over.
    """
    la, lb, far = F.length(a), F.length(b), cap + 1
    letter = lambda s, i: F.substring(s, i, F.lit(1))
    inside = lambda j: (j >= 0) & (j <= lb)
    first = F.transform(F.sequence(F.lit(0), 2 * cap), lambda k: F.when(inside(k - cap), F.least(k - cap, far)).otherwise(far))
    start = F.struct(first.alias("back"), first.alias("last"))

    def row(t: Column, i: Column) -> Column:
        def cell(made: Column, k: Column) -> Column:
            j = i - cap + k
            same = letter(a, i) == letter(b, j)
            above = F.coalesce(F.get(t["last"], k + 1), far) + 1
            left = F.coalesce(F.get(made, F.size(made) - 1), far) + 1
            base = F.least(above, left, F.get(t["last"], k) + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            value = F.when(j == 0, i).when(swap, F.least(base, F.get(t["back"], k) + 1)).otherwise(base)
            return F.concat(made, F.array(F.when(inside(j), F.least(value, far)).otherwise(far)))

        now = F.aggregate(F.sequence(F.lit(0), 2 * cap), F.array().cast("array<int>"), cell)
        return F.when(F.array_min(t["last"]) > cap, t).otherwise(F.struct(t["last"].alias("back"), now.alias("last")))

    end = F.aggregate(F.sequence(F.lit(1), F.greatest(la, F.lit(1))), start, row, lambda t: F.get(t["last"], lb - la + cap))
    return F.when(la == 0, lb).when(F.abs(la - lb) > cap, far).otherwise(end)


def correct_words(asked: DataFrame, idx: DataFrame) -> DataFrame:
    """(word, fixed): known, short and unmatched words have no row; the nearest
    indexed word of the same key within the cap, then most frequent, shortest."""
    cap = F.when(F.length("word") >= LONG, 2).otherwise(1)
    new = asked.select("word").distinct().where(F.length("word") >= CORRECTED).join(idx.select("word"), "word", "left_anti")
    near = new.withColumn("key", phonetic(F.col("word"))).join(idx.select("key", F.col("word").alias("other"), "n"), "key")
    fold = lambda c: F.regexp_replace(c, "ph", "f")
    some = near.withColumn("d", within(fold(F.col("word")), fold(F.col("other")), cap)).where(F.col("d") <= cap)
    return some.groupBy("word").agg(F.min(F.struct("d", (-F.col("n")).alias("m"), F.length("other").alias("l"), "other")).alias("b")).select("word", F.col("b.other").alias("fixed"))


def correct_queries(queries: DataFrame, idx: DataFrame) -> DataFrame:
    """(query, fixed): word by word; queries that no word of changes have no row."""
    w = queries.select("query", F.posexplode(words(F.col("query"))).alias("pos", "word"))
    j = w.join(correct_words(w, idx), "word", "left")
    back = j.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fixed", "word").alias("w")))).alias("a"), F.bool_or(F.col("fixed").isNotNull()).alias("changed"))
    return back.where("changed").select("query", F.array_join(F.transform("a", lambda x: x["w"]), " ").alias("fixed"))
