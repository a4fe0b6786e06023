"""Name search: corpus, postings, match bands, ranking, interleaving, correction.

Names are rows (idx, kind, name). kinds: 0 scientific, 1 abbreviation, 2 synonym,
3 alias, 4 broken, 5 second catalogue.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EXACT, HEAD, NONE, TOKEN, match_band

#: Search limits.
LIMIT, MOST, WEAK_ROWS, SIZE_RATIO, HALF_LIFE, USES = 20, 50, 8, 100, 21.0, 12


def folded(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


@cache
def _bases() -> tuple[str, str]:
    """Lower-case letters that decompose into one base letter and marks, and the bases."""
    pairs = [(chr(k), folded(chr(k))) for k in range(0xC0, 0x2000) if chr(k).isalpha() and chr(k) == chr(k).lower()]
    some = [(c, f) for c, f in pairs if len(f) == 1 and f != c]
    return "".join(c for c, _ in some), "".join(f for _, f in some)


def fold(name: Column) -> Column:
    """``folded`` as an expression."""
    return F.regexp_replace(F.call_function("translate", F.lower(name), *map(F.lit, _bases())), r"\p{M}", "")


def terms(name: Column) -> Column:
    """Index terms: runs of letters and digits, folded."""
    return F.filter(F.split(fold(name), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def abbreviation(name: Column) -> Column:
    """'Tyrannosaurus rex' -> 'T. rex'; null unless two to four words, alphabetic
    at their start, none ending in a full stop."""
    w = F.split(F.trim(name), r"\s+")
    ok = F.size(w).between(2, 4) & F.forall(w, lambda x: x.rlike(r"^\p{L}") & ~F.endswith(x, F.lit(".")))
    heads = F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: F.concat(F.substring(x, 1, 1), F.lit(".")))
    return F.when(ok, F.array_join(F.concat(heads, F.slice(w, F.size(w), F.lit(1))), " "))


def corpus(nodes: DataFrame, synonyms: DataFrame, aliases: DataFrame, broken: DataFrame, second: DataFrame) -> DataFrame:
    """All names (idx, kind, name), later corpora without what earlier ones said."""
    sci = nodes.where("name IS NOT NULL").select("idx", F.lit(0).cast("long").alias("kind"), "name")
    abbr = sci.select("idx", F.lit(1).cast("long").alias("kind"), abbreviation(F.col("name")).alias("name")).where("name IS NOT NULL")
    rest = sci.unionByName(abbr)
    for kind, rows in ((2, synonyms), (3, aliases), (4, broken), (5, second)):
        rest = rest.unionByName(rows.where("name IS NOT NULL").select("idx", F.lit(kind).cast("long").alias("kind"), "name"))
    said = F.row_number().over(Window.partitionBy("idx", F.lower("name")).orderBy("kind", "name"))
    return rest.withColumn("_said", said).where("kind <= 1 OR _said = 1").drop("_said")


def rank_score(tips: Column, has_image: Column, measured: Column, n_names: Column) -> Column:
    return F.log1p(tips) + 0.5 * has_image.cast("int") + 0.25 * measured.cast("int") + 0.6 * F.least(F.log1p(n_names) / F.log1p(F.lit(10)), F.lit(1.0))


def signals(nodes: DataFrame, images: DataFrame | None = None, tiers: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(idx, score): the rank score of every node; a table that a build lacks counts
    as its signal being 0. images (idx), tiers (idx, tier), names (idx, n_names)."""
    j = nodes.select("idx", "tips")
    flag = lambda df: df.select("idx").distinct().withColumn("_f", F.lit(True))
    j = j.withColumn("image", F.lit(False)) if images is None else j.join(flag(images), "idx", "left").withColumn("image", F.coalesce("_f", F.lit(False))).drop("_f")
    j = j.withColumn("measured", F.lit(False)) if tiers is None else j.join(flag(tiers.where("tier = 0")), "idx", "left").withColumn("measured", F.coalesce("_f", F.lit(False))).drop("_f")
    j = j.withColumn("n_names", F.lit(0)) if names is None else j.join(names.select("idx", "n_names"), "idx", "left").withColumn("n_names", F.coalesce("n_names", F.lit(0)))
    return j.select("idx", rank_score(F.col("tips"), F.col("image"), F.col("measured"), F.col("n_names")).alias("score"))


#: Rows that a prefix scan keeps for each spelling, broken names that an answer explains.
PER_SPELLING, EXPLAINED = 128, 2


def spellings(query: str) -> list[str]:
    """A query as typed, with its first letter in capitals, the same of its lower case, and in lower case."""
    first = lambda x: x[:1].upper() + x[1:]
    return [x for x in dict.fromkeys((query, first(query), first(query.lower()), query.lower())) if x]


def prefix_top(nodes: DataFrame, query: str, most: int = PER_SPELLING) -> DataFrame:
    """(idx) of names that begin with a spelling of the query, for each spelling the
    ``most`` with most tips, and of names that are one. Each scan is a pushed-down
    prefix filter with a bounded top-k."""
    parts = [nodes.where(F.startswith("name", F.lit(v))).orderBy(F.desc("tips"), "idx").limit(most).select("idx") for v in spellings(query)]
    out = nodes.where(F.col("name").isin(*spellings(query))).select("idx")
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()


def broken_answers(broken: DataFrame, query: str) -> DataFrame:
    """(key, name, matched_on): broken names that are the query, whole or abbreviated; at most ``EXPLAINED``."""
    asked = folded(query.strip())
    on = F.when(fold(F.col("name")) == asked, "name").when(fold(abbreviation(F.col("name"))) == asked, "abbreviation")
    return broken.select("key", "name", on.alias("matched_on")).where("matched_on IS NOT NULL").orderBy("key").limit(EXPLAINED)


def credited(matched: Column, *shown: Column) -> Column:
    """The matched name, unless the row already shows it."""
    seen = F.lit(False)
    for x in shown:
        seen = seen | F.coalesce(F.lower(x) == F.lower(matched), F.lit(False))
    return F.when(~seen, matched)


def caption(matched_on: Column, matched_name: Column) -> Column:
    """'who: name' for a name that only brought the row here: a synonym or a second-catalogue name."""
    who = F.when(matched_on == "synonym", "taxonomy").when(matched_on == "fossil-name", "fossils")
    return F.when(who.isNotNull() & (F.coalesce(matched_name, F.lit("")) != ""), F.concat(who, F.lit(": "), matched_name))


#: Score of an answer's first row, and what each place costs.
TOP_SCORE, PLACE_COST = 4000, 10


def row_score(order: Column, fallback: Column, session: Column | None = None) -> Column:
    """Score of a row by its place in the merged answer (else in its own list), plus what was used before."""
    base = F.lit(TOP_SCORE) - F.coalesce(order, fallback) * PLACE_COST
    return base if session is None else base + F.coalesce(session, F.lit(0.0))


def sections(rows: DataFrame, last: list[str]) -> DataFrame:
    """(place, section, key): rows (section, key, score, pos) grouped by section;
    sections stand by their best row, those in ``last`` after all others in that
    order; rows by score, equal ones as they came. An answer has a few hundred rows."""
    tail = F.coalesce(F.array_position(F.array(*map(F.lit, last)), F.col("section")), F.lit(0)) if last else F.lit(0)
    best = F.max("score").over(Window.partitionBy("section"))
    first = F.min("pos").over(Window.partitionBy("section"))
    ranked = rows.withColumn("tail", tail).withColumn("best", best).withColumn("first", first)
    place = F.row_number().over(Window.orderBy("tail", F.desc("best"), "first", F.desc("score"), "pos"))
    return ranked.select(place.cast("long").alias("place"), "section", "key")


def numbered(names: DataFrame, scores: DataFrame) -> DataFrame:
    """Give names ids in answer order without a single global partition: sort by
    range, then offset each partition's row numbers by the counts before it."""
    from ..runtime import materialise

    order = [F.col("broken"), F.desc("score"), F.col("kind"), F.length("name"), F.col("name"), F.col("idx")]
    keyed = names.join(scores, "idx", "left").withColumn("broken", F.col("kind") == 4).withColumn("score", F.coalesce("score", F.lit(0.0)))
    ranged = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    counts = ranged.groupBy("pid").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("pid", (F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    return ranged.withColumn("place", place).join(F.broadcast(before), "pid").select((F.col("place") + F.col("before")).alias("id"), "idx", "kind", "name")


def postings(names: DataFrame) -> DataFrame:
    """(term, id, pos)."""
    return names.select("id", F.posexplode(terms(F.col("name"))).alias("pos", "term")).select("term", "id", F.col("pos").cast("long").alias("pos"))


def matching(index: DataFrame, query: str, mode: str = "all_tokens") -> DataFrame:
    """(id) of names with every query term (the last one as a prefix), or with
    the terms in a row for mode 'phrase'."""
    words = [w for w in re.split(r"[\W_]+", folded(query)) if w]
    if not words:
        return index.select("id").limit(0)
    hit = lambda i, w: F.startswith("term", F.lit(w)) if i == len(words) - 1 else F.col("term") == w
    if mode == "all_tokens":
        flags = [F.max(F.when(hit(i, w), 1)).alias(f"w{i}") for i, w in enumerate(words)]
        any_hit = hit(len(words) - 1, words[-1])
        for i, w in enumerate(words[:-1]):
            any_hit = any_hit | hit(i, w)
        some = index.where(any_hit)
        return some.groupBy("id").agg(*flags).where(" AND ".join(f"w{i} = 1" for i in range(len(words)))).select("id")
    out = None
    for i, w in enumerate(words):
        rows = index.where(hit(i, w)).select("id", (F.col("pos") - i).alias("start")).distinct()
        out = rows if out is None else out.join(rows, ["id", "start"])
    return out.select("id").distinct()


def two_stage(names: DataFrame, index: DataFrame, query: str, limit: int = LIMIT, mode: str = "all_tokens") -> DataFrame:
    """(place, idx, kind, name): exact names first, by kind, then rank order; one row an idx."""
    exact = names.where(F.lower("name") == query.lower()).withColumn("stage", F.lit(0))
    rest = names.join(matching(index, query, mode), "id", "left_semi").withColumn("stage", F.lit(1))
    both = exact.unionByName(rest)
    order = [F.col("stage"), F.when(F.col("stage") == 0, F.col("kind")), F.col("id")]
    one = both.withColumn("n", F.row_number().over(Window.partitionBy("idx").orderBy(*order))).where("n = 1")
    top = one.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("place", "idx", "kind", "name")


def best_bands(names: DataFrame, query: str) -> DataFrame:
    """(idx, band, own_band, matched): best band over a node's names, and over its
    scientific names alone; broken names don't count."""
    b = names.where("kind <> 4").withColumn("band", match_band(F.col("name"), F.lit(query)).cast("long")).where(F.col("band") < NONE)
    strength = F.element_at(F.array(*map(F.lit, (6, 5, 4, 1, 0, 3))), F.col("kind").cast("int") + 1)
    return b.groupBy("idx").agg(F.min("band").alias("band"), F.min(F.when(F.col("kind") == 0, F.col("band"))).alias("own_band"), F.min_by("name", F.struct("band", -strength, "name")).alias("matched"))


def decorate(bands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Withdraw an exactness that only an alias gives: on a lone tip with fewer
    than two names, or where a head-band row is ``SIZE_RATIO`` times larger.
    nodes: (idx, tips, n_names, denotes, headline_band)."""
    j = bands.join(nodes, "idx")
    lone = (F.col("band") == EXACT) & (F.coalesce("own_band", F.lit(NONE)) != EXACT) & ~F.col("denotes")
    tip = lone & (F.col("n_names") < 2) & (F.col("tips") <= 1)
    j = j.withColumn("step", F.when(tip, HEAD).otherwise(F.col("band"))).withColumn("open", lone & ~tip & (F.coalesce("headline_band", F.lit(NONE)) > HEAD))
    largest = j.agg(F.max(F.when(F.col("step") == HEAD, F.col("tips"))).alias("largest"))
    band = F.when(F.col("open") & (F.col("tips") * SIZE_RATIO < F.coalesce("largest", F.lit(0))), HEAD).otherwise(F.col("step"))
    return j.crossJoin(F.broadcast(largest)).select("idx", band.cast("long").alias("band"), "own_band", "matched", "tips", "n_names", "denotes")  # one row


def result_order() -> list[Column]:
    """The ten keys of a search answer, then kind and idx."""
    c = F.col
    return [c("band"), c("tier"), c("is_broken"), F.desc("denotes"), F.desc("score"), F.desc("tips"), F.desc("has_image"), F.desc("measured"), F.desc("has_alias"), c("name"), c("kind"), c("idx")]


def notability(is_extant: Column, drawn: Column, broad: Column) -> Column:
    """Penalty of a second-catalogue row."""
    return (F.when(is_extant.isNull(), 4).when(is_extant, 8).otherwise(0) + F.when(drawn, 0).otherwise(2) + F.when(broad, 1).otherwise(0)).cast("long")


def second_catalogue(facts: DataFrame, query: str, limit: int = 24) -> DataFrame:
    """(fact, name, tier): primary rows not attached at their own node, exact then
    prefix then contained, notable first; overfetched fourfold, one row a name,
    banded again, cut to ``limit``."""
    q = query.lower()
    low = F.lower("name")
    tier = F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).otherwise(2).cast("long")
    some = facts.where("is_primary AND walk <> 0").where(F.contains(low, F.lit(q))).withColumn("tier", tier)
    order = [F.col("tier"), F.col("penalty"), F.desc("n_occs"), F.col("name"), F.col("fact")]
    over = some.orderBy(*order).limit(limit * 4)
    one = over.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where("n = 1").withColumn("band", match_band(F.col("name"), F.lit(query)).cast("long"))
    return one.orderBy("band", *order).limit(limit).select("fact", "name", "tier", "band")


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """(place, corpus, key, band): two ranked lists (key, band, pos) merged by
    (band, own position, corpus)."""
    both = first.withColumn("corpus", F.lit(0).cast("long")).unionByName(second.withColumn("corpus", F.lit(1).cast("long")))
    place = F.row_number().over(Window.orderBy("band", "pos", "corpus"))  # two result lists, at most 2 * MOST rows
    return both.withColumn("place", place.cast("long")).select("place", "corpus", "key", "band")


def weak(answer: DataFrame) -> DataFrame:
    """One row: best band, rows, and whether a correction should be tried."""
    a = answer.agg(F.min("band").alias("best"), F.count("*").alias("rows"))
    return a.select("best", "rows", (F.coalesce(F.col("best") > TOKEN, F.lit(True)) & (F.col("rows") <= WEAK_ROWS)).alias("weak"))


def corrected(answer_for, suggestion: str | None, query: str) -> tuple[DataFrame, str | None]:
    """Run ``answer_for(query)``; if weak, run the suggestion and return it
    instead where the first answer is empty."""
    answer = answer_for(query)
    state = weak(answer).first()
    if not state["weak"] or not suggestion:
        return answer, None
    other = answer_for(suggestion)
    better = weak(other).first()
    if not state["rows"] and better["rows"]:
        return other, suggestion
    return answer, suggestion if better["rows"] and (better["best"] or 0) < (state["best"] or NONE) else None


def hits(keys: DataFrame, nodes: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """(pos, key, idx) of known keys in the caller's order, repeats and broken keys dropped."""
    first = keys.groupBy("key").agg(F.min("pos").alias("pos"))
    if broken is not None:
        first = first.join(broken.select("key").distinct(), "key", "left_anti")
    return first.join(nodes.select("key", "idx"), "key").select("pos", "key", "idx")


def boost(uses: Column, days: Column) -> Column:
    """Recency times frequency of a remembered choice; a date to come counts as now."""
    r = F.pow(F.lit(2.0), -F.greatest(days, F.lit(0)) / HALF_LIFE)
    return F.least(uses, F.lit(USES)) * 14 * r + 40 * r


#: Fixed value: choices that are remembered.
REMEMBERED = 200


def remembered(uses: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """The ``most`` choices (key, uses, days) worth most, with their ``boost``."""
    return uses.withColumn("boost", boost(F.col("uses"), F.col("days"))).orderBy(F.desc("boost"), "key").limit(most)


def random_pool(nodes: DataFrame, pictured: DataFrame) -> DataFrame:
    """Named nodes with a picture of their own, by id."""
    return nodes.where("name IS NOT NULL").join(pictured.select("idx"), "idx", "left_semi").select("idx")


def fact_pool(facts: DataFrame, drawn: DataFrame) -> DataFrame:
    """Facts that may be drawn by lot: with a young end, that has ended, with a
    picture (drawn: accepted_id), primary, not a node of the tree itself, extinct."""
    young = F.coalesce("lla_drawn", "lla")
    some = facts.where(young.isNotNull() & (young > 0.0117) & F.col("is_primary") & (F.col("walk") != 0) & (F.col("is_extant") == False))  # noqa: E712
    return some.join(drawn.select("accepted_id").distinct(), "accepted_id", "left_semi").select("fact")


def pick(pool: DataFrame, taken: DataFrame, roll: float) -> DataFrame:
    """The pool row at ``floor(roll * n)`` once taken rows are left out."""
    left = pool.join(taken, "idx", "left_anti")
    n = left.count()
    return left.orderBy("idx").offset(min(n - 1, int(roll * n))).limit(1) if n else left


def audit(found: DataFrame, scanned: DataFrame) -> DataFrame:
    """(invented, dropped): ids the index gave but a scan doesn't, and the reverse."""
    a = found.select("id").subtract(scanned.select("id")).agg(F.count("*").alias("invented"))
    b = scanned.select("id").subtract(found.select("id")).agg(F.count("*").alias("dropped"))
    return a.crossJoin(b)  # one row each
