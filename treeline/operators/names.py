"""Evidence-based ranking of a node's names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import fold

#: Band of each kind of evidence, worst band.
BANDS = {"title": 1, "redirect": 2, "declared": 3, "label": 4, "alias": 5}
WORST = 6


def evidence(name_target: Column, own_target: Column, asked: Column, title: Column, name: Column) -> Column:
    """'title', 'redirect', 'elsewhere', 'none', or null if never asked."""
    same = F.lower(title) == F.lower(name)
    return F.when(~asked, None).when(name_target.isNull(), F.lit("none")).when(name_target != own_target, F.lit("elsewhere")).when(same, F.lit("title")).otherwise(F.lit("redirect"))


def band(kind: Column, found: Column) -> Column:
    """Band of a name by its evidence, else its kind (v declared, l label, a alias);
    evidence that points elsewhere costs one band."""
    own = F.when(kind == "v", BANDS["declared"]).when(kind == "l", BANDS["label"]).otherwise(BANDS["alias"])
    return F.when(found == "title", BANDS["title"]).when(found == "redirect", BANDS["redirect"]).when(found == "elsewhere", F.least(own + 1, F.lit(WORST))).otherwise(own).cast("long")


#: Endings of Latin clade names, least and most letters of a stem.
LATIN_ENDINGS = ("aceae", "idae", "inae", "oidea", "ales", "aria", "ae", "a", "um", "us", "on", "es")
LEAST_STEM, MOST_STEM = 5, 8


def mangled(name: Column, scientific: Column) -> Column:
    """Whether a name abbreviates its own binomial in another form than 'X. epithet'."""
    words = F.split(F.trim(scientific), r"\s+")
    genus, epithet = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    first = F.substring(genus, 1, 1)
    squashed = F.regexp_replace(fold(name), r"[^\p{L}\p{N}]", "")
    same = (squashed == F.concat(fold(first), fold(epithet))) & (fold(F.trim(name)) != fold(F.concat(first, F.lit(". "), epithet)))
    return F.coalesce((F.size(words) == 2) & same, F.lit(False))


def shape(name: Column, scientific: Column | None = None) -> Column:
    """Penalty of a name's form: trailing punctuation and brackets two each, a comma,
    a leading article, a mangled abbreviation and four words or more one each, a
    single Latin-looking word two."""
    n = F.trim(name)
    latin = f"^[A-Z][a-z]+({'|'.join(LATIN_ENDINGS)})$"
    flags = [(n.rlike(r"[,;:]\s*$"), 2), (n.rlike(r"[(\[]"), 2), (F.contains(n, F.lit(",")), 1), (n.rlike(r"(?i)^(the|a|an)\s+"), 1), (n.rlike(latin), 2), (F.size(F.split(n, r"\s+")) >= 4, 1)]
    if scientific is not None:
        flags.append((mangled(n, scientific), 1))
    return sum((F.when(c, w).otherwise(0) for c, w in flags), F.lit(0)).cast("long")


def stem_shared(name: Column, scientific: Column) -> Column:
    """Whether a name (without its spaces) begins like the first scientific word."""
    stem = F.substring(fold(F.split_part(F.trim(scientific), F.lit(" "), F.lit(1))), 1, MOST_STEM)
    begins = F.startswith(fold(F.regexp_replace(name, " ", "")), F.substring(stem, 1, LEAST_STEM))
    return F.coalesce((F.length(stem) >= LEAST_STEM) & begins, F.lit(False))


def ranked(names: DataFrame) -> DataFrame:
    """names (idx, lang, name, band, stem, n_sources) + usage_rank: by band, then
    stem-sharing last where the band has a stem-free name, then sources, shape,
    words, length, name."""
    free = F.max(~F.col("stem")).over(Window.partitionBy("idx", "lang", "band"))
    s = names.withColumn("stemmy", F.col("stem") & free).withColumn("shape", shape(F.col("name")))
    order = ["band", "stemmy", F.desc("n_sources"), "shape", F.size(F.split("name", r"\s+")), F.length("name"), "name"]
    return s.withColumn("usage_rank", F.row_number().over(Window.partitionBy("idx", "lang").orderBy(*order)).cast("long"))


def headline(rows: DataFrame) -> DataFrame:
    return rows.where("usage_rank = 1").select("idx", "lang", "name")


def best_name(rows: DataFrame) -> DataFrame:
    """Least rank, nulls last, then name."""
    return rows.groupBy("idx", "lang").agg(F.min(F.struct(F.coalesce("usage_rank", F.lit(1 << 40)).alias("r"), "name")).alias("b")).select("idx", "lang", F.col("b.name").alias("name"))


def primary(rows: DataFrame) -> DataFrame:
    """Add ``is_primary``: whether a row is its node's and language's first."""
    return rows.withColumn("is_primary", F.col("usage_rank") == 1)


def census(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after ranking, and groups without exactly one primary; ranking may not lose or add rows."""
    firsts = after.groupBy("idx", "lang").agg(F.count_if("is_primary").alias("n")).agg(F.count_if(F.col("n") != 1).alias("odd_groups"))
    return before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).crossJoin(firsts)  # one row each


def all_names(rows: DataFrame) -> DataFrame:
    """(idx, lang, names): every name of a node in rank order, unranked ones last by name."""
    order = F.struct(F.coalesce("usage_rank", F.lit(1 << 40)).alias("r"), "name")
    return rows.groupBy("idx", "lang").agg(F.array_sort(F.collect_set(order)).alias("n")).select("idx", "lang", F.array_join(F.transform("n", lambda x: x["name"]), "|").alias("names"))


#: Ranks whose nodes take a common name, generic heads that identify nothing.
NAMED_RANKS = ("genus", "species", "subspecies")


def takes_name(rank: Column, name: Column, scientific: Column) -> Column:
    """Whether a common name may stand for a node: its rank takes one, and the name
    is not the scientific name over again."""
    return F.coalesce(rank.isin(*NAMED_RANKS) & (fold(name) != fold(scientific)), F.lit(False))


def target(pages: DataFrame) -> DataFrame:
    """(idx, qid, title): of an idx's pages the one with the least numeric id."""
    number = F.expr("try_cast(substring(qid, 2) AS BIGINT)")
    return pages.groupBy("idx").agg(F.min_by(F.struct("qid", "title"), F.struct(number, "qid")).alias("b")).select("idx", "b.qid", "b.title")


def display(name: Column) -> Column:
    """First letter in capitals, unless the second already is."""
    second = F.substring(name, 2, 1)
    return F.when((second != F.lower(second)), name).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name))))


def head_word(name: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(name)), r"\s+"), -1)


def coverage(nodes: DataFrame, named: DataFrame, top: int) -> DataFrame:
    """One row: share of nodes with a name, weighted by tips, and among the ``top`` largest."""
    j = nodes.join(named.select("idx").distinct().withColumn("has", F.lit(1.0)), "idx", "left").withColumn("has", F.coalesce("has", F.lit(0.0)))
    largest = j.orderBy(F.desc("tips"), "idx").limit(top).agg(F.round(F.avg("has"), 6).alias("largest"))
    return j.agg(F.round(F.avg("has"), 6).alias("plain"), F.round(F.try_divide(F.sum(F.col("has") * F.col("tips")), F.sum("tips")), 6).alias("weighted")).crossJoin(largest)  # one row each
