"""Deterministic layout figures of an induced tree, grafted facts and lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

#: Rows a lane places, names it lists beside them.
PLACED, LISTED = 8, 5


def rows(induced: DataFrame, depth: str = "depth") -> DataFrame:
    """(id, y): leaves in preorder get rows 0, 1, ...; an inner node stands midway
    between its outermost children. induced: (id, anc, idx, depth); it is small
    (twice a selection), so one window numbers the leaves."""
    induced = materialise(induced)
    inner = induced.where("anc IS NOT NULL").select(F.col("anc").alias("id")).distinct()
    leaves = induced.join(inner, "id", "left_anti")
    known = leaves.select("id", (F.row_number().over(Window.orderBy("idx")) - 1).cast("double").alias("y"))
    levels = [r[0] for r in induced.select(depth).distinct().orderBy(F.desc(depth)).collect()]
    for level in levels:
        kids = induced.select("id", "anc").join(known, "id").groupBy(F.col("anc").alias("id")).agg(((F.min("y") + F.max("y")) / 2).alias("y"))
        here = induced.where(F.col(depth) == level).join(inner, "id", "left_semi").select("id")
        known = materialise(known.unionByName(here.join(kids, "id")))
    return known


def columns(nodes: DataFrame, floor: float = 1.0, oldest: float | None = None) -> DataFrame:
    """(id, x): share of the oldest age (at least ``floor``) on a linear axis, or on
    the symmetric-log one that ends at ``oldest``."""
    from .timescale import symlog

    if oldest is not None:
        return nodes.select("id", F.round(1 - symlog(F.least("age_layout", F.lit(float(oldest))), oldest), 6).alias("x"))
    most = nodes.agg(F.greatest(F.max("age_layout"), F.lit(floor)).alias("most"))
    return nodes.crossJoin(F.broadcast(most)).select("id", F.round(1 - F.col("age_layout") / F.col("most"), 6).alias("x"))  # one row


def graft_rows(placed: DataFrame) -> DataFrame:
    """(key, anchor, row): the order of an anchor's grafts, youngest branch first, then key."""
    w = Window.partitionBy("anchor").orderBy("join_age", F.desc("key"))
    return placed.where("refused IS NULL").select("key", "anchor", (F.row_number().over(w) - 1).cast("long").alias("row"))


def intermediates(nodes: DataFrame, by: str) -> DataFrame:
    """(by, id, place): what a segment suppresses, named and ranked nodes first, then
    named ones, then the rest, each by tips. nodes: (by, id, name, rank, tips)."""
    kind = F.when(F.coalesce("name", F.lit("")) == "", 0).when(F.coalesce("rank", F.lit("")).isin("", "no rank"), 1).otherwise(2)
    w = Window.partitionBy(by).orderBy(F.desc(kind), F.desc("tips"), "id")
    return nodes.select(by, "id", F.row_number().over(w).cast("long").alias("place"))


def grafts(facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, anchor, join_age, join_at, refused): where a fact's branch leaves the
    tree. Keys are negative so that they never alias a node. The branch leaves at
    the fact's oldest bound if that lies between the anchor and the node above it,
    else at the nearer of the two. anchors: (attach, anchor, low, high)."""
    j = facts.join(anchors, "attach", "left")
    old = F.greatest("fea", "lea", "lla")
    age = F.least(F.greatest(old, F.col("low")), F.coalesce("high", old))
    at = F.when(old < F.col("low"), "anchor").when(old > F.col("high"), "parent").otherwise("edge")
    refused = F.when(F.col("fact").isNull(), "no_identity").when(old.isNull(), "no_range").when(F.col("anchor").isNull(), "off_tree")
    keep = lambda c: F.when(refused.isNull(), c)
    return j.select((-F.col("fact")).alias("key"), keep(F.col("anchor")).alias("anchor"), keep(age).alias("join_age"), keep(at).alias("join_at"), refused.alias("refused"))


def lane(items: DataFrame, by: str, order: list, dated) -> DataFrame:
    """(by, shown, total, placed, listed): of each group's rows the first ``PLACED``
    that are ``dated`` have a row; those that are not are named, ``LISTED`` of them,
    and the rest counted."""
    n = items.withColumn("dated", F.coalesce(dated, F.lit(False))).withColumn("n", F.row_number().over(Window.partitionBy(by, "dated").orderBy(*order)))
    names = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", "name")))), lambda x: x["name"]), ", ")
    placed, listed = F.col("dated") & (F.col("n") <= PLACED), ~F.col("dated") & (F.col("n") <= LISTED)
    got = n.groupBy(by).agg(F.count_if(placed | ~F.col("dated")).alias("shown"), F.count("*").alias("total"), names(placed).alias("placed"), names(listed).alias("listed"), F.count_if(~F.col("dated") & (F.col("n") > LISTED)).alias("more"))
    return got.select(by, "shown", "total", "placed", F.when(F.col("more") > 0, F.concat("listed", F.lit(" and "), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.col("listed")).alias("listed"))
