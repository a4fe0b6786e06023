"""Composed views that the endpoints read, and the view-state codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_CAP = 200


def entry(nodes: DataFrame, images: DataFrame, ages: DataFrame, witnesses: DataFrame, names: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One wide row a node: picture, age (never with a structural tier), witness, name, occurrence."""
    j = nodes
    for other in (images, ages, witnesses, names, occurrences):
        j = j.join(other, "id", "left")
    return j.withColumn("age", F.when(F.col("tier").isin(0, 1), F.col("age"))).withColumn("tier", F.coalesce("tier", F.lit(2).cast("long")))


def segment_facts(facts: DataFrame, chain: DataFrame) -> DataFrame:
    """(total, n, name): facts attached on a segment, notable first, one a name, cut; total counts distinct names."""
    on = facts.join(chain.select(F.col("id").alias("attach")), "attach", "left_semi")
    order = ["penalty", F.desc("n_occs"), "name"]
    one = on.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(*order, "fact"))).where("k = 1")
    total = on.agg(F.count_distinct("name").alias("total"))
    top = one.orderBy(*order, "fact").limit(SEGMENT_CAP)
    return top.withColumn("n", F.row_number().over(Window.orderBy(*order, "fact")).cast("long")).crossJoin(F.broadcast(total)).select("total", "n", "fact", "name")  # one row


def fact_detail(facts: DataFrame, fact: int, entries: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """One fact with the entry it attaches to and the credit of its picture (accepted_id, credit)."""
    out = facts.where(F.col("fact") == fact).join(entries.withColumnRenamed("id", "attach"), "attach", "left")
    return out if credits is None else out.join(credits, "accepted_id", "left")


def node_detail(nodes: DataFrame, asked: DataFrame, synonyms: DataFrame, names: DataFrame, pages: DataFrame, credits: DataFrame, parents: DataFrame, spread: DataFrame) -> DataFrame:
    """Everything about the asked nodes (id): name, parent's name, synonyms and common
    names in order, page id, picture credit, and where an undated node lies between
    dates. Names of one node are few; asked ids are a request's."""
    some = nodes.join(F.broadcast(asked.select("id").distinct()), "id", "left_semi")
    lists = lambda df, order, name: df.join(some.select("id"), "id", "left_semi").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(*order, "name"))), lambda x: x["name"]), "|").alias(name))
    up = parents.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    out = some.join(up, "parent", "left").join(lists(synonyms, [], "synonyms"), "id", "left").join(lists(names, ["usage_rank"], "names"), "id", "left")
    for other in (pages, credits, spread):
        out = out.join(other, "id", "left")
    return out.withColumn("synonyms", F.coalesce("synonyms", F.lit(""))).withColumn("names", F.coalesce("names", F.lit("")))


def lookup(pages: DataFrame, qid: str) -> DataFrame:
    """Least node that a page id names."""
    return pages.where(F.col("qid") == qid).agg(F.min("idx").alias("idx"))


def about(tables: dict[str, DataFrame], tiers: DataFrame | None = None, phases: list[tuple[str, bool]] = (), features: dict[str, bool] | None = None) -> DataFrame:
    """(name, rows): rows of every table, nodes of every tier, and for phases and
    features 1 if they passed or are there."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in sorted(tables.items())]
    if tiers is not None:
        parts.append(tiers.groupBy(F.concat(F.lit("tier "), F.col("tier").cast("string")).alias("name")).agg(F.count("*").alias("rows")))
    told = [(f"phase {n}", int(ok)) for n, ok in phases] + [(f"feature {n}", int(ok)) for n, ok in (features or {}).items()]
    if told:
        parts.append(parts[0].sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {k}L)" for n, k in told) + " AS t(name, rows)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def view_state(url: Column) -> Column:
    """Query keys of a view address: split, trimmed, lower-cased, distinct, in order."""
    raw = F.coalesce(F.parse_url(url, F.lit("QUERY"), F.lit("keys")), F.lit(""))
    return F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


#: Fixed value: letters from which on a query is run.
LEAST_QUERY = 2


def suggestions(recent: DataFrame, curated: DataFrame, query: str = "") -> DataFrame:
    """(band, pos, key): recents, then curated rows that aren't among them; nothing
    once there is a query to run."""
    if len(query.strip()) >= LEAST_QUERY:
        recent, curated = recent.limit(0), curated.limit(0)
    a = recent.select(F.lit(0).cast("long").alias("band"), "pos", "key")
    return a.unionByName(curated.join(recent.select("key"), "key", "left_anti").select(F.lit(1).cast("long").alias("band"), "pos", "key"))


def recents(uses: DataFrame, build: str, most: int = 6) -> DataFrame:
    """(key, pos): last uses of this build, newest first, one a key."""
    last = uses.where(F.col("build") == build).groupBy("key").agg(F.max("ts").alias("ts"))
    return last.orderBy(F.desc("ts"), "key").limit(most).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("ts"), "key")).cast("long")).select("key", "pos")


def legend(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Distinct drawn (tier, unbounded) pairs in the order of a small dimension."""
    return edges.select("tier", "unbounded").distinct().join(order, ["tier", "unbounded"]).select("place", "tier", "unbounded")


def brightness(tier: Column) -> Column:
    return F.when(tier == 0, 1.0).when(tier == 1, 0.75).when(tier == 3, 0.6).otherwise(0.45)


def enqueue(wanted: DataFrame, queue: DataFrame, shown: DataFrame) -> DataFrame:
    """(pos, key): new keys in order, without queued, shown or repeated ones."""
    first = wanted.groupBy("key").agg(F.min("pos").alias("pos"))
    return first.join(queue.select("key").union(shown.select("key")), "key", "left_anti").select("pos", "key")


def focus(induced: DataFrame, tree: DataFrame, focused: int) -> DataFrame:
    """(id, dimmed): rendered nodes off the focused node's path are dimmed."""
    line = tree.where(F.col("id") == focused).select(F.explode("lineage").alias("id")).withColumn("on", F.lit(True))
    return induced.join(line, "id", "left").select("id", F.coalesce(~F.col("on"), F.lit(True)).alias("dimmed"))


def curated(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(list, pos, key, idx): ordered key lists (list, keys) with the nodes they name; unknown keys are left out."""
    each = lists.select("list", F.posexplode("keys").alias("pos", "key"))
    return each.join(nodes.select("key", "idx"), "key").select("list", F.col("pos").cast("long").alias("pos"), "key", "idx")


def selection_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change): 'added', 'removed' or 'kept' between two selections; an empty
    selection after one with keys is a clearing, all removed."""
    j = before.select("key").distinct().withColumn("was", F.lit(True)).join(after.select("key").distinct().withColumn("now", F.lit(True)), "key", "full")
    return j.select("key", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("kept").alias("change"))
