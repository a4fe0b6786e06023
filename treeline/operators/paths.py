"""Ancestor-path queries over a numbered tree with lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, small
from .tree import fold_down, fold_up, in_layers

NO_IDS = "array<bigint>"


def path_to_root(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, step, anc): root first, step 0 at the root."""
    own = tree.join(small(chosen.select("id").distinct()), "id", "left_semi")
    return own.select("id", F.posexplode(F.reverse("lineage")).alias("step", "anc")).withColumn("step", F.col("step").cast("long"))


def is_above(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, above): whether u is v or above it, by intervals; pairs of unknown nodes have no row."""
    at = tree.select("id", "idx", "size")
    j = pairs.join(at.select(F.col("id").alias("u"), F.col("idx").alias("_u"), F.col("size").alias("_s")), "u").join(at.select(F.col("id").alias("v"), F.col("idx").alias("_v")), "v")
    return j.select("u", "v", ((F.col("_u") <= F.col("_v")) & (F.col("_v") < F.col("_u") + F.col("_s"))).alias("above"))


def common_ancestor(tree: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """(group, mrca): the deepest node that is above or is every chosen node of a group:
    the deepest on the first one's lineage whose interval reaches to the last one."""
    at = tree.select("id", F.struct("idx", "id").alias("_place"), (F.col("idx") + F.col("size")).alias("_stop"))
    span = chosen.select(group, "id").join(at.hint("merge"), "id", "left").groupBy(group).agg(F.min("_place.idx").alias("_low"), F.min("_place").alias("_first"), F.max("_stop").alias("_high"), F.count_if(F.col("_place").isNull()).alias("_unknown"))
    span = materialise(span.where("_unknown = 0").select(group, F.col("_first.id").alias("id"), "_high"))
    ups = materialise(tree.select("id", "lineage").join(small(span), "id").select(group, "_high", F.explode("lineage").alias("anc")))
    known = tree.select(F.col("id").alias("anc"), "idx", (F.col("idx") + F.col("size")).alias("_stop"))
    return known.join(small(ups), "anc").where("_stop >= _high").groupBy(group).agg(F.max_by("anc", "idx").alias("mrca"))


def induced_subtree(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """The smallest tree that shows the chosen nodes: (id, anc, suppressed, is_selected, is_mrca).

    Rendered are the chosen nodes, their common ancestor, and every node between
    with two or more marked children; ``anc`` is the nearest rendered node above
    and ``suppressed`` what lies between, top down.  Unknown ids and repeats are
    ignored.  The selection is small (it is what a user picked), so its lineages
    are; the whole tree is only read once, filtered by a semi-join.
    """
    picked = tree.join(small(chosen.select("id").distinct()), "id", "left_semi").select("id", F.reverse("lineage").alias("path"))
    picked = materialise(picked)
    n = picked.count()
    if not n:
        return picked.select("id", F.lit(None).cast("long").alias("anc"), F.array().cast(NO_IDS).alias("suppressed"), F.lit(True).alias("is_selected"), F.lit(False).alias("is_mrca"))
    steps = picked.select("id", F.posexplode("path").alias("depth", "node"))
    counted = steps.groupBy("node").agg(F.count("*").alias("below"), F.first("depth").alias("depth"))
    top = counted.where(F.col("below") == n).agg(F.max(F.struct("depth", "node")).alias("m")).select(F.col("m.node").alias("mrca"), F.col("m.depth").alias("top"))
    pairs = picked.crossJoin(F.broadcast(top)).select("id", "mrca", F.slice("path", F.col("top") + 1, F.size("path")).alias("path"))  # one row
    edges = pairs.select(F.explode(F.arrays_zip(F.col("path").alias("up"), F.slice("path", 2, F.size("path")).alias("down"))).alias("e")).where("e.down IS NOT NULL").select("e.up", "e.down").distinct()
    forks = edges.groupBy("up").count().where("count > 1").select(F.col("up").alias("id"))
    rendered = picked.select("id").union(forks).union(top.select("mrca")).distinct()
    names = rendered.agg(F.collect_set("id").alias("shown"))  # at most 2n - 1 ids
    paths = pairs.select("mrca", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("p"))
    last = paths.select("mrca", F.element_at("p", -1).alias("id"), F.slice("p", F.lit(1), F.size("p") - 1).alias("above")).distinct().join(small(rendered), "id", "left_semi")
    up = last.crossJoin(F.broadcast(names)).withColumn("marks", F.filter("above", lambda x: F.array_contains("shown", x)))
    anc = F.when(F.size("marks") > 0, F.element_at("marks", -1))
    own = up.select("id", "mrca", anc.alias("anc"), "above").withColumn("suppressed", F.when(F.col("anc").isNotNull(), F.slice("above", F.array_position("above", F.col("anc")).cast("int") + 1, F.size("above"))).otherwise(F.array().cast(NO_IDS)))
    return own.join(picked.select("id", F.lit(True).alias("is_selected")), "id", "left").select("id", "anc", "suppressed", F.coalesce("is_selected", F.lit(False)).alias("is_selected"), (F.col("id") == F.col("mrca")).alias("is_mrca"))


def segment(tree: DataFrame, upper: int, lower: int) -> DataFrame:
    """(id, step) strictly between two nodes of one path, and the lower one; no
    rows unless ``upper`` is above ``lower``."""
    chain = tree.where(F.col("id") == lower).select(F.reverse("lineage").alias("path")).where(F.array_contains("path", upper))
    below = chain.select(F.slice("path", F.array_position("path", F.lit(upper)).cast("int") + 1, F.size("path")).alias("p"))
    return below.select(F.posexplode("p").alias("step", "id")).select("id", F.col("step").cast("long").alias("step"))


def resolve_keys(asked: DataFrame, nodes: DataFrame, forwards: DataFrame, broken: DataFrame) -> DataFrame:
    """(key, id, status): direct, then broken, then forwarded, then forwarded to
    broken; unknown keys stay, with status 'unknown'."""
    a = asked.select("key").distinct()
    n = nodes.select(F.col("ext").alias("key"), F.col("id").alias("direct"))
    b = broken.select(F.col("ext").alias("key"), F.col("id").alias("split"))
    f = forwards.select(F.col("old").alias("key"), F.col("new").alias("to"))
    hit = a.join(n, "key", "left").join(b, "key", "left").join(f, "key", "left")
    hit = hit.join(n.select(F.col("key").alias("to"), F.col("direct").alias("f_direct")), "to", "left").join(b.select(F.col("key").alias("to"), F.col("split").alias("f_split")), "to", "left")
    status = F.when(F.col("direct").isNotNull(), "node").when(F.col("split").isNotNull(), "broken").when(F.col("f_direct").isNotNull(), "forwarded").when(F.col("f_split").isNotNull(), "forwarded_broken").otherwise("unknown")
    return hit.select("key", F.coalesce("direct", "split", "f_direct", "f_split").alias("id"), status.alias("status"))


def layout_spread(tree: DataFrame, ages: DataFrame) -> DataFrame:
    """(id, above, above_hops, below): of nodes without an age, the nearest dated
    ancestor's age and the oldest positive age beneath."""
    known = ages.select("id", "age")
    t = in_layers(tree).select("id", "parent", "child_count", "layer").join(known.hint("merge"), "id", "left").withColumn("below", F.when(F.col("age") > 0, F.col("age")))
    t = fold_up(t, {"below": "max"})
    t = t.withColumn("_up", F.struct(F.col("age").alias("above"), F.lit(0).cast("long").alias("hops")))
    near = lambda a, b: F.when(a["above"].isNotNull(), a).otherwise(F.struct(b["above"].alias("above"), (a["hops"] + b["hops"] + 1).alias("hops")))
    found = fold_down(t, "_up", near).where("age IS NULL").select("id", F.col("_up.above").alias("above"), F.when(F.col("_up.above").isNotNull(), F.col("_up.hops")).alias("above_hops"), "below")
    return known.where("age IS NULL").select("id").join(found.hint("merge"), "id", "left")


def spread_kind(above, below):
    """'between' two dates, 'toPresent' from one to now, 'collapsed' onto one, or null."""
    return F.when(above.isNull(), None).when(below.isNull(), F.lit("toPresent")).when(above > below, F.lit("between")).otherwise(F.lit("collapsed"))


def same_clades(first: DataFrame, second: DataFrame) -> DataFrame:
    """(clades, side): tip sets (id, tip) held by one of two trees only, counted.
    A set is known by its number of tips and two sums of their 64-bit hashes, so no
    row holds a set: two sets agree by chance with probability about 2^-128."""
    print_ = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("tip")).alias("x"), F.bit_xor(F.xxhash64("tip", F.lit(1))).alias("y")]
    sets = lambda t: t.distinct().groupBy("id").agg(*print_).select("n", "x", "y").distinct()
    a, b = sets(first), sets(second)
    return a.subtract(b).withColumn("side", F.lit("first")).unionByName(b.subtract(a).withColumn("side", F.lit("second"))).groupBy("side").agg(F.count("*").alias("clades"))


def descendants(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """(of, id): all nodes below each asked node (of), itself first in preorder: a
    node lies below another if its position is within that one's interval, which is
    the same as having it in its lineage, an equi-join."""
    below = tree.select("id", F.explode("lineage").alias("of"))
    return below.join(small(asked.select("of").distinct()), "of", "left_semi").select("of", "id")


def interval(tree: DataFrame, node: int) -> DataFrame:
    """The rows of one node's subtree, by a filter on positions."""
    top = tree.where(F.col("id") == node).select(F.col("idx").alias("_low"), (F.col("idx") + F.col("size")).alias("_stop"))
    return tree.crossJoin(F.broadcast(top)).where((F.col("idx") >= F.col("_low")) & (F.col("idx") < F.col("_stop"))).drop("_low", "_stop")  # one row


#: Fixed value: keys of one batch.
BATCH = 200


def batch_paths(tree: DataFrame, asked: DataFrame, nodes: DataFrame, forwards: DataFrame, broken: DataFrame) -> DataFrame:
    """(key, id, status, path): the path from the root of every asked key; a key
    that is unknown has a status and a null path and does not fail the others.
    More than ``BATCH`` distinct keys are refused."""
    if asked.select("key").distinct().limit(BATCH + 1).count() > BATCH:
        raise ValueError(f"a batch has at most {BATCH} keys")
    found = resolve_keys(asked, nodes, forwards, broken)
    return found.join(tree.select("id", F.reverse("lineage").alias("path")), "id", "left").select("key", "id", "status", "path")


def resolution(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(pos, key, part): a resolved batch in the caller's order as 'ok', 'broken'
    (dropped from a selection) or 'unresolved'."""
    part = F.when(F.col("status").isin("node", "forwarded"), "ok").when(F.col("status").isin("broken", "forwarded_broken"), "broken").otherwise("unresolved")
    first = asked.groupBy("key").agg(F.min("pos").alias("pos"))
    return found.join(first, "key").select("pos", "key", part.alias("part"))


def ladder(tree: DataFrame, chosen: DataFrame, ranks: list[str]) -> DataFrame:
    """(id, rank, node): narrowest node of each rank on the way up; inner ranks
    that are missing have a null node, outer ones no row."""
    order = F.create_map(*[x for i, r in enumerate(ranks) for x in (F.lit(r), F.lit(i))])
    own = chosen.select("id").distinct().join(tree.select("id", "lineage"), "id").select("id", F.posexplode("lineage").alias("hops", "anc"))
    ranked = own.join(tree.select(F.col("id").alias("anc"), "rank"), "anc").where(F.col("rank").isin(ranks))
    best = ranked.groupBy("id", "rank").agg(F.min_by("anc", "hops").alias("node")).withColumn("place", order[F.col("rank")])
    span = best.groupBy("id").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    every = span.select("id", F.explode(F.sequence("low", "high")).alias("place")).withColumn("rank", F.get(F.array(*map(F.lit, ranks)), F.col("place")))
    return every.join(best.select("id", "place", "node"), ["id", "place"], "left").select("id", "rank", "node")


def short_binomial(name):
    """'Homo sapiens' as 'H. sapiens'; other names as they are."""
    return F.when(name.rlike(r"^\p{Lu}\p{Ll}+ \p{Ll}[\p{Ll}-]+$"), F.concat(F.substring(name, 1, 1), F.lit(". "), F.split_part(name, F.lit(" "), F.lit(2)))).otherwise(name)


def fork_names(branches: DataFrame, shown: int = 3, shorten: bool = False) -> DataFrame:
    """(fork, label): the first name of each branch (branch order, then place in
    the branch), at most ``shown`` and '+n' for the rest; genera abbreviated if
    ``shorten``."""
    if shorten:
        branches = branches.withColumn("name", short_binomial(F.col("name")))
    first = branches.where("name IS NOT NULL").groupBy("fork", "branch").agg(F.min_by("name", "place").alias("name"))
    grouped = first.groupBy("fork").agg(F.array_sort(F.collect_list(F.struct("branch", "name"))).alias("b"))
    names = F.array_join(F.transform(F.slice("b", 1, shown), lambda x: x["name"]), ", ")
    return grouped.select("fork", F.when(F.size("b") > shown, F.concat(names, F.lit(" +"), (F.size("b") - shown).cast("string"))).otherwise(names).alias("label"))


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, flare, wave): rows of an induced tree (id, anc) that weren't rendered
    before, with the nearest rendered-before ancestor and the hops to it."""
    old = before.select("id").withColumn("was", F.lit(True))
    state = materialise(after.join(old, "id", "left").select("id", "anc", F.coalesce("was", F.lit(False)).alias("was")))
    fresh = state.where("NOT was").select("id", F.col("anc").alias("flare"), F.lit(1).cast("long").alias("wave"))
    up = state.select(F.col("id").alias("flare"), F.col("anc").alias("next"), "was")
    while True:
        joined = fresh.join(up, "flare", "left")
        if joined.where("NOT was").isEmpty():
            return fresh
        move = F.col("was").isNotNull() & ~F.col("was")
        fresh = joined.select("id", F.when(move, F.col("next")).otherwise(F.col("flare")).alias("flare"), F.when(move, F.col("wave") + 1).otherwise(F.col("wave")).alias("wave"))


def nested(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, within): chosen nodes below another chosen node, and the nearest such."""
    picked = chosen.select("id").distinct()
    ups = picked.join(tree.select("id", "lineage"), "id").select("id", F.posexplode("lineage").alias("hops", "within")).where("hops > 0")
    return ups.join(small(picked.select(F.col("id").alias("within"))), "within", "left_semi").groupBy("id").agg(F.min_by("within", "hops").alias("within"))


def place_of(attached: DataFrame, induced: DataFrame) -> DataFrame:
    """(fact, place, at): whether an attachment point is rendered, suppressed in a
    segment (then ``at`` is the segment's lower end), or off the induced tree."""
    shown = induced.select(F.col("id").alias("attach"), F.col("id").alias("seen"))
    hidden = induced.select(F.explode("suppressed").alias("attach"), F.col("id").alias("lower"))
    j = attached.join(shown, "attach", "left").join(hidden, "attach", "left")
    place = F.when(F.col("seen").isNotNull(), "rendered").when(F.col("lower").isNotNull(), "suppressed").otherwise("off_tree")
    return j.select("fact", place.alias("place"), F.coalesce("seen", "lower").alias("at"))


def best_in_window(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
