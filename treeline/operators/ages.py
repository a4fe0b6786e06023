"""Dated trees: ages from branch lengths, clade agreement, tiers, layout ages, bounds.

Three values stay apart: ``age`` (what may be shown, null = nothing), ``tier``
(how it is known) and ``age_layout`` (where a node is drawn, never null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, split
from .tree import fold_down, fold_up, in_layers

MEASURED, INTERPOLATED, STRUCTURAL, OCCURRENCE = 0, 1, 2, 3
PRESENT = 1e-3


def node_ages(tree: DataFrame, lengths: DataFrame) -> DataFrame:
    """(id, oldest, youngest): greatest and least distance to a tip beneath; equal
    on an ultrametric tree. lengths: (id, length) of the branch above each node; a
    missing one is 0.  Distances from the root go down the tree, those of tips back up."""
    t = in_layers(tree).select("id", "parent", "child_count", "layer")
    own = lengths.groupBy("id").agg(F.sum("length").alias("_d")).hint("merge")
    far = fold_down(t.join(own, "id", "left").withColumn("_d", F.coalesce("_d", F.lit(0.0))), "_d", lambda a, b: a + b)
    tip = F.when(F.col("child_count") == 0, F.col("_d"))
    both = fold_up(far.withColumns({"_hi": tip, "_lo": tip}), {"_hi": "max", "_lo": "min"})
    return both.select("id", (F.col("_hi") - F.col("_d")).alias("oldest"), (F.col("_lo") - F.col("_d")).alias("youngest"))


def congruence(ours: DataFrame, theirs: DataFrame, matches: DataFrame, least: int = 2) -> DataFrame:
    """(id, other, shared, class) of every matched node (id, other) with ``least``
    shared tips or more beneath it: 'identical' if both clades hold the same shared
    tips, 'subset' if all of ours lie within the matched clade, else 'conflict'.

    Both trees are numbered in preorder, so a clade is an interval of positions and
    its shared tips lie within it if the first and the last of them do.
    ours, theirs: (id, parent, idx, size, is_tip).
    """
    pairs = materialise(matches.select("id", "other").distinct())
    tips = lambda t, name: t.where("is_tip").select(F.col("id").alias(name), F.col("idx").alias(f"at_{name}"))
    shared = materialise(pairs.join(tips(ours, "id").hint("merge"), "id").join(tips(theirs, "other").hint("merge"), "other"))
    mine = shared.groupBy("id").agg(F.count("*").alias("shared"), F.min("at_other").alias("first"), F.max("at_other").alias("last")).hint("merge")
    above = lambda t, own, how: fold_up(in_layers(t.select("id", "parent")).select("id", "parent", "layer").join(own, "id", "left"), how)
    here = above(ours, mine, {"shared": "sum", "first": "min", "last": "max"}).select("id", "shared", "first", "last").where(F.col("shared") >= least)
    there = above(theirs, shared.groupBy(F.col("other").alias("id")).agg(F.count("*").alias("held")).hint("merge"), {"held": "sum"}).select(F.col("id").alias("other"), "held")
    span = theirs.select(F.col("id").alias("other"), "idx", (F.col("idx") + F.col("size")).alias("stop"))
    j = pairs.join(here, "id").join(span, "other").join(there, "other", "left")
    inside = (F.col("first") >= F.col("idx")) & (F.col("last") < F.col("stop"))
    kind = F.when(inside & (F.col("held") == F.col("shared")), "identical").when(inside, "subset").otherwise("conflict")
    return j.select("id", "other", "shared", kind.alias("class"))


def tiers(tree: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, age, tier). matches: (id, other_age, class) with class shared_tip,
    identical, subset, conflict or matched; the last rule that applies wins."""
    found = matches.groupBy("id").agg(F.max("other_age").alias("a"), *[F.bool_or(F.col("class") == c).alias(c) for c in ("shared_tip", "identical", "subset", "conflict")])
    t = tree.select("id").join(found, "id", "left")
    has = F.col("a").isNotNull()
    tier = (
        F.when(F.coalesce("conflict", F.lit(False)), STRUCTURAL).when(F.coalesce("subset", F.lit(False)) & has, INTERPOLATED).when(F.coalesce("identical", F.lit(False)) & has, MEASURED)
        .when((F.col("a") <= PRESENT) & has, MEASURED).when(F.coalesce("shared_tip", F.lit(False)) & has, MEASURED).when(has, INTERPOLATED).otherwise(STRUCTURAL)
    )
    return t.withColumn("tier", tier.cast("long")).select("id", F.when(F.col("tier") != STRUCTURAL, F.col("a")).alias("age"), "tier")


def layout_fill(tree: DataFrame, ages: DataFrame, root_age: float) -> DataFrame:
    """(id, age_layout, clamped): a finite, monotone age for every node.

    Bottom-up by level, an undated node learns the oldest of its children's
    values (a dated child's own, else what that child learned) and the least hops
    to a dated node; top-down, a dated node is clamped to its dated parent and an
    undated one placed between the dated node above and what it learned, in
    proportion to the hops.  Levels are at most the depth of the tree.
    """
    t = split(tree.select("id", "parent", "depth").join(ages.select("id", "age").hint("merge"), "id", "left").withColumn("age", F.when(F.col("parent").isNull(), F.coalesce("age", F.lit(float(root_age)))).otherwise(F.col("age"))), "depth")
    deepest = t.agg(F.max("depth")).first()[0]
    if deepest is None:
        return t.select("id", F.col("age").alias("age_layout"), F.lit(False).alias("clamped"))
    none = F.lit(None)
    low = {deepest: t.where(F.col("depth") == deepest).withColumn("lo", none.cast("double")).withColumn("down", none.cast("long"))}
    for level in range(deepest - 1, -1, -1):
        below = low[level + 1].groupBy("parent").agg(
            F.max(F.coalesce("age", "lo")).alias("lo"), F.min(F.when(F.col("age").isNotNull(), 1).otherwise(F.col("down") + 1)).cast("long").alias("down")
        )
        low[level] = materialise(t.where(F.col("depth") == level).join(below.withColumnRenamed("parent", "of"), F.col("id") == F.col("of"), "left").drop("of"))
    placed = materialise(low[0].select("id", "age", F.col("age").alias("here"), F.col("age").alias("top"), F.lit(0).cast("long").alias("up"), F.lit(False).alias("clamped")))
    done = placed
    for level in range(1, deepest + 1):
        above = placed.select(F.col("id").alias("parent"), F.col("age").alias("p_age"), F.col("here").alias("p_here"), F.col("top").alias("p_top"), F.col("up").alias("p_up"))
        j = low[level].join(above, "parent")
        known = F.col("age").isNotNull()
        capped = F.when(F.col("p_age").isNotNull(), F.least("age", "p_age")).otherwise(F.col("age"))
        bot = F.least(F.coalesce("lo", F.lit(0.0)), F.col("p_top"))
        up, down = F.col("p_up") + 1, F.coalesce("down", F.lit(1))
        spread = F.col("p_top") - (F.col("p_top") - bot) * up / (up + down)
        placed = materialise(j.select(
            "id", F.when(known, capped).alias("age"), F.least(F.when(known, capped).otherwise(spread), F.col("p_here")).alias("here"),
            F.when(known, capped).otherwise(F.col("p_top")).alias("top"), F.when(known, 0).otherwise(up).cast("long").alias("up"), F.coalesce(F.col("age") > F.col("p_age"), F.lit(False)).alias("clamped"),
        ))
        done = done.unionByName(placed)
    return done.select("id", F.col("here").alias("age_layout"), "clamped")


def violations(tree: DataFrame, ages: DataFrame) -> DataFrame:
    """Dated nodes older than their dated parent."""
    a = tree.select("id", "parent").join(ages.select("id", "age"), "id")
    return a.join(ages.select(F.col("id").alias("parent"), F.col("age").alias("p_age")), "parent").where("age > p_age").select("id", "age", "p_age")


def tier_counts(tree: DataFrame, ages: DataFrame, measured: DataFrame) -> DataFrame:
    """(tier, nodes, internal)."""
    j = ages.join(measured.select("id", "is_tip"), "id")
    return j.groupBy("tier").agg(F.count("*").alias("nodes"), F.count_if(~F.col("is_tip")).alias("internal"))


def bound_propagation(tree: DataFrame, bounds: DataFrame, ages: DataFrame) -> DataFrame:
    """(id, bound): the oldest youngest-bound of the facts attached at or below a
    node; refused where a dated node lies at or below it. bounds: (id, bound)."""
    own = bounds.groupBy("id").agg(F.max("bound").alias("bound")).hint("merge")
    dated = ages.where("age IS NOT NULL").select("id", F.lit(1).alias("_dated")).distinct().hint("merge")
    t = in_layers(tree).select("id", "parent", "layer").join(own, "id", "left").join(dated, "id", "left")
    return fold_up(t, {"bound": "max", "_dated": "max"}).where("bound IS NOT NULL AND _dated IS NULL").select("id", "bound")


def bound_layout(tree: DataFrame, layout: DataFrame, bounds: DataFrame) -> DataFrame:
    """(id, age_layout, short): undated nodes pushed back to their bound and
    clamped again to the least value at or above; ``short`` where that cut it."""
    pushed = layout.join(bounds.hint("merge"), "id", "left").select("id", F.greatest("age_layout", "bound").alias("age_layout"), "bound").hint("merge")
    t = in_layers(tree).select("id", "parent", "child_count", "layer").join(pushed, "id", "left")
    least = fold_down(t.withColumn("_own", F.col("age_layout").isNotNull()), "age_layout", F.least)
    return least.where("_own").select("id", "age_layout", F.coalesce(F.col("age_layout") < F.col("bound"), F.lit(False)).alias("short"))


def occurrence_best(facts: DataFrame, ages: DataFrame) -> DataFrame:
    """Best attested fact of each structural node: most occurrences, then name."""
    bare = ages.where(F.col("tier") == STRUCTURAL).select(F.col("id").alias("attach"))
    best = facts.join(bare, "attach", "left_semi").groupBy("attach").agg(F.min(F.struct((-F.col("n_occs")).alias("m"), "name", "oldest", "youngest")).alias("b"))
    return best.select("attach", F.col("b.name").alias("name"), (-F.col("b.m")).alias("n_occs"), F.col("b.oldest").alias("oldest"), F.col("b.youngest").alias("youngest"))


def living(tree: DataFrame, alive: DataFrame) -> DataFrame:
    """(id): nodes with a living node at or below them."""
    return tree.join(alive.select("id").distinct(), "id", "left_semi").select(F.explode("lineage").alias("id")).distinct()


def by_route(resolved: DataFrame) -> DataFrame:
    """(route, n) of resolved keys (status): how they were found."""
    return resolved.groupBy(F.col("status").alias("route")).agg(F.count("*").alias("n"))


def headline(tiers: DataFrame) -> DataFrame:
    """One row of provenance: nodes, measured, dated at all, and their shares."""
    dated = F.col("tier").isin(MEASURED, INTERPOLATED)
    return tiers.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("tier") == MEASURED).alias("measured"), F.count_if(dated).alias("dated"),
        F.round(F.try_divide(F.count_if(dated), F.count("*")), 6).alias("dated_share"),
    )


def in_range(ages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, low, high, age, passed) of spot checks: an age must lie within its published range."""
    j = ranges.select("id", "low", "high").join(ages.select("id", "age"), "id", "left")
    return j.withColumn("passed", F.coalesce(F.col("age").between(F.col("low"), F.col("high")), F.lit(False)))


def label_kinds(labels: DataFrame, prefixes: list[str]) -> DataFrame:
    """(kind, n) of labels (label) by the first prefix that they begin with; 'empty' and 'other'."""
    kind = F.when(F.coalesce("label", F.lit("")) == "", "empty")
    for x in prefixes:
        kind = kind.when(F.startswith("label", F.lit(x)), x)
    return labels.groupBy(kind.otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


def reachable(tree: DataFrame, bounds: DataFrame, final: DataFrame) -> DataFrame:
    """(id, reach, short): how far back a bound could be met under the parent's
    final age, and what the node's own final age falls short of that.
    bounds: (id, bound); final: (id, age_layout)."""
    up = final.select(F.col("id").alias("parent"), F.col("age_layout").alias("p_age"))
    j = bounds.join(tree.select("id", "parent"), "id").join(final.select("id", "age_layout"), "id").join(up, "parent", "left")
    reach = F.least("bound", "p_age")
    return j.select("id", reach.alias("reach"), F.greatest(reach - F.col("age_layout"), F.lit(0.0)).alias("short"))


def reach_figures(reach: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row: bounds, nodes that fall short of what they could reach, and the
    median of what bounds lack after that (the parent's doing, not the node's)."""
    j = reach.join(bounds, "id").withColumn("rest", F.greatest(F.col("bound") - F.col("reach"), F.lit(0.0)))
    return j.agg(F.count("*").alias("bounds"), F.count_if(F.col("short") > 0).alias("short"), F.round(F.median(F.when(F.col("rest") > 0, F.col("rest"))), 6).alias("median_rest"))


def versioned(folder: str, name: str, version: str) -> str:
    """Where a phase's output lives.  A phase reads the version of an earlier phase
    and writes its own, so a repeat starts from the same baseline and never compounds."""
    return f"{folder}/{name}/v={version}"


def rebuild(df: DataFrame, folder: str, name: str, version: str) -> DataFrame:
    """Write ``df`` as a version of ``name`` (a repeat replaces it) and read it back."""
    path = versioned(folder, name, version)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
