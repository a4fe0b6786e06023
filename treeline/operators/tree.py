"""Rooted trees: layers, folds up and down, lineages, closure, preorder numbers, metrics, forwards.

A tree is a table (id, parent, ...); the root's parent is null.  Its leaves are cut
off in layers while they are a fair share of what is left, so the rows of all
layers together are a small multiple of the nodes; what remains, the core (long
chains), is worked by pointer doubling, whose rounds grow as the logarithm of the
depth.  Every table has one row a node.  A fold passes values from layer to layer,
from the leaves to the root or back.  Once nodes are numbered, sums over subtrees
are differences of running sums.  ``lineages`` joins every id with the array of its
ancestors, for selections.  No operator walks the tree on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import counted, materialise, observed, split, tasks

#: Leaves are cut off while they are one in so many of the nodes left, at least.
SHARE = 4
#: The layer of what isn't cut off.
CORE = -1
MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def _by_id(df: DataFrame, other: DataFrame, key: str, of: str, rows: int | None = None) -> DataFrame:
    """Left join on ``key`` with one row an ``of``.  Rows without a key are spread by their own id, which
    isn't in ``other`` under theirs; both sides are shuffled, for neither has a known bound.  ``rows``: how
    many ``df`` has, if its keys are distinct, so that a task's share of them is the same in every tree."""
    if rows is not None:
        df, other = df.repartition(tasks(rows), key), other.repartition(tasks(rows), of)
        return df.join(other.hint("merge"), df[key] == other[of], "left")
    at = F.coalesce(df[key], df["id"])
    return df.join(other.hint("merge"), (at == other[of]) & df[key].isNotNull(), "left")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def layered(tree: DataFrame) -> DataFrame:
    """Add ``size``, ``tip_count``, ``child_count`` and ``layer``: how many times leaves
    were cut off before the node was one, ``CORE`` if it never was.  Cycles are an error."""
    zero = F.lit(0).cast("long")
    state = tree.withColumns({"size": F.lit(1).cast("long"), "tip_count": zero, "child_count": zero})
    out, core, n = [], None, tree.count()
    while True:
        up = state.where("parent IS NOT NULL").select(F.col("parent").alias("_of")).distinct()
        flagged = _by_id(state, up, "id", "_of", n).withColumn("_leaf", F.col("_of").isNull().cast("int")).drop("_of")
        cut, seen = observed(flagged.withColumn("tip_count", F.when((F.col("_leaf") == 1) & (F.col("child_count") == 0), 1).otherwise(F.col("tip_count")).cast("long")), F.count("*").alias("n"), F.count_if(F.col("_leaf") == 1).alias("cut"), by="_leaf")
        if seen["n"] and not seen["cut"]:
            raise ValueError("the parents hold a cycle")
        leaves, rest = cut.where("_leaf = 1").drop("_leaf"), cut.where("_leaf = 0").drop("_leaf")
        out.append(leaves.withColumn("layer", F.lit(len(out))))
        if seen["cut"] == seen["n"]:
            return _union(out)
        gathered = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.sum("size").alias("_size"), F.sum("tip_count").alias("_tips"), F.count("*").alias("_kids"))
        sums = {n: (F.col(n) + F.coalesce(m, zero)).alias(n) for n, m in (("size", "_size"), ("tip_count", "_tips"), ("child_count", "_kids"))}
        n = seen["n"] - seen["cut"]
        state = materialise(_by_id(rest, gathered, "id", "_of", n).select(*[sums.get(c, F.col(c)) for c in rest.columns]))
        if seen["cut"] * SHARE < seen["n"]:
            kids = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("_kids"))
            core = _core_up(state, {"size": "sum", "tip_count": "sum"})
            core = _by_id(core, kids, "id", "_of").withColumn("child_count", F.col("child_count") + F.coalesce("_kids", zero)).drop("_of", "_kids")
            return _union([*out, core.withColumn("layer", F.lit(CORE))])


def _rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 4096) -> DataFrame:
    """``step`` until no pointer ``_jump`` is left, two steps to a written table."""
    state, left = counted(state, "_jump IS NOT NULL")
    steps = 1
    while left:
        if steps > most:
            raise ValueError(f"a chain is longer than {most}; the parents hold a cycle")
        state, left = counted(step(step(state)), "_jump IS NOT NULL")
        steps *= 4
    return state


def _core_up(core: DataFrame, how: dict[str, str]) -> DataFrame:
    """Columns folded over each node of the core and all of the core below it: ``_jump`` is the
    ancestor 2^k steps up, and a column covers what lies less than 2^k steps down."""
    rest = [c for c in core.columns if c not in how]

    def step(state: DataFrame) -> DataFrame:
        gathered = state.where("_jump IS NOT NULL").groupBy(F.col("_jump").alias("_to")).agg(*[getattr(F, f)(c).alias(f"_{c}") for c, f in how.items()])
        moved = _by_id(state, gathered, "id", "_to").drop("_to")
        far = state.select(F.col("id").alias("_at"), F.col("_jump").alias("_next"))
        moved = _by_id(moved, far, "_jump", "_at")
        return moved.select(*rest, F.col("_next").alias("_jump"), *[MERGE[f](F.col(c), F.col(f"_{c}")).alias(c) for c, f in how.items()])

    return _rounds(core.withColumn("_jump", F.col("parent")), step).drop("_jump")


def _core_down(core: DataFrame, value: str, fold: Callable[[Column, Column], Column]) -> DataFrame:
    """``value`` folded over each node of the core and its ancestors there, nearest first."""
    rest = [c for c in core.columns if c != value]

    def step(state: DataFrame) -> DataFrame:
        far = state.select(F.col("id").alias("_at"), F.col("_jump").alias("_next"), F.col(value).alias("_far"))
        return _by_id(state, far, "_jump", "_at").select(*rest, F.col("_next").alias("_jump"), F.when(F.col("_at").isNull(), F.col(value)).otherwise(fold(F.col(value), F.col("_far"))).alias(value))

    return _rounds(core.withColumn("_jump", F.col("parent")), step).drop("_jump")


def _layers(tree: DataFrame) -> list[int]:
    """The layers that a layered tree has, leaves first, the core last."""
    return sorted((r[0] for r in tree.select("layer").distinct().collect()), key=lambda k: (k == CORE, k))


def fold_down(tree: DataFrame, value: str, fold: Callable[[Column, Column], Column]) -> DataFrame:
    """A layered tree whose column ``value`` is folded over each node and its ancestors:
    ``fold(own, the parent's)``, which is associative.  A parent that isn't in the table ends the chain."""
    t = split(tree, "layer")
    done: list[DataFrame] = []
    for k in reversed(_layers(t)):
        rows = t.where(F.col("layer") == k)
        if k == CORE:
            rows = _core_down(rows, value, fold)
        elif done:
            up = _union(done).where("child_count > 0").select(F.col("id").alias("_at"), F.col(value).alias("_far"))
            got = F.when(F.col("_at").isNull(), F.col(value)).otherwise(fold(F.col(value), F.col("_far")))
            rows = _by_id(rows, up, "parent", "_at").select(*[got.alias(c) if c == value else F.col(c) for c in tree.columns])
        done.append((materialise(rows) if k else rows).select(*tree.columns))
    return _union(done) if done else tree


def fold_up(tree: DataFrame, how: dict[str, str]) -> DataFrame:
    """A layered tree whose columns are folded over each node and all below it. how: {column: 'sum', 'max' or 'min'}."""
    t = split(tree, "layer")
    done, given = [], []
    sums = lambda of: [getattr(F, f)(of(c)).alias(f"_{c}") for c, f in how.items()]
    for k in _layers(t):
        rows = t.where(F.col("layer") == k)
        if given:
            got = _union(given).groupBy("_of").agg(*sums(lambda c: f"_{c}"))
            rows = _by_id(rows, got, "id", "_of").select(*[MERGE[how[c]](F.col(c), F.col(f"_{c}")).alias(c) if c in how else F.col(c) for c in tree.columns])
            rows = _core_up(rows, how) if k == CORE else materialise(rows)
        elif k == CORE:
            rows = _core_up(rows, how)
        done.append(rows.select(*tree.columns))
        given.append(materialise(rows.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(*sums(lambda c: c))))
    return _union(done) if done else tree


def in_layers(tree: DataFrame) -> DataFrame:
    """A tree with its layers, which are found unless it has them."""
    return tree if "layer" in tree.columns else layered(tree)


def lineages(tree: DataFrame) -> DataFrame:
    """Add ``lineage`` (ids from the node to its root).  Cycles are an error."""
    return fold_down(in_layers(tree).withColumn("lineage", F.array("id")), "lineage", F.concat).select(*tree.columns, "lineage")


def closure(tree: DataFrame) -> DataFrame:
    """(id, anc, hops) of every node and each ancestor or itself."""
    return tree.select("id", F.posexplode("lineage").alias("hops", "anc")).withColumn("hops", F.col("hops").cast("long"))


def running(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the earlier rows of a row's group, in a
    total order.  Rows are sorted by ranges of (group, order), whose number follows
    the rows; a group that spans several ranges, as a large one does, adds the sums
    of its earlier ranges.  ``df`` is a written table."""
    by, n = [*group, *order], tasks(df.count())
    ranged = materialise(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*group)
    spans = sums.withColumn("_n", F.count("*").over(whole)).where("_n > 1")  # at most two groups a range
    start = spans.select("_range", *group, F.coalesce(F.sum("_sum").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranged = ranged.repartition(n, "_range", *group)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = ranged.withColumn("before", own).join(F.broadcast(start), ["_range", *group], "left")
    return j.withColumn("before", (F.col("before") + F.coalesce("_start", F.lit(0))).cast("long")).drop("_range", "_start")


def numbered(tree: DataFrame, key: str = "id") -> DataFrame:
    """Add ``idx``, ``size``, ``depth``, ``tip_count``, ``child_count`` and ``layer``.

    A node's number is the sum, over itself and its proper ancestors below the root,
    of one plus the sizes of the earlier siblings (by ``key``), which are running sums
    by parent; no group of siblings has to fit a task.
    """
    known = materialise(layered(tree))
    sums = running(known.where("parent IS NOT NULL"), ["parent"], list(dict.fromkeys([key, "id"])), "size")
    place = lambda df, shift, depth: df.withColumn("_place", F.struct(shift.cast("long").alias("idx"), depth.cast("long").alias("depth")))
    own = place(known.where("parent IS NULL"), F.lit(0), F.lit(0)).unionByName(place(sums, F.col("before") + 1, F.lit(0)).drop("before"))
    add = lambda a, b: F.struct((a["idx"] + b["idx"]).alias("idx"), (a["depth"] + b["depth"] + 1).alias("depth"))
    out = fold_down(own, "_place", add)
    return out.select(*tree.columns, F.col("_place.idx").alias("idx"), "size", F.col("_place.depth").alias("depth"), "tip_count", "child_count", "layer")


def preorder(tree: DataFrame, key: str = "id") -> DataFrame:
    """Add ``idx``, ``size``, ``depth``."""
    return numbered(tree, key).select(*tree.columns, "idx", "size", "depth")


def subtree_sums(tree: DataFrame, value: str, name: str) -> DataFrame:
    """(id, name): the sum of ``value`` over each node of a numbered tree and all below it:
    what a running sum by position gains over the node's interval."""
    sums = materialise(running(tree.select("id", "idx", "size", F.col(value).cast("long").alias("_value")), [], ["idx"], "_value"))
    last = sums.select((F.col("idx")).alias("_end"), (F.col("before") + F.col("_value")).alias("_upto"))
    return sums.join(last, F.col("idx") + F.col("size") - 1 == F.col("_end")).select("id", (F.col("_upto") - F.col("before")).alias(name))


def metrics(tree: DataFrame) -> DataFrame:
    """(id, child_count, is_tip, tip_count, subtree_out) of a numbered tree."""
    children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("child_count"))
    base = tree.select("id", "idx", "size").join(children, "id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    tips = subtree_sums(base.withColumn("_tip", F.col("child_count") == 0), "_tip", "tip_count")
    return base.join(tips, "id").select("id", "child_count", (F.col("child_count") == 0).alias("is_tip"), "tip_count", (F.col("idx") + F.col("size")).alias("subtree_out"))


def profile(tree: DataFrame, measured: DataFrame) -> DataFrame:
    """One row of structural figures; depths are over the tips."""
    t = tree.select("id", "depth").join(measured, "id")
    tip = F.col("is_tip")
    return t.agg(
        F.count_if(tip).alias("tips"), F.count_if(~tip).alias("internal"),
        F.min(F.when(tip, F.col("depth"))).alias("min_depth"), F.round(F.avg(F.when(tip, F.col("depth"))), 6).alias("mean_depth"), F.max(F.when(tip, F.col("depth"))).alias("max_depth"),
        F.max("child_count").alias("max_children"), F.count_if(F.col("child_count") == 1).alias("unary"), F.count_if(F.col("child_count") > 2).alias("polytomies"),
    )


def invariants(tree: DataFrame, measured: DataFrame) -> DataFrame:
    """(rule, violations): what a numbered tree must satisfy."""
    t = tree.join(measured, "id")
    up = t.select(F.col("id").alias("parent"), F.col("idx").alias("p_idx"), F.col("subtree_out").alias("p_out"), F.col("depth").alias("p_depth"))
    j = t.join(up, "parent", "left")
    rules = {
        "parent_before_child": F.col("p_idx") >= F.col("idx"),
        "inside_parent": F.col("subtree_out") > F.col("p_out"),
        "depth_step": F.col("depth") != F.col("p_depth") + 1,
        "one_root": F.col("parent").isNull() & (F.col("idx") != 0),
        "tip_is_leaf": F.col("is_tip") & (F.col("tip_count") != 1),
    }
    counted = j.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def forward_closure(forward: DataFrame, hops: int = 64) -> DataFrame:
    """(old, new): each chain of forwards followed to its end, at most ``hops``
    steps.  In a cycle the last id before a repeat is the end, which depends on
    the start; an id that forwards to itself gives no row.

    Chains are walked all at once, one join a step, and leave when they end.
    """
    step = materialise(forward.where("old IS NOT NULL AND new IS NOT NULL").groupBy("old").agg(F.max("new").alias("new")))
    walk = materialise(step.where("old <> new").select("old", F.col("new").alias("at"), F.array("old", "new").alias("seen")))
    ended = None
    nxt = step.select(F.col("old").alias("from"), F.col("new").alias("to"))
    for _ in range(hops):
        moved = materialise(walk.join(nxt, walk["at"] == nxt["from"], "left").withColumn("over", F.col("to").isNull() | F.array_contains("seen", F.col("to"))))
        done = moved.where("over").select("old", F.col("at").alias("new"))
        ended = done if ended is None else ended.unionByName(done)
        walk = moved.where("NOT over").select("old", F.col("to").alias("at"), F.concat("seen", F.array("to")).alias("seen"))
        if walk.isEmpty():
            return ended
    return ended.unionByName(walk.select("old", F.col("at").alias("new")))
