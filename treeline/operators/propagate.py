"""Nearest drawn relative, divergence witnesses, corroborated young ends, brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .tree import fold_down, fold_up, in_layers

#: Thresholds of the young-end rule and of a witness that has ended.
LEAST_OCCURRENCES, FORM_FLAGS, ENDED = 5, ("I", "F"), 0.0117


def _ranked(tree: DataFrame, seeds: DataFrame, *more: str) -> DataFrame:
    """A layered tree (id, parent, ..., layer) with ``_best``, the best seed at or below each node, and ``_assets``, its own pictures."""
    own = seeds.groupBy("id").agg(F.collect_list(F.struct("asset") if "asset" in seeds.columns else F.struct(F.lit(None).cast("long").alias("asset"))).alias("_assets")).hint("merge")
    t = in_layers(tree).select("id", "parent", "child_count", "layer", "tip_count", "depth", *more).join(own, "id", "left")
    at = F.struct((-F.col("tip_count")).alias("m"), "depth", F.col("id").alias("source"), *more, "_assets")
    return fold_up(t.withColumn("_best", F.when(F.col("_assets").isNotNull(), at)), {"_best": "min"})


def exemplars(tree: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, source): of the seeds at or below a node the one with most tips, then
    least depth, then least id. tree: (id, parent, tip_count, depth)."""
    return _ranked(tree, seeds.select("id")).where("_best IS NOT NULL").select("id", F.col("_best.source").alias("source"))


def nearest_drawn(tree: DataFrame, seeds: DataFrame, claims: bool = False) -> DataFrame:
    """(id, asset, source, clade, climb, method): every node's picture: its own,
    else the exemplar of the nearest ancestor-or-self that has one. method is
    exact, ancestor (the source is above), descendant, relative, or none where the
    tree holds no picture (then all else is null). tree: a numbered one.
    ``claims`` adds the tips of the clade, ``claim``.

    The best picture goes up the tree and what a node shows comes down; who is above
    whom is told by intervals."""
    at = F.col("_best")
    shown = F.struct(F.lit(0).cast("long").alias("climb"), F.when(at.isNotNull(), F.struct(F.col("id").alias("clade"), F.col("tip_count").alias("claim"), at["source"].alias("source"), at["idx"].alias("idx"), at["size"].alias("size"), at["_assets"].alias("assets"))).alias("of"))
    near = lambda a, b: F.when(a["of"].isNotNull(), a).otherwise(F.struct((a["climb"] + b["climb"] + 1).alias("climb"), b["of"].alias("of")))
    j = fold_down(_ranked(tree, seeds, "idx", "size").withColumn("_shown", shown).drop("_best"), "_shown", near)
    own, of, none = F.col("_assets").isNotNull(), F.col("_shown.of"), F.col("_shown.of").isNull()
    inside = lambda idx, top, size: (top <= idx) & (idx < top + size)
    method = F.when(none, "none").when(own | (of["source"] == F.col("id")), "exact").when(inside(F.col("idx"), of["idx"], of["size"]), "ancestor").when(inside(of["idx"], F.col("idx"), F.col("size")), "descendant").otherwise("relative")
    told = j.select(
        "id", F.when(own, F.col("_assets")).otherwise(of["assets"]).alias("_of"), F.when(own, F.col("id")).otherwise(of["source"]).alias("source"), F.when(own, F.col("id")).otherwise(of["clade"]).alias("clade"),
        F.when(own, 0).when(~none, F.col("_shown.climb")).cast("long").alias("climb"), method.alias("method"), F.when(own, F.col("tip_count")).otherwise(of["claim"]).alias("claim"),
    )
    out = told.select("id", F.explode_outer("_of").alias("_one"), "source", "clade", "climb", "method", "claim")
    return out.select("id", F.col("_one.asset").alias("asset"), "source", "clade", "climb", "method", *(["claim"] if claims else []))


def climb_counts(drawn: DataFrame) -> DataFrame:
    """(climb, nodes): how far nodes are from the picture they show."""
    return drawn.where("method <> 'none'").groupBy("climb").agg(F.count("*").alias("nodes"))


def misplaced(drawn: DataFrame, cited: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row: exact pictures whose asset cites a taxon, and those of which no cited
    taxon lies within the node they are on. drawn (id, asset, method); cited (asset,
    ext); taxonomy (ext, lineage), whose ids are the nodes'."""
    exact = drawn.where("method = 'exact'").select("id", "asset")
    told = exact.join(cited, "asset").join(taxonomy.select("ext", "lineage"), "ext", "left")
    each = told.groupBy("id", "asset").agg(F.max(F.coalesce(F.array_contains("lineage", F.col("id")), F.lit(False))).alias("inside"))
    return each.agg(F.count("*").alias("checked"), F.count_if(~F.col("inside")).alias("outside"))


def informative(asset: Column, clade_tips: Column, most: float = float("inf")) -> Column:
    """Whether a picture says enough to be shown: it stands for ``most`` tips at most, or nobody counted."""
    return asset.isNotNull() & (clade_tips.isNull() | (clade_tips <= F.lit(most)))


def claim_figures(drawn: DataFrame, tree: DataFrame, most: int = 10_000) -> DataFrame:
    """One row: share of nodes whose claim covers at most ``most`` tips, and percentiles."""
    j = drawn.where("clade IS NOT NULL") if "claim" in drawn.columns else drawn.join(tree.select(F.col("id").alias("clade"), F.col("tip_count").alias("claim")), "clade")
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY claim)").cast("long")
    return j.agg(F.count("*").alias("nodes"), F.round(F.avg(F.when(F.col("claim") <= most, 1.0).otherwise(0.0)), 6).alias("informative"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.9).alias("p90"))


def asset_order(drawn: DataFrame, tree: DataFrame) -> DataFrame:
    """(asset, covers): pictures with the largest subtree they stand for."""
    if "claim" in drawn.columns:
        return drawn.where("clade IS NOT NULL").groupBy("asset").agg(F.max("claim").alias("covers"))
    return drawn.select("asset", "clade").distinct().join(tree.select(F.col("id").alias("clade"), "tip_count"), "clade").groupBy("asset").agg(F.max("tip_count").alias("covers"))


def witness(tree: DataFrame, ages: DataFrame, facts: DataFrame, pictured: DataFrame, near: float = float("inf"), drawn: DataFrame | None = None) -> DataFrame:
    """(id, fact, gap): for each fork with an age, more than one tip and no own
    picture, the fact below it with the least (gap, width, walk, -occurrences, id);
    the gap is 0 if the fact's interval holds the fork's age, and at most ``near``
    of the age. Only facts with a picture (drawn: fact) may witness, if given."""
    fork = tree.select("id", "tip_count").join(ages.select("id", F.coalesce("age", "age_layout").alias("at")), "id").where("at > 0 AND tip_count > 1").join(pictured.select("id"), "id", "left_anti").select("id", "at")
    able = facts.where(F.col("is_primary") & F.col("is_extinct") & F.col("oldest").isNotNull() & (F.col("youngest") > ENDED))
    if drawn is not None:
        able = able.join(drawn.select("fact").distinct(), "fact", "left_semi")
    below = able.join(tree.select(F.col("id").alias("attach"), "lineage"), "attach").select("fact", "oldest", "youngest", "walk", "n_occs", F.explode("lineage").alias("id")).join(fork, "id")
    gap = F.greatest(F.col("at") - F.col("oldest"), F.col("youngest") - F.col("at"), F.lit(0.0))
    order = F.struct(gap.alias("gap"), (F.col("oldest") - F.col("youngest")).alias("width"), "walk", (-F.col("n_occs")).alias("o"), "fact")
    return below.where(gap <= F.lit(near) * F.col("at")).groupBy("id").agg(F.min(order).alias("b")).select("id", F.col("b.fact").alias("fact"), F.col("b.gap").alias("gap"))


def witness_figures(witnesses: DataFrame, ages: DataFrame) -> DataFrame:
    """One row: forks with a witness, those whose witness spans the split, those
    nobody has dated, and the largest share that one fact holds."""
    j = witnesses.join(ages.select("id", "age"), "id", "left")
    most = witnesses.groupBy("fact").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    whole = j.agg(F.count("*").alias("forks"), F.count_if(F.col("gap") == 0).alias("spanning"), F.count_if(F.col("age").isNull()).alias("undated")).crossJoin(most)  # one row each
    return whole.select("forks", "spanning", "undated", F.round(F.try_divide("most", "forks"), 6).alias("prolific_share"))


def witness_walks(witnesses: DataFrame, facts: DataFrame) -> DataFrame:
    """(walk, forks): how far the witnesses' attachments were looked for."""
    return witnesses.join(facts.select("fact", "walk"), "fact").groupBy("walk").agg(F.count("*").alias("forks"))


def drawn_bounds(lla: Column, fea: Column, lea: Column, clamped: Column, identified: Column, identified_lea: Column) -> tuple[Column, Column]:
    """(lla, lea) as one row may draw them: the young end of its accepted fact, where
    that is clamped and lies within this row's own bounds, and with it the older end,
    kept between the young end and ``fea``."""
    moves = F.coalesce(clamped, F.lit(False)) & identified.isNotNull() & F.coalesce(identified >= lla, F.lit(True)) & F.coalesce(identified <= fea, F.lit(True))
    young = F.when(moves, identified).otherwise(lla)
    old = F.when(moves & identified_lea.isNotNull(), F.least(F.greatest(identified_lea, identified), F.coalesce(fea, F.greatest(identified_lea, identified)))).otherwise(lea)
    return young, old


def shown_bounds(fea: Column, fla: Column, lea: Column, lla: Column, lea_drawn: Column, lla_drawn: Column) -> list[Column]:
    """The four bounds to draw: the last-appearance pair moves together or not at all."""
    moved = F.coalesce(lla_drawn.isNotNull() & ~lla_drawn.eqNullSafe(lla), F.lit(False))
    return [fea, fla, F.when(moved, F.coalesce(lea_drawn, lea)).otherwise(lea), F.when(moved, lla_drawn).otherwise(lla)]


def indeterminate(lla: Column, identified: Column) -> Column:
    """Whether no identified member reaches the young end."""
    return F.coalesce(identified > lla, F.lit(False))


def young_ends(facts: DataFrame) -> DataFrame:
    """Per fact: own and identified young end, occurrences there, what is drawn.

    facts: (id, parent_id, level, fea, lea, lla, n_occs, flags), level = depth in
    the facts' own tree.  Bottom-up by level: a fact reads its children's corrected
    minima, so this is not one aggregate over a closure.
    """
    own = facts.groupBy("parent_id").agg(F.sum("n_occs").alias("child_occs")).withColumnRenamed("parent_id", "of")
    t = materialise(facts.join(own, F.col("id") == F.col("of"), "left").drop("of").withColumn("own_occs", F.greatest(F.lit(0), F.col("n_occs") - F.coalesce("child_occs", F.lit(0)))))
    deepest = t.agg(F.max("level")).first()[0]
    done = below = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = t.where(F.col("level") == level)
        if below is not None:
            ends = below.where("sub_min IS NOT NULL").groupBy("parent_id", "sub_min").agg(F.sum("sub_at").alias("n_at"), F.min(F.struct("id", "sub_lea")).alias("first"))  # per end first, so no parent gathers its children
            kids = ends.groupBy(F.col("parent_id").alias("of")).agg(F.min("sub_min").alias("end"), F.min_by(F.struct("n_at", "first"), "sub_min").alias("m"))
            kids = kids.select("of", "end", F.col("m.first.sub_lea").alias("end_lea"), F.col("m.n_at").alias("n_at"))
            rows = rows.join(kids, F.col("id") == F.col("of"), "left").drop("of")
        else:
            rows = rows.selectExpr("*", "CAST(NULL AS DOUBLE) AS end", "CAST(NULL AS DOUBLE) AS end_lea", "CAST(NULL AS BIGINT) AS n_at")
        unseen = F.coalesce(F.col("end") < F.col("lla"), F.lit(False))
        form = F.coalesce(F.col("flags"), F.lit("")).rlike("[" + "".join(FORM_FLAGS) + "]")
        sparse, contra = F.col("n_at") < LEAST_OCCURRENCES, F.col("end") > F.col("fea")
        clamp = unseen & ~form & ~sparse & ~contra
        drawn = F.when(clamp, F.col("end")).otherwise(F.col("lla"))
        sub_min = F.least(drawn, F.when(clamp | F.col("lla").isNull(), F.col("end")))
        rows = rows.select(
            "id", "parent_id", "lla", F.when(unseen, F.col("end")).alias("identified"), F.when(unseen, F.col("n_at")).alias("end_occs"), drawn.alias("lla_drawn"), F.when(clamp, F.col("end_lea")).otherwise(F.col("lea")).alias("lea_drawn"),
            unseen.alias("unwitnessed"), clamp.alias("clamped"), (unseen & form).alias("refused_form"), (unseen & ~form & sparse).alias("refused_sparse"), (unseen & ~form & ~sparse & contra).alias("refused_contradiction"),
            sub_min.alias("sub_min"), F.when(sub_min == F.col("lla"), F.col("lea")).otherwise(F.col("end_lea")).alias("sub_lea"),
            (F.when(F.col("lla") == sub_min, F.col("own_occs")).otherwise(0) + F.when(F.col("end") == sub_min, F.coalesce("n_at", F.lit(0))).otherwise(0)).alias("sub_at"),
        )
        below = materialise(rows)
        part = below.drop("parent_id", "sub_min", "sub_lea", "sub_at")
        done = part if done is None else done.unionByName(part)
    return done


def bracket(fea: Column, fla: Column, lea: Column, lla: Column) -> Column:
    """Class of a two-bracket interval."""
    none = fea.isNull() & fla.isNull() & lea.isNull() & lla.isNull()
    some = fea.isNull() | fla.isNull() | lea.isNull() | lla.isNull()
    return F.when(none, "absent").when(some, "unrecorded").when(fla > lea, "extent").when(fla == lea, "instant").otherwise("overlapping")


def span(fea: Column, fla: Column, lea: Column, lla: Column) -> tuple[Column, Column]:
    """Oldest and youngest of the bounds there are."""
    return F.greatest(fea, fla, lea, lla), F.least(fea, fla, lea, lla)


def licence(url: Column) -> Column:
    """Licence class of a Creative Commons address."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(u == "", "none").when(u.rlike("publicdomain/(zero|mark)"), "public").when(u.rlike("licenses/by-nc-nd"), "by-nc-nd").when(u.rlike("licenses/by-nc-sa"), "by-nc-sa")
        .when(u.rlike("licenses/by-nc"), "by-nc").when(u.rlike("licenses/by-nd"), "by-nd").when(u.rlike("licenses/by-sa"), "by-sa").when(u.rlike("licenses/by(/|$)"), "by").otherwise("other")
    )


def shown_asset(role: Column, witness_asset: Column, exemplar_asset: Column) -> Column:
    """A divergence shows its witness if it has one, a leaf its exemplar."""
    return F.when(role == "divergence", F.coalesce(witness_asset, exemplar_asset)).otherwise(exemplar_asset)
