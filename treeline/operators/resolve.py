"""Entity resolution: precedence, refusals, unique-only joins, attachment walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, small

#: Method -> (precedence, confidence); precedence isn't descending confidence.
METHODS = {
    "manual": (1, 1.00),
    "ott_sourceinfo": (2, 0.99),
    "gbif_pbdb_chain": (3, 0.90),
    "gbif_backbone_provenance": (4, 0.88),
    "phylopic_resolve": (5, 0.98),
    "name_exact": (6, 0.70),
}
#: Id namespaces that a source list may name.
NAMESPACES = ("ncbi", "gbif", "irmng", "worms", "if", "silva")
SHOWN = 32


def precedence(candidates: DataFrame) -> DataFrame:
    """(source, source_id, idx, method): the earliest method wins, even if its
    idx is null (that blocks later ones); within a method the first input."""
    rank = F.create_map(*[x for m, (p, _) in METHODS.items() for x in (F.lit(m), F.lit(p))])[F.col("method")]
    best = candidates.groupBy("source", "source_id").agg(F.min(F.struct(rank.alias("p"), "input_pos", "idx", "method")).alias("b"))
    return best.select("source", "source_id", F.col("b.idx").alias("idx"), F.col("b.method").alias("method"))


def blocked(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """(method, blocked): candidates of each method that a claim before them kept out."""
    offered = candidates.groupBy("method").agg(F.count("*").alias("n"))
    taken = chosen.groupBy("method").agg(F.count("*").alias("t"))
    return offered.join(taken, "method", "left").select("method", (F.col("n") - F.coalesce("t", F.lit(0))).alias("blocked"))


def refuse_extinct(resolved: DataFrame, facts: DataFrame, living: DataFrame, extinct: DataFrame) -> DataFrame:
    """Resolved rows with ``refused`` and ``withdrawn``: an extinct fact may not
    land on a living lineage unless the target is flagged; manual rows are exempt."""
    j = resolved.join(facts.select(F.col("id").alias("source_id"), "is_extant"), "source_id", "left")
    j = j.join(living.select(F.col("id").alias("idx"), F.lit(True).alias("alive")), "idx", "left").join(extinct.select(F.col("id").alias("idx"), F.lit(True).alias("flagged")), "idx", "left")
    bad = (F.col("is_extant") == False) & F.coalesce("alive", F.lit(False)) & ~F.coalesce("flagged", F.lit(False)) & (F.col("method") != "manual")  # noqa: E712
    bad = F.coalesce(bad, F.lit(False))
    return j.select("source", "source_id", F.when(~bad, F.col("idx")).alias("idx"), "method", bad.alias("refused"), F.when(bad, F.col("idx")).alias("withdrawn"))


def refuse_ambiguous(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """Among rows still resolved by exact name, refuse all facts of one name."""
    named = resolved.join(facts.select(F.col("id").alias("source_id"), "name", "accepted_id"), "source_id", "left")
    live = F.col("idx").isNotNull() & (F.col("method") == "name_exact")
    twins = named.where(live).groupBy("name").agg(F.count_distinct("accepted_id").alias("n")).where("n > 1").select("name", F.lit(True).alias("twin"))
    j = named.join(twins, "name", "left")
    bad = F.coalesce(F.col("twin") & live, F.lit(False))
    return j.select("source", "source_id", F.when(~bad, F.col("idx")).alias("idx"), "method", (F.col("refused") | bad).alias("refused"), F.coalesce("withdrawn", F.when(bad, F.col("idx"))).alias("withdrawn"))


def source_pairs(rows: DataFrame, column: str = "sourceinfo") -> DataFrame:
    """(id, pos, namespace, value) of 'ns:value,ns:value' lists; other namespaces,
    empty values and text with a slash-only scheme are dropped."""
    item = rows.select("id", F.posexplode(F.split(F.coalesce(column, F.lit("")), ",")).alias("pos", "item"))
    ns, value = F.lower(F.trim(F.split_part("item", F.lit(":"), F.lit(1)))), F.trim(F.expr("substring(item, locate(':', item) + 1)"))
    return item.where(F.contains("item", F.lit(":"))).select("id", F.col("pos").cast("long").alias("pos"), ns.alias("namespace"), value.alias("value")).where(F.col("namespace").isin(*NAMESPACES) & (F.col("value") != ""))


def chain_scores(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """One row: how many of a's ids (a_id, b_key) reach b (b_key, c_key), then c."""
    j = a.join(b, "b_key", "left").join(c.select("c_key", "node"), "c_key", "left")
    total = F.count("*")
    return j.agg(
        total.alias("asked"), F.count_if(F.col("c_key").isNotNull()).alias("hop1"), F.count_if(F.col("node").isNotNull()).alias("hop2"),
        F.round(F.try_divide(F.count_if(F.col("node").isNotNull()), total), 6).alias("end_to_end"),
    )


def unique_join(asked: DataFrame, offers: DataFrame, keys: list[str], value: str) -> DataFrame:
    """asked rows with ``value``, ``status`` and ``candidates``: matched only where
    the keys have one candidate; several are listed (first 32) but not chosen."""
    pool = offers.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias("only"), F.slice(F.array_sort(F.collect_set(value)), 1, SHOWN).alias("candidates"))
    j = asked.join(pool, keys, "left")
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return j.withColumn("status", status).withColumn(value, F.when(F.col("n") == 1, F.col("only"))).drop("n", "only")


def first_landing(asked: DataFrame, tries: list[str], nodes: DataFrame) -> DataFrame:
    """(id, node, try): the first of several key columns that is a node's key."""
    ranked = asked.select("id", F.posexplode(F.array(*tries)).alias("try", "key")).where("key IS NOT NULL")
    return ranked.join(nodes, "key").groupBy("id").agg(F.min_by("node", "try").alias("node"), F.min("try").cast("long").alias("try"))


def regressions(before: DataFrame, now: DataFrame, excused: DataFrame) -> DataFrame:
    """Keys resolved before, not now, and not excused."""
    was = before.where("idx IS NOT NULL").select("source", "source_id")
    still = now.where("idx IS NOT NULL").select("source", "source_id")
    return was.join(still, ["source", "source_id"], "left_anti").join(excused.select("source", "source_id"), ["source", "source_id"], "left_anti").distinct()


def cohorts(rows: DataFrame, weight: str, key: str, top: int, control: int) -> DataFrame:
    """(key, cohort): the heaviest rows, and a control drawn by hash, not chance."""
    best = rows.orderBy(F.desc(weight), key).limit(top).select(key, F.lit("top").alias("cohort"))
    rest = rows.join(best, key, "left_anti").orderBy(F.crc32(F.col(key).cast("string").cast("binary")), key).limit(control).select(key, F.lit("control").alias("cohort"))
    return best.unionByName(rest)


def coverage(rows: DataFrame, by: str, hit: Column, weight: str) -> DataFrame:
    """(by, n, hits, share, weighted) within each group."""
    w = F.sum(weight)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.try_divide(F.count_if(hit), F.count("*")), 6).alias("share"), F.round(F.try_divide(F.sum(F.when(hit, F.col(weight)).otherwise(0)), w), 6).alias("weighted"))


def agreed(citations: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, node): a homonym's node, if every citation's nearest ancestor of the
    asked name is the same. citations: (id, name, cited); tree has name, lineage."""
    ups = citations.join(tree.select(F.col("id").alias("cited"), "lineage"), "cited").select("id", "name", "cited", F.posexplode("lineage").alias("hops", "anc"))
    asked = citations.select(F.col("name").alias("a_name")).distinct()
    nodes = materialise(tree.select(F.col("id").alias("anc"), F.col("name").alias("a_name")).join(small(asked), "a_name", "left_semi"))
    named = ups.join(small(nodes), "anc").where("name = a_name")
    nearest = named.groupBy("id", "cited").agg(F.min_by("anc", "hops").alias("anc"))
    return nearest.groupBy("id").agg(F.count_distinct("anc").alias("n"), F.min("anc").alias("node")).where("n = 1").select("id", "node")


def seeds(offers: DataFrame) -> DataFrame:
    """(node, asset, pass): of several passes' offers for a node the strongest
    (lowest pass) stands; within a pass the primary, newest, then least asset."""
    order = F.struct("pass", F.when(F.col("is_primary"), 0).otherwise(1).alias("p"), (-F.col("modified")).alias("m"), "asset")
    return offers.groupBy("node").agg(F.min(order).alias("b")).select("node", F.col("b.asset").alias("asset"), F.col("b.pass").cast("long").alias("pass"))


def shortened(name: Column) -> Column:
    """Candidate names of a label: its first three, two and one words."""
    words = F.split(F.trim(name), r"\s+")
    return F.array_distinct(F.transform(F.sequence(F.least(F.size(words), F.lit(3)), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")))


def donors(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(accepted_id, donor, idx): for an accepted id, the best resolved row whose
    own name is the accepted name (method, then id)."""
    named = facts.select(F.col("accepted_id"), F.col("name").alias("accepted_name")).where(F.col("id") == F.col("accepted_id"))
    r = facts.select("id", "name", "accepted_id").join(resolved, "id")
    j = r.join(named, "accepted_id").where("name = accepted_name AND id <> accepted_id")
    return j.groupBy("accepted_id").agg(F.min(F.struct("method", "id", "idx")).alias("b")).select("accepted_id", F.col("b.id").alias("donor"), F.col("b.idx").alias("idx"))


def attach(facts: DataFrame, resolved: DataFrame, root: int = 0, hops: int = 64) -> DataFrame:
    """(id, idx, method, walk, via): a fact's own resolution, else the nearest
    resolved one from its accepted id upwards; else the root, method 0.

    facts: (id, parent_id, accepted_id); resolved: (id, idx, method).  All facts
    step up together, one join a step, and leave when they land, run out or meet
    an id again (a cycle: the root, with the chain's length as walk).
    """
    hit = resolved.select(F.col("id").alias("at"), F.col("idx"), F.col("method"))
    own = facts.join(hit, facts.id == hit.at).select("id", "idx", "method", F.lit(0).cast("long").alias("walk"), F.col("id").alias("via"))
    parent = facts.select(F.col("id").alias("of"), "parent_id")
    state = materialise(facts.join(own.select("id"), "id", "left_anti").select("id", F.coalesce("accepted_id", "id").alias("at"), F.lit(0).cast("long").alias("walk"), F.array(F.coalesce("accepted_id", "id")).alias("seen")))
    ended = [materialise(own)]
    fallback = lambda df, walk: df.select("id", F.lit(root).cast("long").alias("idx"), F.lit(0).cast("long").alias("method"), walk.cast("long").alias("walk"), F.lit(None).cast("long").alias("via"))
    for _ in range(hops + 1):
        j = materialise(state.join(hit, "at", "left").join(parent, F.col("at") == F.col("of"), "left"))
        ended.append(j.where("idx IS NOT NULL").select("id", "idx", "method", "walk", F.col("at").alias("via")))
        rest = j.where("idx IS NULL")
        stop = F.col("parent_id").isNull() | F.array_contains("seen", F.col("parent_id"))
        ended.append(fallback(rest.where(stop), F.when(F.col("parent_id").isNull(), F.col("walk")).otherwise(F.size("seen"))))
        state = rest.where(~stop).select("id", F.col("parent_id").alias("at"), (F.col("walk") + 1).alias("walk"), F.concat("seen", F.array("parent_id")).alias("seen"))  # of the written table
        if state.isEmpty():
            break
    else:
        ended.append(fallback(state, F.col("walk")))
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def rank_fallback(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """(id, rank): the node's own rank, else the second catalogue's if it names one."""
    one = other.where("rank IS NOT NULL").groupBy("id").agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("r")).where("n = 1")
    return nodes.join(one, "id", "left").select("id", F.coalesce("rank", "r").alias("rank"))


def dedupe(aliases: DataFrame) -> DataFrame:
    """One row per (idx, lang, folded name): best source, kind, id; strongest kind
    and number of distinct sources absorbed."""
    w = Window.partitionBy("idx", "lang", F.lower("name")).orderBy("source_rank", "kind", "source_id", "name")
    group = aliases.groupBy("idx", "lang", F.lower("name").alias("folded")).agg(F.min("kind").alias("best_kind"), F.count_distinct("source").alias("n_sources"))
    first = aliases.withColumn("folded", F.lower("name")).withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.join(group, ["idx", "lang", "folded"]).select("idx", "lang", "name", "source", F.col("best_kind").alias("kind"), "n_sources")


def prune_aliases(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop aliases (idx, name, source, sci_name) that repeat the node's own name;
    that come from the open knowledge base and are another node's name; and whose
    item names another taxon than the node (no stated taxon keeps a row)."""
    own = nodes.select("idx", F.lower("name").alias("own"))
    j = aliases.join(own, "idx", "left")
    open_base = F.startswith("source", F.lit("wikidata"))
    repeats = F.coalesce(F.lower("name") == F.col("own"), F.lit(False))
    strange = F.coalesce((F.col("source") == "wikidata") & (F.lower("sci_name") != F.col("own")), F.lit(False))
    elsewhere = nodes.groupBy("name").agg(F.min("idx").alias("_least"), F.max("idx").alias("_most"))
    k = j.where(~repeats & ~strange).join(elsewhere, "name", "left")
    other = F.coalesce(open_base & (F.col("idx").isNull() | (F.col("_least") != F.col("idx")) | (F.col("_most") != F.col("idx"))) & F.col("_least").isNotNull(), F.lit(False))
    return k.where(~other).select(*aliases.columns)


def with_manual(candidates: DataFrame, manual: DataFrame) -> DataFrame:
    """Candidates and manual rows (source, source_id, idx, reason), which come
    first; a null idx suppresses. A blank reason is refused."""
    blank = manual.where(F.trim(F.coalesce("reason", F.lit(""))) == "").limit(1).count()
    if blank:
        raise ValueError("a manual row has no reason")
    rows = manual.select("source", "source_id", F.col("idx").cast("long").alias("idx"), F.lit("manual").alias("method"), F.lit(0).cast("long").alias("input_pos"))
    return candidates.select("source", "source_id", "idx", "method", "input_pos").unionByName(rows)


def new_ambiguities(before: DataFrame, now: DataFrame) -> DataFrame:
    """Keys (source, source_id, status) that are ambiguous now and were not before."""
    keys = ["source", "source_id"]
    twin = lambda df: df.where("status = 'ambiguous'").select(*keys).distinct()
    return twin(now).join(twin(before), keys, "left_anti")


def with_unresolved(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source, source_id, idx, method) of every fact: 'unresolved' where nothing claims it."""
    keys = ["source", "source_id"]
    return facts.select(*keys).distinct().join(resolved.select(*keys, "idx", "method"), keys, "left").withColumn("method", F.coalesce("method", F.lit("unresolved")))


def single_accepted(names: DataFrame, value: str = "accepted_id") -> DataFrame:
    """(name, accepted_id) of the names that mean one accepted id only."""
    return names.where(F.col(value).isNotNull()).groupBy("name").agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


#: Tips of a node that a cited relative may still stand for, and the passes in order of strength.
LIFT_TIPS = 100
PASSES = ("cited", "forwarded", "lifted", "named", "shortened")


def seed_passes(nodes: DataFrame, cited: DataFrame, forwards: DataFrame, taxonomy: DataFrame, titles: DataFrame, most: int = LIFT_TIPS, lines: DataFrame | None = None) -> DataFrame:
    """(node, asset, pass) offers of five passes: the cited id is a node; its forward
    is; its parent in the taxonomy is, with ``most`` tips at most; and for assets that
    landed nowhere so, their title is the name of one taxon that is a node; or its
    first two words or its first word are, of a node with ``most`` tips at most.

    A name of several taxa means the one that lies above (or is) a taxon that the
    asset cites, if there is just one such, and otherwise stops the search.
    nodes (ext, node, tips); cited (asset, ext); forwards (old, new); taxonomy (ext,
    parent, name, lineage); titles (asset, title); lines (ext, lineage): the lineages,
    if the taxonomy doesn't hold them.
    """
    lines = taxonomy if lines is None else lines
    hit = lambda name: nodes.select(F.col("ext").alias("_k"), F.col("node").alias(name), F.col("tips").alias(f"{name}_tips")).hint("merge")
    to = lambda df, key, name: df.join(hit(name), (F.coalesce(key, "asset") == F.col("_k")) & F.col(key).isNotNull(), "left").drop("_k")  # noqa: E731  rows without a key are spread by asset
    fwd = forwards.select(F.col("old").alias("ext"), F.col("new").alias("ext2")).hint("merge")
    up = taxonomy.select("ext", F.col("parent").alias("ext3")).hint("merge")
    tried = to(to(to(cited.select("asset", "ext").distinct().join(fwd, "ext", "left").join(up, "ext", "left"), "ext", "n1"), "ext2", "n2"), "ext3", "n3")
    node = F.coalesce("n1", "n2", F.when(F.col("n3_tips") <= most, F.col("n3")))
    step = F.when(F.col("n1").isNotNull(), 0).when(F.col("n2").isNotNull(), 1).otherwise(2)
    by_id = materialise(tried.select("asset", node.alias("node"), step.cast("long").alias("pass")).where("node IS NOT NULL"))

    words = F.split(F.trim("title"), r"\s+")
    cut = lambda k: F.when(F.size(words) > k, F.array_join(F.slice(words, 1, k), " "))
    asked = titles.where(F.trim("title") != "").join(by_id.select("asset").hint("merge"), "asset", "left_anti").select("asset", F.posexplode(F.array(F.trim("title"), cut(2), cut(1))).alias("at", "name")).where("name IS NOT NULL")
    asked = materialise(asked)
    ends = taxonomy.groupBy("name").agg(F.array(F.min("ext"), F.max("ext")).alias("ends")).select("name", F.explode("ends").alias("ext"))  # the least and the greatest tell whether a name has one taxon
    names = ends.groupBy("name").agg(F.count_distinct("ext").alias("n"), F.min("ext").alias("only"))  # no asset meets all taxa of its names
    above = cited.join(asked.select("asset").hint("merge"), "asset", "left_semi").join(lines.select("ext", "lineage").hint("merge"), "ext").select("asset", F.explode("lineage").alias("uid")).distinct()
    meant = above.join(taxonomy.select(F.col("ext").alias("uid"), "name").hint("merge"), "uid").join(asked.hint("merge"), ["asset", "name"]).groupBy("asset", "at").agg(F.count_distinct("uid").alias("m"), F.min("uid").alias("meant"))
    meaning = asked.join(names, "name").join(meant.hint("merge"), ["asset", "at"], "left")
    uid = F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("meant"))
    named = meaning.select("asset", "at", uid.alias("ext"))
    landed = to(to(named.where("ext IS NOT NULL").join(fwd, "ext", "left").unionByName(named.where("ext IS NULL").withColumn("ext2", F.col("ext"))), "ext", "n1"), "ext2", "n2")
    landed = landed.select("asset", "at", F.col("ext").isNull().alias("refused"), F.coalesce("n1", "n2").alias("node"), F.coalesce("n1_tips", "n2_tips").alias("tips"))
    first = landed.where("refused OR node IS NOT NULL").groupBy("asset").agg(F.min_by(F.struct("node", "tips", "at"), "at").alias("b"))
    by_name = first.where("b.node IS NOT NULL").where((F.col("b.at") == 0) | (F.col("b.tips") <= most)).select("asset", "b.node", F.when(F.col("b.at") == 0, 3).otherwise(4).cast("long").alias("pass"))
    return by_id.unionByName(by_name).select("node", "asset", "pass")


def fact_rows(records: DataFrame, attached: DataFrame) -> DataFrame:
    """Facts as they are served: shown under the accepted name and rank, with their
    own beside them. records: (id, accepted_id, name, rank, accepted_name,
    accepted_rank, ...); attached: (id, idx, method, walk, via)."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    accepted = F.coalesce("accepted_id", "id")
    return records.join(attached, "id", "left").select(
        "id", accepted.alias("accepted_id"), F.coalesce(text("accepted_name"), F.col("name")).alias("name"), text("accepted_rank").alias("rank"), F.col("name").alias("own_name"), text("rank").alias("own_rank"),
        F.coalesce(F.col("id") == F.col("accepted_id"), F.lit(False)).alias("is_primary"), F.col("idx").alias("attach"), F.col("method").alias("attach_method"), F.col("walk").alias("attach_walk"), F.col("via").alias("attach_via"),
    )


def vernaculars(rows: DataFrame, nodes: DataFrame, forwards: DataFrame) -> DataFrame:
    """Rows (row, ext, sci_name, ...) with ``idx``: by their id, followed through a
    forward, or where they have none by their exact taxon name, if one node has it.
    nodes: (idx, ext, name)."""
    f = forwards.select(F.col("old").alias("ext"), F.col("new").alias("_to"))
    key = rows.join(f, "ext", "left").withColumn("_key", F.coalesce("_to", "ext"))
    by_id = key.join(nodes.select(F.col("ext").alias("_key"), F.col("idx").alias("_by_id")), "_key", "left")
    one = nodes.where("name IS NOT NULL").groupBy(F.col("name").alias("sci_name")).agg(F.count("*").alias("_n"), F.min("idx").alias("_by_name")).where("_n = 1")
    j = by_id.join(one, "sci_name", "left")
    return j.select(*rows.columns, F.when(F.col("ext").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_name")).alias("idx"))


def clear_items(pages: DataFrame) -> DataFrame:
    """Rows (sci_name, item, name) of the taxon names that one item claims; others go whole."""
    one = pages.where(F.trim("name") != "").groupBy("sci_name").agg(F.count_distinct("item").alias("_n")).where("_n = 1").select("sci_name")
    return pages.where(F.trim("name") != "").join(one, "sci_name", "left_semi")


def reconciliation(resolved: DataFrame) -> DataFrame:
    """(method, rows, landed, refused): what became of each method's claims."""
    return resolved.groupBy("method").agg(F.count("*").alias("rows"), F.count_if(F.col("idx").isNotNull()).alias("landed"), F.count_if(F.col("refused")).alias("refused"))
