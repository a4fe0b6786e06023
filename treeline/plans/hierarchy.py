"""Registered queries: trees, paths, ages, propagation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import ages, layout, paths, propagate
from ..operators import tree as trees
from . import inputs as i
from .inputs import DUCK_TREE, T, duck, full, measured, rows, tree

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


SEL = f"sel AS (SELECT DISTINCT x.id FROM ({duck(i.CHOSEN)}) x JOIN t ON x.id = t.id)"


@query("tree_preorder", f"{DUCK_TREE} SELECT id, idx, depth, size FROM m")
def _(s, d):
    return i.numbered(s, d).select("id", "idx", "depth", "size")


@query("tree_metrics", f"{DUCK_TREE} SELECT id, child_count, child_count = 0 AS is_tip, tip_count, idx + size AS subtree_out FROM m")
def _(s, d):
    return measured(s, d)


@query("tree_profile", f"""{DUCK_TREE} SELECT count(*) FILTER (child_count = 0) AS tips, count(*) FILTER (child_count > 0) AS internal, min(depth) FILTER (child_count = 0) AS min_depth,
 round(avg(depth) FILTER (child_count = 0), 6) AS mean_depth, max(depth) FILTER (child_count = 0) AS max_depth, max(child_count) AS max_children,
 count(*) FILTER (child_count = 1) AS unary, count(*) FILTER (child_count > 2) AS polytomies FROM m""")  # fmt: skip
def _(s, d):
    return trees.profile(i.numbered(s, d), measured(s, d))


@query("tree_invariants", f"""{DUCK_TREE}, x AS (SELECT id, parent, CASE WHEN id % 50 = 3 THEN idx + 7 ELSE idx END AS idx, CASE WHEN id % 70 = 4 THEN depth + 1 ELSE depth END AS depth, idx + CASE WHEN id % 90 = 6 THEN 3 ELSE 0 END + size AS stop, child_count, CASE WHEN id % 40 = 9 THEN 2 ELSE tip_count END AS tip_count FROM m),
 j AS (SELECT x.*, p.idx AS pi, p.stop AS ps, p.depth AS pd FROM x LEFT JOIN x p ON p.id = x.parent)
 SELECT 'parent_before_child' AS rule, count(*) FILTER (pi >= idx) AS violations FROM j UNION ALL SELECT 'inside_parent', count(*) FILTER (stop > ps) FROM j UNION ALL SELECT 'depth_step', count(*) FILTER (depth <> pd + 1) FROM j
 UNION ALL SELECT 'one_root', count(*) FILTER (parent IS NULL AND idx <> 0) FROM j UNION ALL SELECT 'tip_is_leaf', count(*) FILTER (child_count = 0 AND tip_count <> 1) FROM j""")  # fmt: skip
def _(s, d):
    off = lambda k, r, by: F.when(F.col("id") % k == r, by).otherwise(0)
    t = tree(s, d).withColumn("idx", F.col("idx") + off(50, 3, 7)).withColumn("depth", F.col("depth") + off(70, 4, 1))
    m = measured(s, d).withColumn("subtree_out", F.col("subtree_out") + off(90, 6, 3)).withColumn("tip_count", F.when(F.col("id") % 40 == 9, 2).otherwise(F.col("tip_count")))
    return trees.invariants(t, m)


FORWARD = "SELECT p_partkey AS old, (p_partkey * 7 + 3) % 400 AS new FROM {part}"


@query("forward_closure", f"""WITH RECURSIVE f AS ({duck(FORWARD)}), w AS (SELECT old, new AS tip, [old, new] AS seen, 1 AS n FROM f WHERE old <> new
 UNION ALL SELECT w.old, f.new, list_append(w.seen, f.new), w.n + 1 FROM w JOIN f ON w.tip = f.old WHERE NOT list_contains(w.seen, f.new))
 SELECT old, arg_max(tip, n) AS new FROM w GROUP BY old""")  # fmt: skip
def _(s, d):
    return trees.forward_closure(rows(s, d, FORWARD), hops=400)


@query("path_to_root", f"{DUCK_TREE}, {SEL} SELECT sel.id, t.depth AS step, c.anc FROM sel JOIN c ON c.id = sel.id JOIN t ON t.id = c.anc")
def _(s, d):
    return paths.path_to_root(tree(s, d), rows(s, d, i.CHOSEN))


PAIRS = f"SELECT {2 * T} + n_nationkey AS u, {3 * T} + n_nationkey * 11 AS v FROM {{nation}}"


@query("is_ancestor_pairs", f"{DUCK_TREE} SELECT q.u, q.v, exists(SELECT 1 FROM c WHERE c.id = q.v AND c.anc = q.u) AS above FROM ({duck(PAIRS)}) q WHERE q.v IN (SELECT id FROM t)")
def _(s, d):
    return paths.is_above(i.numbered(s, d), rows(s, d, PAIRS))


GROUPS = f"SELECT c_custkey % 40 AS grp, {3 * T} + c_custkey AS id FROM {{customer}}"


@query("mrca", f"""{DUCK_TREE}, g AS ({duck(GROUPS)}), n AS (SELECT grp, count(*) AS n FROM g GROUP BY grp)
 SELECT x.grp, arg_max(x.anc, t.depth) AS mrca FROM (SELECT g.grp, c.anc, count(*) AS k FROM g JOIN c ON g.id = c.id GROUP BY ALL) x JOIN n ON n.grp = x.grp AND n.n = x.k JOIN t ON t.id = x.anc GROUP BY x.grp""")  # fmt: skip
def _(s, d):
    return paths.common_ancestor(tree(s, d), rows(s, d, GROUPS), "grp")


INDUCED = f"""{DUCK_TREE}, {SEL}, k AS (SELECT count(*) AS n FROM sel),
 up AS (SELECT sel.id, c.anc, c.hops, t.depth FROM sel JOIN c ON c.id = sel.id JOIN t ON t.id = c.anc),
 top AS (SELECT arg_max(anc, depth) AS mrca, max(depth) AS lvl FROM (SELECT anc, depth, count(*) AS k FROM up GROUP BY ALL) WHERE k = (SELECT n FROM k)),
 marked AS (SELECT DISTINCT anc AS id, depth FROM up WHERE depth >= (SELECT lvl FROM top)),
 forks AS (SELECT t.parent AS id FROM marked JOIN t ON t.id = marked.id JOIN marked p ON p.id = t.parent GROUP BY t.parent HAVING count(*) > 1),
 ren AS (SELECT id FROM sel UNION SELECT id FROM forks UNION SELECT mrca FROM top),
 near AS (SELECT ren.id, min(c.hops) AS h FROM ren JOIN c ON c.id = ren.id AND c.hops > 0 JOIN ren r2 ON r2.id = c.anc GROUP BY ren.id),
 ind AS (SELECT ren.id, near.h, c.anc FROM ren LEFT JOIN near USING (id) LEFT JOIN c ON c.id = ren.id AND c.hops = near.h)"""


@query("induced_subtree", f"""{INDUCED} SELECT ind.id, ind.anc, coalesce((SELECT string_agg(CAST(c.anc AS VARCHAR), ',' ORDER BY c.hops DESC) FROM c WHERE c.id = ind.id AND c.hops > 0 AND c.hops < ind.h), '') AS suppressed,
 ind.id IN (SELECT id FROM sel) AS is_selected, ind.id = (SELECT mrca FROM top) AS is_mrca FROM ind""")  # fmt: skip
def _(s, d):
    out = paths.induced_subtree(tree(s, d), rows(s, d, i.CHOSEN))
    return out.withColumn("suppressed", F.array_join(F.transform("suppressed", lambda x: x.cast("string")), ","))


LEVELS = "".join(f", y{k} AS (SELECT * FROM y{k + 1} UNION ALL SELECT i.anc, (min(y.y) + max(y.y)) / 2 FROM ind i JOIN y{k + 1} y ON y.id = i.id JOIN t ON t.id = i.anc WHERE t.depth = {k} GROUP BY i.anc)" for k in (3, 2, 1, 0))


@query("layout_rows", f"""{INDUCED}, y4 AS (SELECT ind.id, CAST(row_number() OVER (ORDER BY t.idx) - 1 AS DOUBLE) AS y FROM ind JOIN t ON t.id = ind.id WHERE ind.id NOT IN (SELECT anc FROM ind WHERE anc IS NOT NULL)){LEVELS} SELECT id, y FROM y0""")
def _(s, d):
    shown = paths.induced_subtree(tree(s, d), rows(s, d, i.CHOSEN)).join(tree(s, d).select("id", "idx", "depth"), "id")
    return layout.rows(shown)


LOWER = 3 * T + 11


@query("segments", f"{DUCK_TREE} SELECT c.anc AS id, t.depth - 1 AS step FROM c JOIN t ON t.id = c.anc WHERE c.id = {LOWER} AND c.anc <> 0")
def _(s, d):
    return paths.segment(tree(s, d), 0, LOWER)


@query("segment_facts", f"{DUCK_TREE} SELECT f.fact, f.attach FROM ({duck(i.FACTS)}) f WHERE f.attach IN (SELECT anc FROM c WHERE id = {LOWER} AND anc <> 0)")
def _(s, d):
    chain = paths.segment(tree(s, d), 0, LOWER).select(F.col("id").alias("attach"))
    return rows(s, d, i.FACTS).join(chain, "attach", "left_semi").select("fact", "attach")


ASKED = "SELECT concat('k', p_partkey) AS key FROM {part} WHERE p_partkey <= 60"


@query("paths_batch", f"""WITH a AS ({duck(ASKED)}), n AS (SELECT concat('k', n_nationkey) AS ext, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT concat('k', n_nationkey) AS ext, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey % 6 = 5),
 f AS (SELECT concat('k', n_nationkey + 25) AS old, concat('k', n_nationkey) AS new FROM nation)
 SELECT a.key, coalesce(n.id, b.id, fn.id, fb.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'node' WHEN b.id IS NOT NULL THEN 'broken' WHEN fn.id IS NOT NULL THEN 'forwarded' WHEN fb.id IS NOT NULL THEN 'forwarded_broken' ELSE 'unknown' END AS status
 FROM a LEFT JOIN n ON n.ext = a.key LEFT JOIN b ON b.ext = a.key LEFT JOIN f ON f.old = a.key LEFT JOIN n fn ON fn.ext = f.new LEFT JOIN b fb ON fb.ext = f.new""")  # fmt: skip
def _(s, d):
    n = rows(s, d, "SELECT concat('k', n_nationkey) AS ext, n_nationkey AS id FROM {nation}")
    f = rows(s, d, "SELECT concat('k', n_nationkey + 25) AS old, concat('k', n_nationkey) AS new FROM {nation}")
    return paths.resolve_keys(rows(s, d, ASKED), n.where("id % 2 = 0"), f, n.where("id % 6 = 5"))


SPREAD = f"""{DUCK_TREE}, a AS ({duck(i.AGES)}), bare AS (SELECT id FROM t WHERE id NOT IN (SELECT id FROM a)),
 up AS (SELECT c.id, arg_min(a.age, c.hops) AS above, min(c.hops) AS above_hops FROM c JOIN a ON a.id = c.anc WHERE c.hops > 0 GROUP BY c.id), dn AS (SELECT c.anc AS id, max(a.age) AS below FROM c JOIN a ON a.id = c.id WHERE c.hops > 0 AND a.age > 0 GROUP BY c.anc)"""


@query("layout_spread", f"""{SPREAD} SELECT bare.id, above, above_hops, below, CASE WHEN above IS NULL THEN NULL WHEN below IS NULL THEN 'toPresent' WHEN above > below THEN 'between' ELSE 'collapsed' END AS kind
 FROM bare LEFT JOIN up USING (id) LEFT JOIN dn USING (id)""")  # fmt: skip
def _(s, d):
    a = i.nodes(s, d).select("id").join(rows(s, d, i.AGES).hint("merge"), "id", "left")
    return paths.layout_spread(i.numbered(s, d), a).withColumn("kind", paths.spread_kind(F.col("above"), F.col("below")))


@query("lineage_ladder", f"""{DUCK_TREE}, sel AS (SELECT {4 * T} + o_orderkey AS id FROM orders WHERE o_orderkey % 200 = 1), o AS (SELECT * FROM (VALUES ('region', 0), ('state', 1), ('nation', 2), ('customer', 3)) v(rank, place)),
 b AS (SELECT sel.id, o.place, c.anc AS node FROM sel JOIN c ON c.id = sel.id JOIN t ON t.id = c.anc JOIN o ON o.rank = t.rank)
 SELECT s.id, o.rank, b.node FROM (SELECT DISTINCT id FROM b) s CROSS JOIN o LEFT JOIN b ON b.id = s.id AND b.place = o.place""")  # fmt: skip
def _(s, d):
    return paths.ladder(tree(s, d), rows(s, d, f"SELECT {4 * T} + o_orderkey AS id FROM {{orders}} WHERE o_orderkey % 200 = 1"), ["region", "state", "nation", "customer"])


BRANCHES = "SELECT n_regionkey AS fork, n_nationkey AS branch, CAST(0 AS BIGINT) AS place, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS name FROM {nation} UNION ALL SELECT n_regionkey, n_nationkey, CAST(1 AS BIGINT), lower(n_name) FROM {nation}"


@query("divergence_names", f"""WITH b AS ({duck(BRANCHES)}), f AS (SELECT fork, branch, arg_min(name, place) AS name FROM b WHERE name IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY fork ORDER BY branch) AS k, count(*) OVER (PARTITION BY fork) AS n FROM f)
 SELECT CAST(fork AS BIGINT) AS fork, string_agg(name, ', ' ORDER BY branch) FILTER (k <= 3) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) ELSE '' END AS label FROM r GROUP BY fork""")  # fmt: skip
def _(s, d):
    return paths.fork_names(rows(s, d, BRANCHES))


NESTED = i.CHOSEN + f" UNION ALL SELECT {4 * T} + o_orderkey FROM {{{{orders}}}} WHERE o_custkey % 97 = 5".replace("{{", "{").replace("}}", "}")


@query("nested_selection", f"{DUCK_TREE}, sel AS (SELECT DISTINCT x.id FROM ({duck(NESTED)}) x JOIN t ON x.id = t.id) SELECT sel.id, arg_min(c.anc, c.hops) AS within FROM sel JOIN c ON c.id = sel.id AND c.hops > 0 JOIN sel s2 ON s2.id = c.anc GROUP BY sel.id")
def _(s, d):
    return paths.nested(tree(s, d), rows(s, d, NESTED))


@query("fact_places", f"""{INDUCED}, hid AS (SELECT c.anc AS attach, ind.id AS lower FROM ind JOIN c ON c.id = ind.id AND c.hops > 0 AND c.hops < ind.h)
 SELECT f.fact, CASE WHEN ind.id IS NOT NULL THEN 'rendered' WHEN hid.lower IS NOT NULL THEN 'suppressed' ELSE 'off_tree' END AS place, coalesce(ind.id, hid.lower) AS "at" FROM ({duck(i.FACTS)}) f LEFT JOIN ind ON ind.id = f.attach LEFT JOIN hid ON hid.attach = f.attach""")  # fmt: skip
def _(s, d):
    return paths.place_of(rows(s, d, i.FACTS).select("fact", "attach"), paths.induced_subtree(tree(s, d), rows(s, d, i.CHOSEN)))


#: The same tree of the odd ids only, under other names.
INDUCED_ODD = re.sub(r"\b(sel|k|up|top|marked|forks|ren|near|ind)\b", r"\1_odd", INDUCED.removeprefix(DUCK_TREE)).replace("JOIN t ON x.id = t.id)", "JOIN t ON x.id = t.id WHERE x.id % 2 = 1)")


@query("add_delta", f"""{INDUCED}{INDUCED_ODD}, st AS (SELECT ind.id, ind.anc, ind.id IN (SELECT id FROM ind_odd) AS was FROM ind), ch AS (SELECT id, anc AS flare, CAST(1 AS BIGINT) AS wave FROM st WHERE NOT was
 UNION ALL SELECT ch.id, st.anc, ch.wave + 1 FROM ch JOIN st ON st.id = ch.flare WHERE NOT st.was) SELECT id, arg_max(coalesce(flare, -1), wave) AS flare, max(wave) AS wave FROM ch GROUP BY id""")  # fmt: skip
def _(s, d):
    sel = rows(s, d, i.CHOSEN)
    before = paths.induced_subtree(tree(s, d), sel.where(F.col("id") % 2 == 1))
    return paths.added(before, paths.induced_subtree(tree(s, d), sel)).withColumn("flare", F.coalesce("flare", F.lit(-1)))


# ------------------------------------------------------------------ ages


@query("node_ages", f"""{DUCK_TREE}, l AS ({duck(i.LENGTHS)}), d AS (SELECT c.id, sum(coalesce(l.length, 0)) AS d FROM c LEFT JOIN l ON l.id = c.anc GROUP BY c.id), x AS (SELECT c.anc AS id, max(d.d) AS hi, min(d.d) AS lo FROM c JOIN m ON m.id = c.id AND m.child_count = 0 JOIN d ON d.id = c.id GROUP BY c.anc)
 SELECT d.id, round(x.hi - d.d, 4) + 0.0 AS oldest, round(x.lo - d.d, 4) + 0.0 AS youngest FROM d JOIN x USING (id)""")  # fmt: skip
def _(s, d):
    return ages.node_ages(i.numbered(s, d), rows(s, d, i.LENGTHS)).select("id", (F.round("oldest", 4) + 0.0).alias("oldest"), (F.round("youngest", 4) + 0.0).alias("youngest"))


def _clades(s, d):
    tips = tree(s, d).where("rank = 'customer'").select("id", "lineage")
    ours = tips.select(F.col("id").alias("tip"), F.posexplode(F.reverse("lineage")).alias("depth", "id"))
    theirs = i.segments(s, d).where(f"id >= {3 * T} AND id < {4 * T}").select(F.col("id").alias("tip"), F.posexplode(F.reverse("lineage")).alias("depth", "id"))
    return ours.select("id", "tip", "depth"), theirs.select("id", "tip", "depth")


#: The customers under segments within nations: a second topology whose nodes are matched with ours.
OTHER_TREE = f"""
SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent
UNION ALL SELECT {5 * T} + n_nationkey, CAST(0 AS BIGINT) FROM {{nation}}
UNION ALL SELECT DISTINCT {6 * T} + c_nationkey * 1000 + c_custkey % 7 % 4, {5 * T} + c_nationkey FROM {{customer}} WHERE c_nationkey % 5 <> 4 OR c_custkey % 2 = 0
UNION ALL SELECT {3 * T} + c_custkey, CASE WHEN c_nationkey % 5 <> 4 OR c_custkey % 2 = 0 THEN {6 * T} + c_nationkey * 1000 + c_custkey % 7 % 4 ELSE {5 * T} + (c_nationkey + 1) % 25 END FROM {{customer}}"""
#: World, nations (one in four with its neighbour, one in three with the whole) and customers.
MATCHED = f"SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS other UNION ALL SELECT {2 * T} + n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN {5 * T} + (n_nationkey + 1) % 25 WHEN n_nationkey % 3 = 1 THEN CAST(0 AS BIGINT) ELSE {5 * T} + n_nationkey END FROM {{nation}} UNION ALL SELECT {3 * T} + c_custkey, {3 * T} + c_custkey FROM {{customer}}"


@query("clade_congruence", f"""{DUCK_TREE}, ot AS ({duck(OTHER_TREE)}), mt AS ({duck(MATCHED)}), oc AS (SELECT id, id AS anc, parent AS nxt FROM ot UNION ALL SELECT oc.id, ot.id, ot.parent FROM oc JOIN ot ON oc.nxt = ot.id),
 tips AS (SELECT t.id FROM t JOIN ot USING (id) WHERE t.rank = 'customer' AND t.id NOT IN (SELECT parent FROM ot WHERE parent IS NOT NULL)), o AS (SELECT c.anc AS id, c.id AS tip FROM c JOIN tips ON tips.id = c.id), g AS (SELECT oc.anc AS other, oc.id AS tip FROM oc JOIN tips ON tips.id = oc.id),
 n2 AS (SELECT other, count(*) AS n FROM g GROUP BY other), x AS (SELECT mt.id, mt.other, count(*) AS shared, count(g.tip) AS inside FROM mt JOIN o ON o.id = mt.id LEFT JOIN g ON g.other = mt.other AND g.tip = o.tip GROUP BY ALL)
 SELECT x.id, x.other, x.shared, CASE WHEN inside = shared AND n2.n = shared THEN 'identical' WHEN inside = shared THEN 'subset' ELSE 'conflict' END AS class FROM x LEFT JOIN n2 USING (other) WHERE shared >= 2""")  # fmt: skip
def _(s, d):
    theirs = i._once(s, d, "other_tree", lambda: trees.preorder(rows(s, d, OTHER_TREE)))
    leaf = lambda t: t.join(t.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().withColumn("_k", F.lit(True)), "id", "left").withColumn("is_tip", F.col("_k").isNull())
    return ages.congruence(leaf(i.numbered(s, d).where("rank <> 'order'")), leaf(theirs), rows(s, d, MATCHED))


@query("clade_comparison", f"""{DUCK_TREE}, sg AS ({duck(i.SEGMENTS)}), g AS (SELECT id, id AS anc, parent AS nxt FROM sg WHERE id >= {3 * T} AND id < {4 * T} UNION ALL SELECT g.id, sg.id, sg.parent FROM g JOIN sg ON g.nxt = sg.id),
 a AS (SELECT DISTINCT string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id) AS clade FROM c JOIN t ON t.id = c.id WHERE t.rank = 'customer' GROUP BY c.anc), b AS (SELECT DISTINCT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS clade FROM g GROUP BY anc)
 SELECT 'first' AS side, count(*) AS clades FROM (SELECT * FROM a EXCEPT SELECT * FROM b) HAVING count(*) > 0 UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) HAVING count(*) > 0""")
def _(s, d):
    a, b = _clades(s, d)
    return paths.same_clades(a.select("id", "tip"), b.select("id", "tip"))


TIERS = f"""mt AS ({duck(i.MATCHES)}), f AS (SELECT id, max(other_age) AS a, bool_or(class = 'shared_tip') AS st, bool_or(class = 'identical') AS ident, bool_or(class = 'subset') AS sub, bool_or(class = 'conflict') AS con FROM mt GROUP BY id),
 tr AS (SELECT t.id, f.a, CAST(CASE WHEN coalesce(con, false) OR a IS NULL THEN 2 WHEN sub THEN 1 WHEN ident THEN 0 WHEN a <= 0.001 THEN 0 WHEN st THEN 0 ELSE 1 END AS BIGINT) AS tier FROM t LEFT JOIN f USING (id))"""


@query("age_tiers", f"{DUCK_TREE}, {TIERS} SELECT id, CASE WHEN tier <> 2 THEN a END AS age, tier FROM tr")
def _(s, d):
    return ages.tiers(i.nodes(s, d), rows(s, d, i.MATCHES))


@query("tier_counts", f"{DUCK_TREE}, {TIERS} SELECT tier, count(*) AS nodes, count(*) FILTER (m.child_count > 0) AS internal FROM tr JOIN m USING (id) GROUP BY tier")
def _(s, d):
    return ages.tier_counts(tree(s, d), ages.tiers(i.nodes(s, d), rows(s, d, i.MATCHES)), measured(s, d))


ROOT_AGE = 9999.0
LAYOUT = f"""{DUCK_TREE}, a0 AS ({duck(i.AGES)}), n AS (SELECT t.id, t.parent, t.depth, CASE WHEN t.parent IS NULL THEN {ROOT_AGE} ELSE a0.age END AS age FROM t LEFT JOIN a0 USING (id)),
 l4 AS (SELECT *, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS BIGINT) AS down FROM n WHERE depth = 4)"""
for _k in (3, 2, 1, 0):
    LAYOUT += f""", k{_k} AS (SELECT parent AS id, max(coalesce(age, lo)) AS lo, CAST(min(CASE WHEN age IS NOT NULL THEN 1 ELSE down + 1 END) AS BIGINT) AS down FROM l{_k + 1} GROUP BY parent),
 l{_k} AS (SELECT n.*, k{_k}.lo, k{_k}.down FROM n LEFT JOIN k{_k} USING (id) WHERE depth = {_k})"""
LAYOUT += ", q0 AS (SELECT id, age, age AS here, age AS top, CAST(0 AS BIGINT) AS up FROM l0)"
for _k in (1, 2, 3, 4):
    LAYOUT += f""", r{_k} AS (SELECT l.id, l.age, l.lo, l.down, q.age AS pa, q.here AS ph, q.top AS pt, q.up + 1 AS up, least(coalesce(l.lo, 0), q.top) AS bot FROM l{_k} l JOIN q{_k - 1} q ON q.id = l.parent),
 q{_k} AS (SELECT id, CASE WHEN age IS NOT NULL THEN least(age, coalesce(pa, age)) END AS age,
  least(CASE WHEN age IS NOT NULL THEN least(age, coalesce(pa, age)) ELSE pt - (pt - bot) * up / (up + coalesce(down, 1)) END, ph) AS here, CASE WHEN age IS NOT NULL THEN least(age, coalesce(pa, age)) ELSE pt END AS top, CASE WHEN age IS NOT NULL THEN 0 ELSE up END AS up FROM r{_k})"""
LAYOUT += ", lay AS (SELECT id, round(here, 4) AS age_layout FROM q0 UNION ALL SELECT id, round(here, 4) FROM q1 UNION ALL SELECT id, round(here, 4) FROM q2 UNION ALL SELECT id, round(here, 4) FROM q3 UNION ALL SELECT id, round(here, 4) FROM q4)"


def _layout(s, d):
    return i._once(s, d, "layout", lambda: ages.layout_fill(i.numbered(s, d), rows(s, d, i.AGES), ROOT_AGE).select("id", F.round("age_layout", 4).alias("age_layout")))


@query("layout_ages", f"{LAYOUT} SELECT * FROM lay")
def _(s, d):
    return _layout(s, d)


@query("age_violations", f"{DUCK_TREE}, a AS ({duck(i.AGES)}) SELECT t.id, x.age, y.age AS p_age FROM t JOIN a x ON x.id = t.id JOIN a y ON y.id = t.parent WHERE x.age > y.age")
def _(s, d):
    return ages.violations(i.nodes(s, d), rows(s, d, i.AGES))


BOUNDS = f"SELECT {4 * T} + o_orderkey AS id, floor(o_totalprice) / 50 AS bound FROM {{orders}} WHERE o_orderstatus = 'P'"
BOUND_SQL = f"bo AS ({duck(BOUNDS)}), lw AS (SELECT c.anc AS id, max(bo.bound) AS bound FROM c JOIN bo ON bo.id = c.id GROUP BY c.anc), bd AS (SELECT * FROM lw WHERE id NOT IN (SELECT c.anc FROM c WHERE c.id IN (SELECT id FROM a0)))"


@query("bound_propagation", f"{DUCK_TREE}, a0 AS ({duck(i.AGES)}), {BOUND_SQL} SELECT id, bound FROM bd")
def _(s, d):
    return ages.bound_propagation(i.numbered(s, d), rows(s, d, BOUNDS), rows(s, d, i.AGES))


@query("bound_layout", f"""{LAYOUT}, {BOUND_SQL}, w AS (SELECT lay.id, greatest(age_layout, coalesce(bound, age_layout)) AS want, bound FROM lay LEFT JOIN bd USING (id)),
 z AS (SELECT c.id, min(w.want) AS age_layout FROM c JOIN w ON w.id = c.anc GROUP BY c.id) SELECT z.id, z.age_layout, coalesce(z.age_layout < w.bound, false) AS short FROM z JOIN w USING (id)""")  # fmt: skip
def _(s, d):
    return ages.bound_layout(i.numbered(s, d), _layout(s, d), ages.bound_propagation(i.numbered(s, d), rows(s, d, BOUNDS), rows(s, d, i.AGES)))


@query("occurrence_best", f"{DUCK_TREE}, {TIERS}, f2 AS ({duck(i.FACTS)}) SELECT attach, name, n_occs, oldest, youngest FROM (SELECT *, row_number() OVER (PARTITION BY attach ORDER BY n_occs DESC, name) AS k FROM f2 WHERE attach IN (SELECT id FROM tr WHERE tier = 2)) WHERE k = 1")
def _(s, d):
    return ages.occurrence_best(rows(s, d, i.FACTS), ages.tiers(i.nodes(s, d), rows(s, d, i.MATCHES)))


# ------------------------------------------------------------------ propagation

EX = f"""sd AS (SELECT x.* FROM ({duck(i.SEEDS)}) x JOIN t USING (id)), ex AS (SELECT id, source FROM (SELECT c.anc AS id, c.id AS source, row_number() OVER (PARTITION BY c.anc ORDER BY m.tip_count DESC, m.depth, c.id) AS k FROM c JOIN sd ON sd.id = c.id JOIN m ON m.id = c.id) WHERE k = 1),
 nr AS (SELECT c.id, min(c.hops) AS climb FROM c JOIN ex ON ex.id = c.anc GROUP BY c.id),
 dr AS (SELECT nr.id, CASE WHEN sd.id IS NOT NULL THEN nr.id ELSE ex.source END AS source, CASE WHEN sd.id IS NOT NULL THEN nr.id ELSE c.anc END AS clade, CASE WHEN sd.id IS NOT NULL THEN 0 ELSE nr.climb END AS climb
  FROM nr JOIN c ON c.id = nr.id AND c.hops = nr.climb JOIN ex ON ex.id = c.anc LEFT JOIN sd ON sd.id = nr.id)"""


@query("exemplars", f"{DUCK_TREE}, {EX} SELECT id, source FROM ex")
def _(s, d):
    return propagate.exemplars(full(s, d), rows(s, d, i.SEEDS))


def _drawn(s, d):
    return i._once(s, d, "drawn", lambda: propagate.nearest_drawn(i.numbered(s, d), rows(s, d, i.SEEDS), claims=True))


@query("propagate_nearest", f"""{DUCK_TREE}, {EX} SELECT t.id, sd.asset, dr.source, dr.clade, dr.climb, CASE WHEN dr.id IS NULL THEN 'none' WHEN dr.id = dr.source THEN 'exact' WHEN EXISTS (SELECT 1 FROM c WHERE c.id = dr.id AND c.anc = dr.source) THEN 'ancestor'
 WHEN EXISTS (SELECT 1 FROM c WHERE c.id = dr.source AND c.anc = dr.id) THEN 'descendant' ELSE 'relative' END AS method FROM t LEFT JOIN dr ON dr.id = t.id LEFT JOIN sd ON sd.id = dr.source""")  # fmt: skip
def _(s, d):
    return _drawn(s, d).drop("claim")


@query("claim_percentiles", f"""{DUCK_TREE}, {EX} SELECT count(*) AS nodes, round(avg(CASE WHEN m.tip_count <= 1000 THEN 1.0 ELSE 0.0 END), 6) AS informative, quantile_disc(m.tip_count, 0.5) AS p50, quantile_disc(m.tip_count, 0.75) AS p75, quantile_disc(m.tip_count, 0.9) AS p90
 FROM dr JOIN m ON m.id = dr.clade""")  # fmt: skip
def _(s, d):
    return propagate.claim_figures(_drawn(s, d), full(s, d), 1000)


@query("asset_order", f"{DUCK_TREE}, {EX} SELECT sd.asset, max(m.tip_count) AS covers FROM dr JOIN sd ON sd.id = dr.source JOIN m ON m.id = dr.clade GROUP BY sd.asset")
def _(s, d):
    return propagate.asset_order(_drawn(s, d), full(s, d))


@query("witness", f"""{LAYOUT}, fk AS (SELECT m.id, coalesce(a0.age, lay.age_layout) AS aged FROM m JOIN lay USING (id) LEFT JOIN a0 USING (id) WHERE m.tip_count > 1 AND m.id NOT IN (SELECT id FROM ({duck(i.SEEDS)}))), f AS ({duck(i.FACTS)}),
 x AS (SELECT fk.id, f.fact, greatest(fk.aged - f.oldest, f.youngest - fk.aged, 0) AS gap, f.oldest - f.youngest AS width, f.walk, f.n_occs FROM f JOIN c ON c.id = f.attach JOIN fk ON fk.id = c.anc WHERE f.is_primary AND f.is_extinct AND f.youngest > 0.0117 AND fk.aged > 0)
 SELECT id, fact, round(gap, 4) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, width, walk, n_occs DESC, fact) AS k FROM x) WHERE k = 1""")  # fmt: skip
def _(s, d):
    a = _layout(s, d).join(rows(s, d, i.AGES).hint("merge"), "id", "left")
    return propagate.witness(i.lined(s, d), a, rows(s, d, i.FACTS), rows(s, d, i.SEEDS)).select("id", "fact", F.round("gap", 4).alias("gap"))


ENDS = """SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN CAST(floor(p_partkey / 10) AS BIGINT) END AS parent_id, length(concat('', p_partkey)) - 1 AS level, CAST(200 + p_size AS DOUBLE) AS fea, CAST(100 + p_size * 2 AS DOUBLE) AS lea,
 CASE WHEN p_partkey % 13 <> 0 THEN CAST(20 + p_size AS DOUBLE) END AS lla, p_partkey % 9 + 2 AS n_occs, CASE p_partkey % 11 WHEN 0 THEN 'I' WHEN 1 THEN 'XF' END AS flags FROM {part}"""


ENDS_SQL = f"""WITH e AS ({duck(ENDS)}), t AS (SELECT e.*, greatest(0, n_occs - coalesce(ch.s, 0)) AS own_occs FROM e LEFT JOIN (SELECT parent_id AS p, sum(n_occs) AS s FROM e GROUP BY 1) ch ON ch.p = e.id),
 r6 AS (SELECT id, parent_id, lla, lla AS sub_min, lla AS sub_lea, n_occs AS sub_at FROM e WHERE false)"""
for _k in (5, 4, 3, 2, 1, 0):  # keys of up to six digits
    ENDS_SQL += f""", k{_k} AS (SELECT parent_id AS kid, mn AS fin, arg_min(sub_lea, id) AS fin_lea, CAST(sum(sub_at) AS BIGINT) AS n_at FROM (SELECT *, min(sub_min) OVER (PARTITION BY parent_id) AS mn FROM r{_k + 1} WHERE sub_min IS NOT NULL) WHERE sub_min = mn GROUP BY parent_id, mn),
 q{_k} AS (SELECT t.*, k.fin, k.fin_lea, k.n_at, coalesce(k.fin < t.lla, false) AS un, regexp_matches(coalesce(flags, ''), '[IF]') AS form, k.n_at < 5 AS sparse, k.fin > t.fea AS contra FROM t LEFT JOIN k{_k} k ON k.kid = t.id WHERE t.level = {_k}),
 c{_k} AS (SELECT *, un AND NOT form AND NOT sparse AND NOT contra AS cl FROM q{_k}), d{_k} AS (SELECT *, CASE WHEN cl THEN fin ELSE lla END AS drawn, least(CASE WHEN cl THEN fin ELSE lla END, CASE WHEN cl OR lla IS NULL THEN fin END) AS sub_min FROM c{_k}),
 r{_k} AS (SELECT id, parent_id, lla, CASE WHEN un THEN fin END AS identified, CASE WHEN un THEN n_at END AS end_occs, drawn AS lla_drawn, CASE WHEN cl THEN fin_lea ELSE lea END AS lea_drawn, un AS unwitnessed, cl AS clamped, un AND form AS refused_form, un AND NOT form AND sparse AS refused_sparse,
  un AND NOT form AND NOT sparse AND contra AS refused_contradiction, sub_min, CASE WHEN sub_min = lla THEN lea ELSE fin_lea END AS sub_lea, CASE WHEN lla = sub_min THEN own_occs ELSE 0 END + CASE WHEN fin = sub_min THEN coalesce(n_at, 0) ELSE 0 END AS sub_at FROM d{_k})"""
ENDS_SQL += " UNION ALL".join(f" SELECT * EXCLUDE (parent_id, sub_min, sub_lea, sub_at) FROM r{_k}" for _k in range(6))


@query("young_ends", ENDS_SQL)
def _(s, d):
    return propagate.young_ends(rows(s, d, ENDS))


BRACKETS = "SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN CAST(p_size + 20 AS DOUBLE) END AS fea, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS fla, CASE WHEN p_size % 14 > 0 THEN CAST(p_size % 30 + 5 AS DOUBLE) END AS lea, CASE WHEN p_size % 7 > 0 THEN CAST(1 AS DOUBLE) END AS lla FROM {part}"


@query("brackets", f"""SELECT id, CASE WHEN fea IS NULL AND fla IS NULL AND lea IS NULL AND lla IS NULL THEN 'absent' WHEN fea IS NULL OR fla IS NULL OR lea IS NULL OR lla IS NULL THEN 'unrecorded' WHEN fla > lea THEN 'extent' WHEN fla = lea THEN 'instant' ELSE 'overlapping' END AS kind,
 greatest(fea, fla, lea, lla) AS oldest, least(fea, fla, lea, lla) AS youngest FROM ({duck(BRACKETS)})""")  # fmt: skip
def _(s, d):
    c = [F.col(x) for x in ("fea", "fla", "lea", "lla")]
    old, young = propagate.span(*c)
    return rows(s, d, BRACKETS).select("id", propagate.bracket(*c).alias("kind"), old.alias("oldest"), young.alias("youngest"))


@query("graft_join", f"""WITH f AS (SELECT id AS fact, id % 25 AS attach, fea, lea, lla FROM ({duck(BRACKETS)})), a AS (SELECT n_nationkey AS attach, CAST(n_nationkey * 10 AS BIGINT) AS anchor, CAST(n_nationkey AS DOUBLE) AS low, CAST(n_nationkey + 30 AS DOUBLE) AS high FROM nation WHERE n_nationkey % 5 <> 0),
 j AS (SELECT f.*, a.anchor, a.low, a.high, greatest(fea, lea, lla) AS old FROM f LEFT JOIN a USING (attach)), r AS (SELECT *, CASE WHEN old IS NULL THEN 'no_range' WHEN anchor IS NULL THEN 'off_tree' END AS refused FROM j)
 SELECT -fact AS key, CASE WHEN refused IS NULL THEN anchor END AS anchor, CASE WHEN refused IS NULL THEN least(greatest(old, low), high) END AS join_age, CASE WHEN refused IS NULL THEN CASE WHEN old < low THEN 'anchor' WHEN old > high THEN 'parent' ELSE 'edge' END END AS join_at, refused FROM r""")  # fmt: skip
def _(s, d):
    f = rows(s, d, BRACKETS).select(F.col("id").alias("fact"), (F.col("id") % 25).alias("attach"), "fea", "lea", "lla")
    a = rows(s, d, "SELECT n_nationkey AS attach, n_nationkey * 10 AS anchor, CAST(n_nationkey AS DOUBLE) AS low, CAST(n_nationkey + 30 AS DOUBLE) AS high FROM {nation} WHERE n_nationkey % 5 <> 0")
    return layout.grafts(f, a)


@query("lane_rows", f"""WITH f AS (SELECT attach, name, fact % 3 <> 0 AS dated, n_occs, fact FROM ({duck(i.FACTS)})), r AS (SELECT *, row_number() OVER (PARTITION BY attach, dated ORDER BY n_occs DESC, fact) AS k FROM f)
 SELECT attach, count(*) FILTER (NOT dated OR k <= 8) AS shown, count(*) AS total, coalesce(string_agg(name, ', ' ORDER BY k) FILTER (dated AND k <= 8), '') AS placed, coalesce(string_agg(name, ', ' ORDER BY k) FILTER (NOT dated AND k <= 5), '') || CASE WHEN count(*) FILTER (NOT dated AND k > 5) > 0 THEN ' and ' || count(*) FILTER (NOT dated AND k > 5) || ' more' ELSE '' END AS listed FROM r GROUP BY attach""")  # fmt: skip
def _(s, d):
    return layout.lane(rows(s, d, i.FACTS), "attach", [F.desc("n_occs"), "fact"], F.col("fact") % 3 != 0)
