"""Registered queries: detail views, seeding passes, vernacular chain, prefix scan, reports, client state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, lit
from ..operators import ages, events, gates, layout, names, paths, propagate, resolve, search, serving, timescale
from ..runtime import table
from ..sources import tables
from ..streaming import ingest
from . import inputs as i
from .hierarchy import EX, LAYOUT, ROOT_AGE, _drawn, _layout
from .inputs import DUCK_TREE, T, duck, full, rows, tree
from .timeline import EV, OK_SQL, SCALE, _lab, _scale

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# ------------------------------------------------------------------ paths

ASKED_NODES = f"SELECT {T} + r_regionkey AS of FROM {{region}} WHERE r_regionkey < 2 UNION ALL SELECT {2 * T} + n_nationkey FROM {{nation}} WHERE n_nationkey = 9"


@query("descendants", f"{DUCK_TREE} SELECT q.of, c.id FROM ({duck(ASKED_NODES)}) q JOIN c ON c.anc = q.of")
def _(s, d):
    return paths.descendants(tree(s, d), rows(s, d, ASKED_NODES))


@query("subtree_interval", f"{DUCK_TREE} SELECT id, idx FROM m WHERE idx >= (SELECT idx FROM m WHERE id = {2 * T + 9}) AND idx < (SELECT idx + size FROM m WHERE id = {2 * T + 9})")
def _(s, d):
    return paths.interval(i.numbered(s, d), 2 * T + 9).select("id", "idx")


BATCH_KEYS = "SELECT concat('k', p_partkey) AS key, (p_partkey * 7) % 61 AS pos FROM {part} WHERE p_partkey <= 60"
BATCH_SQL = f"""b AS ({duck(BATCH_KEYS)}), nn AS (SELECT 'k' || n_nationkey AS ext, {2 * T} + n_nationkey AS id, n_nationkey AS k FROM nation), f AS (SELECT 'k' || (n_nationkey + 25) AS old, 'k' || n_nationkey AS nxt FROM nation),
 r AS (SELECT b.key, b.pos, coalesce(n1.id, n2.id) AS id, CASE WHEN n1.k % 2 = 0 THEN 'node' WHEN n1.k % 6 = 5 THEN 'broken' WHEN n2.k % 2 = 0 THEN 'forwarded' WHEN n2.k % 6 = 5 THEN 'forwarded_broken' ELSE 'unknown' END AS status FROM b LEFT JOIN nn n1 ON n1.ext = b.key LEFT JOIN f ON f.old = b.key LEFT JOIN nn n2 ON n2.ext = f.nxt),
 rs AS (SELECT key, pos, status, CASE WHEN status <> 'unknown' THEN id END AS id FROM r)"""


def _batch(s, d):
    n = rows(s, d, f"SELECT concat('k', n_nationkey) AS ext, {2 * T} + n_nationkey AS id, n_nationkey AS k FROM {{nation}}")
    f = rows(s, d, "SELECT concat('k', n_nationkey + 25) AS old, concat('k', n_nationkey) AS new FROM {nation}")
    return n.where("k % 2 = 0").select("ext", "id"), f, n.where("k % 6 = 5").select("ext", "id")


@query("batch_paths", f"{DUCK_TREE}, {BATCH_SQL} SELECT rs.key, rs.id, rs.status, string_agg(CAST(c.anc AS VARCHAR), ',' ORDER BY c.hops DESC) AS path FROM rs LEFT JOIN c ON c.id = rs.id GROUP BY ALL")
def _(s, d):
    n, f, b = _batch(s, d)
    out = paths.batch_paths(tree(s, d), rows(s, d, BATCH_KEYS), n, f, b)
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


@query("batch_split", f"WITH {BATCH_SQL} SELECT pos, key, CASE WHEN status IN ('node', 'forwarded') THEN 'ok' WHEN status = 'unknown' THEN 'unresolved' ELSE 'broken' END AS part FROM rs")
def _(s, d):
    n, f, b = _batch(s, d)
    asked = rows(s, d, BATCH_KEYS)
    return paths.resolution(paths.resolve_keys(asked, n, f, b), asked)


@query("route_counts", f"WITH {BATCH_SQL} SELECT status AS route, count(*) AS n FROM rs GROUP BY status")
def _(s, d):
    n, f, b = _batch(s, d)
    return ages.by_route(paths.resolve_keys(rows(s, d, BATCH_KEYS), n, f, b))


BINOMIALS = "SELECT p_partkey % 40 AS fork, p_partkey AS branch, CAST(0 AS BIGINT) AS place, CASE WHEN p_partkey % 3 = 0 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) ELSE p_name END AS name FROM {part}"


@query("divergence_names_short", f"""WITH b AS (SELECT fork, branch, CASE WHEN regexp_matches(name, '^[A-Z][a-z]+ [a-z][a-z-]+$') THEN name[1] || '. ' || split_part(name, ' ', 2) ELSE name END AS name FROM ({duck(BINOMIALS)})), r AS (SELECT *, row_number() OVER (PARTITION BY fork ORDER BY branch) AS k, count(*) OVER (PARTITION BY fork) AS n FROM b)
 SELECT CAST(fork AS BIGINT) AS fork, string_agg(name, ', ' ORDER BY branch) FILTER (k <= 3) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) ELSE '' END AS label FROM r GROUP BY fork""")  # fmt: skip
def _(s, d):
    return paths.fork_names(rows(s, d, BINOMIALS), shorten=True)


# ------------------------------------------------------------------ ages

RANGES = f"SELECT {2 * T} + n_nationkey AS id, CAST(6000 + n_nationkey * 9 AS DOUBLE) AS low, CAST(6100 + n_nationkey * 9 AS DOUBLE) AS high FROM {{nation}}"


@query("age_ranges", f"SELECT r.id, r.low, r.high, a.age, coalesce(a.age BETWEEN r.low AND r.high, false) AS passed FROM ({duck(RANGES)}) r LEFT JOIN ({duck(i.AGES)}) a USING (id)")
def _(s, d):
    return ages.in_range(rows(s, d, i.AGES), rows(s, d, RANGES))


@query("label_kinds", "SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'STANDARD' WHEN p_type LIKE 'S%' THEN 'S' WHEN p_type LIKE 'ECO%' THEN 'ECO' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def _(s, d):
    return ages.label_kinds(table(s, d, "part").select(F.col("p_type").alias("label")), ["STANDARD", "S", "ECO"])


@query("age_headline", f"""{DUCK_TREE}, f AS (SELECT id, max(other_age) AS a, bool_or(class = 'shared_tip') AS st, bool_or(class = 'identical') AS ident, bool_or(class = 'subset') AS sub, bool_or(class = 'conflict') AS con FROM ({duck(i.MATCHES)}) GROUP BY id),
 tr AS (SELECT CASE WHEN coalesce(con, false) OR a IS NULL THEN 2 WHEN sub THEN 1 WHEN ident OR a <= 0.001 OR st THEN 0 ELSE 1 END AS tier FROM t LEFT JOIN f USING (id))
 SELECT count(*) AS nodes, count(*) FILTER (tier = 0) AS measured, count(*) FILTER (tier < 2) AS dated, round(count(*) FILTER (tier < 2) / count(*), 6) AS dated_share FROM tr""")  # fmt: skip
def _(s, d):
    return ages.headline(ages.tiers(i.nodes(s, d), rows(s, d, i.MATCHES)))


OLD_BOUNDS = f"SELECT {3 * T} + c_custkey AS id, floor(abs(c_acctbal)) / 2 + 100 AS bound FROM {{customer}} WHERE c_custkey % 3 <> 0"
REACH_SQL = f"""bo AS ({duck(OLD_BOUNDS)}), rc AS (SELECT bo.id, bo.bound, least(bo.bound, p.age_layout) AS reach, greatest(least(bo.bound, p.age_layout) - lay.age_layout, 0) AS short FROM bo JOIN t ON t.id = bo.id JOIN lay ON lay.id = bo.id LEFT JOIN lay p ON p.id = t.parent)"""


@query("reachable_bounds", f"{LAYOUT}, {REACH_SQL} SELECT id, round(reach, 4) AS reach, round(short, 4) AS short FROM rc")
def _(s, d):
    r = ages.reachable(i.nodes(s, d), rows(s, d, OLD_BOUNDS), _layout(s, d))
    return r.select("id", F.round("reach", 4).alias("reach"), F.round("short", 4).alias("short"))


@query("reach_figures", f"{LAYOUT}, {REACH_SQL} SELECT count(*) AS bounds, count(*) FILTER (short > 0) AS short, round(median(bound - reach) FILTER (bound > reach), 6) AS median_rest FROM rc")
def _(s, d):
    b = rows(s, d, OLD_BOUNDS)
    return ages.reach_figures(ages.reachable(i.nodes(s, d), b, _layout(s, d)), b)


# ------------------------------------------------------------------ resolution

MANUAL = "SELECT 'a' AS source, concat('', p_partkey) AS source_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS idx, 'checked by hand' AS reason FROM {part} WHERE p_partkey % 7 = 3 AND p_partkey < 400"
PREC = f"pr AS (SELECT * FROM (VALUES ('manual', 1), ('ott_sourceinfo', 2), ('phylopic_resolve', 5), ('name_exact', 6)) v(method, p))"


@query("manual_overrides", f"""WITH {PREC}, cd AS (SELECT source, source_id, idx, method, input_pos FROM ({duck(i.CANDIDATES)}) UNION ALL SELECT source, source_id, idx, 'manual', 0 FROM ({duck(MANUAL)}))
 SELECT source, source_id, idx, method FROM (SELECT cd.*, row_number() OVER (PARTITION BY source, source_id ORDER BY p, input_pos) AS k FROM cd JOIN pr USING (method)) WHERE k = 1""")  # fmt: skip
def _(s, d):
    return resolve.precedence(resolve.with_manual(rows(s, d, i.CANDIDATES), rows(s, d, MANUAL)))


@query("with_unresolved", f"""WITH {PREC}, w AS (SELECT source, source_id, idx, method FROM (SELECT c.*, row_number() OVER (PARTITION BY source, source_id ORDER BY p, input_pos) AS k FROM ({duck(i.CANDIDATES)}) c JOIN pr USING (method)) WHERE k = 1)
 SELECT 'a' AS source, f.source_id, w.idx, coalesce(w.method, 'unresolved') AS method FROM (SELECT '' || p_partkey AS source_id FROM part) f LEFT JOIN w ON w.source_id = f.source_id""")  # fmt: skip
def _(s, d):
    facts = rows(s, d, "SELECT 'a' AS source, concat('', p_partkey) AS source_id FROM {part}")
    return resolve.with_unresolved(facts, resolve.precedence(rows(s, d, i.CANDIDATES)))


STATES = "SELECT 'a' AS source, concat('', p_partkey) AS source_id, CASE WHEN p_size % {k} = 0 THEN 'ambiguous' ELSE 'matched' END AS status FROM {{part}}"


@query("new_ambiguities", "SELECT 'a' AS source, '' || p_partkey AS source_id FROM part WHERE p_size % 3 = 0 AND p_size % 4 <> 0")
def _(s, d):
    return resolve.new_ambiguities(rows(s, d, STATES.format(k=4)), rows(s, d, STATES.format(k=3)))


LINKED = "SELECT p_name AS name, CASE WHEN p_name LIKE 's%' THEN p_size ELSE length(p_name) END AS accepted_id FROM {part}"


@query("single_accepted", f"SELECT name, min(accepted_id) AS accepted_id FROM (SELECT name, CAST(accepted_id AS BIGINT) AS accepted_id FROM ({duck(LINKED)})) GROUP BY name HAVING count(DISTINCT accepted_id) = 1")
def _(s, d):
    return resolve.single_accepted(rows(s, d, LINKED))


#: A taxonomy over part keys, of which the even ones are nodes: part k under part floor(k / 5).
TAXA = "SELECT p_partkey AS ext, CASE WHEN p_partkey >= 5 THEN CAST(floor(p_partkey / 5) AS BIGINT) END AS parent, concat('g', p_partkey % 900, CASE WHEN p_partkey % 4 = 1 THEN ' s' ELSE '' END) AS name FROM {part} WHERE p_partkey >= 1"
TAXON_NODES = "SELECT p_partkey AS ext, p_partkey + 1000000 AS node, p_size * 5 AS tips FROM {part} WHERE p_partkey >= 1 AND p_partkey % 2 = 0"
CITED = "SELECT p_partkey AS asset, CASE WHEN p_partkey % 9 = 0 THEN p_partkey + 50000000 ELSE p_partkey END AS ext FROM {part} WHERE p_partkey % 3 = 0"
MOVED = "SELECT p_partkey AS old, p_partkey + 3 AS new FROM {part} WHERE p_partkey % 5 = 0"
TITLES = "SELECT p_partkey AS asset, concat('g', p_partkey % 1100, CASE p_partkey % 4 WHEN 0 THEN ' s x' WHEN 1 THEN ' s' WHEN 2 THEN ' t' ELSE '' END) AS title FROM {part}"
SEED_SQL = f"""WITH RECURSIVE nd AS ({duck(TAXON_NODES)}), ct AS ({duck(CITED)}), fw AS ({duck(MOVED)}), tx AS ({duck(TAXA)}), ti AS ({duck(TITLES)}),
 tl AS (SELECT ext, ext AS anc, parent AS nxt FROM tx UNION ALL SELECT tl.ext, tx.ext, tx.parent FROM tl JOIN tx ON tl.nxt = tx.ext),
 tr AS (SELECT ct.asset, n1.node AS a, n2.node AS b, CASE WHEN n3.tips <= 100 THEN n3.node END AS c FROM ct LEFT JOIN nd n1 ON n1.ext = ct.ext LEFT JOIN fw ON fw.old = ct.ext LEFT JOIN nd n2 ON n2.ext = fw.new LEFT JOIN tx ON tx.ext = ct.ext LEFT JOIN nd n3 ON n3.ext = tx.parent),
 ids AS (SELECT asset, coalesce(a, b, c) AS node, CAST(CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS pass FROM tr WHERE coalesce(a, b, c) IS NOT NULL),
 cand AS (SELECT asset, k AS at_, CASE k WHEN 0 THEN title WHEN 1 THEN CASE WHEN len(w) > 2 THEN w[1] || ' ' || w[2] END ELSE CASE WHEN len(w) > 1 THEN w[1] END END AS name FROM (SELECT *, string_split(title, ' ') AS w FROM ti WHERE asset NOT IN (SELECT asset FROM ids)), (SELECT unnest([0, 1, 2]) AS k)),
 kn AS (SELECT cand.asset, cand.at_, tx.ext AS uid, EXISTS (SELECT 1 FROM ct JOIN tl ON tl.ext = ct.ext WHERE ct.asset = cand.asset AND tl.anc = tx.ext) AS meant FROM cand JOIN tx ON tx.name = cand.name),
 mn AS (SELECT asset, at_, CASE WHEN count(DISTINCT uid) = 1 THEN min(uid) WHEN count(DISTINCT uid) FILTER (meant) = 1 THEN min(uid) FILTER (meant) END AS uid FROM kn GROUP BY ALL),
 ld AS (SELECT mn.asset, mn.at_, mn.uid IS NULL AS refused, coalesce(n1.node, n2.node) AS node, CASE WHEN n1.node IS NOT NULL THEN n1.tips ELSE n2.tips END AS tips FROM mn LEFT JOIN nd n1 ON n1.ext = mn.uid LEFT JOIN fw ON fw.old = mn.uid LEFT JOIN nd n2 ON n2.ext = fw.new),
 fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY at_) AS k FROM ld WHERE refused OR node IS NOT NULL) WHERE k = 1),
 offers AS (SELECT node, asset, pass FROM ids UNION ALL SELECT node, asset, CAST(CASE WHEN at_ = 0 THEN 3 ELSE 4 END AS BIGINT) FROM fs WHERE node IS NOT NULL AND (at_ = 0 OR tips <= 100))"""


def _offers(s, d):
    from ..operators.tree import lineages

    taxa = rows(s, d, TAXA)
    lines = i._once(s, d, "taxa", lambda: lineages(taxa.select(F.col("ext").alias("id"), "parent")).select(F.col("id").alias("ext"), "lineage"))
    return resolve.seed_passes(rows(s, d, TAXON_NODES), rows(s, d, CITED), rows(s, d, MOVED), taxa, rows(s, d, TITLES), lines=lines)


@query("seed_passes", f"{SEED_SQL} SELECT node, asset, pass FROM offers")
def _(s, d):
    return _offers(s, d)


@query("seed_chain", f"{SEED_SQL} SELECT node, asset, pass FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pass, asset) AS k FROM offers) WHERE k = 1")
def _(s, d):
    return resolve.seeds(_offers(s, d).withColumn("is_primary", F.lit(True)).withColumn("modified", F.lit(0)))


RECORDS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN CAST(floor(p_partkey / 3) AS BIGINT) WHEN p_partkey % 7 <> 0 THEN p_partkey END AS accepted_id, p_name AS name, p_brand AS rank, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS accepted_name, CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('rank ', p_size % 6) END AS accepted_rank FROM {part}"


@query("fact_rows", f"""SELECT id, coalesce(accepted_id, id) AS accepted_id, CASE WHEN accepted_name <> '' THEN accepted_name ELSE name END AS name, nullif(accepted_rank, '') AS rank, name AS own_name, rank AS own_rank, coalesce(id = accepted_id, false) AS is_primary,
 a.idx AS attach, a.method AS attach_method, CASE WHEN a.idx IS NOT NULL THEN CAST(0 AS BIGINT) END AS attach_walk, CASE WHEN a.idx IS NOT NULL THEN r.id END AS attach_via FROM ({duck(RECORDS)}) r LEFT JOIN (SELECT id AS k, idx, CAST(method AS BIGINT) AS method FROM ({duck(i.RESOLVED)})) a ON a.k = r.id""")  # fmt: skip
def _(s, d):
    at = rows(s, d, i.RESOLVED).select("id", "idx", F.col("method").cast("long").alias("method"), F.lit(0).cast("long").alias("walk"), F.col("id").alias("via"))
    return resolve.fact_rows(rows(s, d, RECORDS), at)


NAMED_NODES = "SELECT n_nationkey AS idx, n_nationkey * 10 AS ext, CASE WHEN n_nationkey % 8 = 7 THEN 'NATION_0' ELSE n_name END AS name FROM {nation}"
VERNACULAR = """SELECT c_custkey AS row, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey * 10 + CASE WHEN c_custkey % 4 = 0 THEN 5 ELSE 0 END END AS ext, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'NATION_3' WHEN c_custkey % 13 = 0 THEN 'NATION_0' ELSE n_name END AS sci_name,
 CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN 'NATION_2' ELSE lower(c_mktsegment) END AS name, CASE c_custkey % 2 WHEN 0 THEN 'wikidata' ELSE 'list' END AS source FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"""
FIVES = "SELECT n_nationkey * 10 + 5 AS old, n_nationkey * 10 AS new FROM {nation} WHERE n_nationkey % 2 = 0"
VERN_SQL = f"""nn AS ({duck(NAMED_NODES)}), v AS ({duck(VERNACULAR)}), f AS ({duck(FIVES)}), one AS (SELECT name, min(idx) AS idx FROM nn GROUP BY name HAVING count(*) = 1),
 vr AS (SELECT v.row, CAST(v.ext AS BIGINT) AS ext, v.sci_name, v.name, v.source, CAST(CASE WHEN v.ext IS NOT NULL THEN a.idx ELSE one.idx END AS BIGINT) AS idx FROM v LEFT JOIN f ON f.old = v.ext LEFT JOIN nn a ON a.ext = coalesce(f.new, v.ext) LEFT JOIN one ON one.name = v.sci_name)"""


def _vernaculars(s, d):
    return resolve.vernaculars(rows(s, d, VERNACULAR), rows(s, d, NAMED_NODES), rows(s, d, FIVES))


@query("vernacular_resolve", f'WITH {VERN_SQL} SELECT "row", ext, sci_name, name, source, idx FROM vr')
def _(s, d):
    return _vernaculars(s, d)


@query("vernacular_prune", f"""WITH {VERN_SQL} SELECT "row", name, idx FROM vr WHERE NOT EXISTS (SELECT 1 FROM nn WHERE nn.idx = vr.idx AND lower(nn.name) = lower(vr.name)) AND NOT (source LIKE 'wikidata%' AND EXISTS (SELECT 1 FROM nn WHERE nn.name = vr.name AND (vr.idx IS NULL OR nn.idx <> vr.idx)))
 AND NOT (source = 'wikidata' AND idx IS NOT NULL AND sci_name IS NOT NULL AND EXISTS (SELECT 1 FROM nn WHERE nn.idx = vr.idx AND lower(nn.name) <> lower(vr.sci_name)))""")  # fmt: skip
def _(s, d):
    return resolve.prune_aliases(_vernaculars(s, d), rows(s, d, NAMED_NODES)).select("row", "name", "idx")


ITEMS = "SELECT p_type AS sci_name, concat('Q', p_size % CASE WHEN length(p_type) % 3 = 0 THEN 2 ELSE 1 END) AS item, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_name END AS name FROM {part}"


@query("clear_items", f"WITH p AS (SELECT * FROM ({duck(ITEMS)}) WHERE trim(name) <> '') SELECT sci_name, item, name FROM p WHERE sci_name IN (SELECT sci_name FROM p GROUP BY sci_name HAVING count(DISTINCT item) = 1)")
def _(s, d):
    return resolve.clear_items(rows(s, d, ITEMS))


@query("reconciliation", f"WITH c AS ({duck(i.CANDIDATES)}) SELECT method, count(*) AS rows, count(idx) AS landed, count(*) FILTER (input_pos % 5 = 0) AS refused FROM c GROUP BY method")
def _(s, d):
    return resolve.reconciliation(rows(s, d, i.CANDIDATES).withColumn("refused", F.col("input_pos") % 5 == 0))


# ------------------------------------------------------------------ propagation

FACT_ENDS = "SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS lla, CASE WHEN p_size % 9 > 0 THEN CAST(p_size + 30 AS DOUBLE) END AS fea, CAST(p_size + 12 AS DOUBLE) AS lea, p_partkey % 3 <> 0 AS clamped, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 70 AS DOUBLE) END AS identified, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 90 AS DOUBLE) END AS ident_lea FROM {part}"


@query("row_bounds", f"""WITH f AS (SELECT *, clamped AND identified IS NOT NULL AND (lla IS NULL OR identified >= lla) AND (fea IS NULL OR identified <= fea) AS mv FROM ({duck(FACT_ENDS)}))
 SELECT id, CASE WHEN mv THEN identified ELSE lla END AS lla_drawn, CASE WHEN NOT mv OR ident_lea IS NULL THEN lea WHEN ident_lea < identified THEN identified WHEN fea IS NOT NULL AND ident_lea > fea THEN fea ELSE ident_lea END AS lea_drawn FROM f""")  # fmt: skip
def _(s, d):
    young, old = propagate.drawn_bounds(*[F.col(c) for c in ("lla", "fea", "lea", "clamped", "identified", "ident_lea")])
    return rows(s, d, FACT_ENDS).select("id", young.alias("lla_drawn"), old.alias("lea_drawn"))


@query("shown_bounds", f"SELECT id, CASE WHEN identified IS NOT NULL AND identified IS DISTINCT FROM lla THEN coalesce(ident_lea, lea) ELSE lea END AS lea, CASE WHEN identified IS NOT NULL THEN identified ELSE lla END AS lla, coalesce(identified > lla, false) AS unsure FROM ({duck(FACT_ENDS)})")
def _(s, d):
    f = rows(s, d, FACT_ENDS)
    _, _, lea, lla = propagate.shown_bounds(F.col("fea"), F.lit(None).cast("double"), F.col("lea"), F.col("lla"), F.col("ident_lea"), F.col("identified"))
    return f.select("id", lea.alias("lea"), lla.alias("lla"), propagate.indeterminate(F.col("lla"), F.col("identified")).alias("unsure"))


@query("climb_counts", f"{DUCK_TREE}, {EX} SELECT climb, count(*) AS nodes FROM dr GROUP BY climb")
def _(s, d):
    return propagate.climb_counts(_drawn(s, d))


@query("misplaced_pictures", f"""{DUCK_TREE}, {EX}, ct AS (SELECT asset, CASE WHEN asset % 4 = 0 THEN {3 * T} + asset ELSE {2 * T} + asset % 25 END AS ext FROM sd WHERE asset % 3 <> 2 AND asset < 1000000)
 SELECT count(*) AS checked, count(*) FILTER (NOT inside) AS outside FROM (SELECT dr.id, coalesce(bool_or(EXISTS (SELECT 1 FROM c WHERE c.id = ct.ext AND c.anc = dr.id)), false) AS inside FROM dr JOIN sd ON sd.id = dr.source JOIN ct ON ct.asset = sd.asset WHERE dr.id = dr.source GROUP BY dr.id)""")  # fmt: skip
def _(s, d):
    sd = rows(s, d, i.SEEDS).where("asset % 3 <> 2 AND asset < 1000000")
    cited = sd.select("asset", F.when(F.col("asset") % 4 == 0, 3 * T + F.col("asset")).otherwise(2 * T + F.col("asset") % 25).alias("ext"))
    return propagate.misplaced(_drawn(s, d), cited, tree(s, d).select(F.col("id").alias("ext"), "lineage"))


@query("informative_pictures", f"{DUCK_TREE}, {EX} SELECT m.id, sd.asset IS NOT NULL AND (cm.tip_count IS NULL OR cm.tip_count <= 1000) AS shown FROM m LEFT JOIN dr ON dr.id = m.id LEFT JOIN sd ON sd.id = dr.source LEFT JOIN m cm ON cm.id = dr.clade")
def _(s, d):
    return _drawn(s, d).select("id", propagate.informative(F.col("asset"), F.col("claim"), 1000).alias("shown"))


WITNESS = f"""{LAYOUT}, fk AS (SELECT m.id, coalesce(a0.age, lay.age_layout) AS aged FROM m JOIN lay USING (id) LEFT JOIN a0 USING (id) WHERE m.tip_count > 1 AND m.id NOT IN (SELECT id FROM ({duck(i.SEEDS)}))), f AS ({duck(i.FACTS)}),
 x AS (SELECT fk.id, f.fact, greatest(fk.aged - f.oldest, f.youngest - fk.aged, 0) AS gap, f.oldest - f.youngest AS width, f.walk, f.n_occs FROM f JOIN c ON c.id = f.attach JOIN fk ON fk.id = c.anc WHERE f.is_primary AND f.is_extinct AND f.youngest > 0.0117 AND fk.aged > 0 AND f.fact % 3 <> 1 AND greatest(fk.aged - f.oldest, f.youngest - fk.aged, 0) <= 0.2 * fk.aged),
 wt AS (SELECT id, fact, gap, walk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, width, walk, n_occs DESC, fact) AS k FROM x) WHERE k = 1)"""


def _witnesses(s, d):
    a = _layout(s, d).join(rows(s, d, i.AGES).hint("merge"), "id", "left")
    facts = rows(s, d, i.FACTS)
    return a, propagate.witness(i.lined(s, d), a, facts, rows(s, d, i.SEEDS), 0.2, facts.where("fact % 3 <> 1"))


@query("witness_near", f"{WITNESS} SELECT id, fact, round(gap, 4) AS gap FROM wt")
def _(s, d):
    return _witnesses(s, d)[1].select("id", "fact", F.round("gap", 4).alias("gap"))


@query("witness_figures", f"{WITNESS} SELECT count(*) AS forks, count(*) FILTER (gap = 0) AS spanning, count(*) FILTER (a0.age IS NULL) AS undated, round((SELECT max(n) FROM (SELECT count(*) AS n FROM wt GROUP BY fact)) / count(*), 6) AS prolific_share FROM wt LEFT JOIN a0 USING (id)")
def _(s, d):
    a, w = _witnesses(s, d)
    return propagate.witness_figures(w, a)


@query("witness_walks", f"{WITNESS} SELECT CAST(walk AS BIGINT) AS walk, count(*) AS forks FROM wt GROUP BY walk")
def _(s, d):
    return propagate.witness_walks(_witnesses(s, d)[1], rows(s, d, i.FACTS))


LICENCES = "SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'https://creativecommons.org/publicdomain/zero/1.0/' WHEN 2 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 3 THEN 'https://creativecommons.org/licenses/by-nc-sa/3.0/' WHEN 4 THEN 'https://creativecommons.org/licenses/by-sa/3.0/' WHEN 5 THEN 'https://example.org/' WHEN 6 THEN 'https://creativecommons.org/licenses/by-nc/3.0/' ELSE 'https://creativecommons.org/publicdomain/mark/1.0/' END AS url FROM {part}"


@query("licence_classes", "SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'public' WHEN 2 THEN 'by' WHEN 3 THEN 'by-nc-sa' WHEN 4 THEN 'by-sa' WHEN 5 THEN 'other' WHEN 6 THEN 'by-nc' ELSE 'public' END AS licence FROM part")
def _(s, d):
    return rows(s, d, LICENCES).select("id", propagate.licence(F.col("url")).alias("licence"))


# ------------------------------------------------------------------ search and names

NODES = "SELECT p_partkey AS idx, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS name, p_size * 3 + p_partkey % 7 AS tips FROM {part}"


@query("prefix_top", f"WITH n AS ({duck(NODES)}), v AS (SELECT unnest(['sm', 'Sm']) AS v) SELECT DISTINCT idx FROM (SELECT n.idx, row_number() OVER (PARTITION BY v.v ORDER BY tips DESC, n.idx) AS k FROM n, v WHERE starts_with(n.name, v.v)) WHERE k <= 20 UNION SELECT idx FROM n WHERE name IN ('sm', 'Sm')")
def _(s, d):
    return search.prefix_top(rows(s, d, NODES), "sm", 20)


@query("signal_scores", f"SELECT idx, round(ln(1 + tips) + CASE WHEN idx % 3 = 0 THEN 0.5 ELSE 0 END, 6) AS score FROM ({duck(NODES)})")
def _(s, d):
    n = rows(s, d, NODES)
    return search.signals(n, images=n.where("idx % 3 = 0")).select("idx", F.round("score", 6).alias("score"))


BROKEN = "SELECT concat('b', n_nationkey) AS key, concat(CASE n_nationkey % 5 WHEN 0 THEN 'Ina' WHEN 1 THEN 'Ída' ELSE 'Ora' END, ' rex') AS name FROM {nation}"


@query("broken_answers", "SELECT 'b' || n_nationkey AS key, CASE n_nationkey % 5 WHEN 0 THEN 'Ina' ELSE 'Ída' END || ' rex' AS name, 'abbreviation' AS matched_on FROM nation WHERE n_nationkey % 5 < 2 ORDER BY key LIMIT 2")
def _(s, d):
    return search.broken_answers(rows(s, d, BROKEN), "i. rex")


@query("matched_credit", f"SELECT idx, CASE WHEN lower(matched) <> lower(name) AND (shown IS NULL OR lower(matched) <> lower(shown)) THEN matched END AS credit, CASE WHEN idx % 3 = 0 THEN 'taxonomy: ' || matched WHEN idx % 3 = 1 THEN 'fossils: ' || matched END AS caption FROM (SELECT idx, name, CASE WHEN idx % 2 = 0 THEN upper(name) ELSE 'it' END AS matched, CASE WHEN idx % 5 = 0 THEN 'It' END AS shown FROM ({duck(NODES)}))")
def _(s, d):
    n = rows(s, d, NODES).withColumn("matched", F.when(F.col("idx") % 2 == 0, F.upper("name")).otherwise("it")).withColumn("shown", F.when(F.col("idx") % 5 == 0, "It"))
    on = F.element_at(F.array(F.lit("synonym"), F.lit("fossil-name"), F.lit("name")), (F.col("idx") % 3 + 1).cast("int"))
    return n.select("idx", search.credited(F.col("matched"), F.col("name"), F.col("shown")).alias("credit"), search.caption(on, F.col("matched")).alias("caption"))


SECTIONS = "SELECT concat('s', p_size % 4) AS section, concat('k', p_partkey) AS key, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 50 END AS ord, p_partkey AS pos FROM {part} WHERE p_partkey <= 300"


@query("section_merge", f"""WITH r AS (SELECT *, 4000 - coalesce(ord, pos) * 10 AS score FROM ({duck(SECTIONS)})), b AS (SELECT *, max(score) OVER (PARTITION BY section) AS best, min(pos) OVER (PARTITION BY section) AS first FROM r)
 SELECT row_number() OVER (ORDER BY CASE section WHEN 's2' THEN 1 WHEN 's0' THEN 2 ELSE 0 END, best DESC, first, score DESC, pos) AS place, section, key FROM b""")  # fmt: skip
def _(s, d):
    r = rows(s, d, SECTIONS).withColumn("score", search.row_score(F.col("ord"), F.col("pos")))
    return search.sections(r, ["s2", "s0"])


POOL = "SELECT p_partkey AS fact, p_partkey % 500 AS accepted_id, CASE WHEN p_size % 6 > 0 THEN CAST(p_size - 5 AS DOUBLE) END AS lla, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS lla_drawn, p_partkey % 2 = 0 AS is_primary, p_partkey % 3 AS walk, CASE p_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS is_extant FROM {part}"


@query("fact_pool", f"SELECT fact FROM ({duck(POOL)}) WHERE coalesce(lla_drawn, lla) > 0.0117 AND is_primary AND walk <> 0 AND is_extant = false AND accepted_id % 4 = 2")
def _(s, d):
    p = rows(s, d, POOL)
    return search.fact_pool(p, p.where("accepted_id % 4 = 2").select("accepted_id"))


@query("hits_unbroken", "SELECT min(p_partkey) AS pos, 'k' || p_partkey % 30 AS key, CAST(p_partkey % 30 * 2 AS BIGINT) AS idx FROM part WHERE p_partkey % 30 < 25 AND p_partkey % 30 % 6 <> 5 GROUP BY p_partkey % 30")
def _(s, d):
    asked = rows(s, d, "SELECT p_partkey AS pos, concat('k', p_partkey % 30) AS key FROM {part}")
    n = rows(s, d, "SELECT concat('k', n_nationkey) AS key, n_nationkey * 2 AS idx FROM {nation}")
    return search.hits(asked, n, n.where("idx % 12 = 10"))


@query("remembered_choices", """SELECT key, uses, days, round(boost, 6) AS boost FROM (SELECT 'k' || p_partkey AS key, CAST(p_size AS BIGINT) AS uses, CAST(p_partkey % 40 - 5 AS BIGINT) AS days, least(p_size, 12) * 14 * pow(2.0, -greatest(p_partkey % 40 - 5, 0) / 21.0) + 40 * pow(2.0, -greatest(p_partkey % 40 - 5, 0) / 21.0) AS boost FROM part) ORDER BY boost DESC, key LIMIT 50""")
def _(s, d):
    u = rows(s, d, "SELECT concat('k', p_partkey) AS key, p_size AS uses, p_partkey % 40 - 5 AS days FROM {part}")
    return search.remembered(u, 50).withColumn("boost", F.round("boost", 6))


@query("literal_highlights", "SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), 'widget') THEN (strpos(lower(p_name), 'widget') - 1) || '-' || (strpos(lower(p_name), 'widget') + 5) ELSE '' END AS ranges FROM part")
def _(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), lit(F.col("p_name"), F.lit("Widget")).alias("ranges"))


@query("whole_matches", "SELECT p_partkey AS id, CAST(1000 - (strpos(lower(p_name), 'idge') - 1) AS DOUBLE) AS score FROM part WHERE contains(lower(p_name), 'idge') AND NOT regexp_matches(lower(p_name), '(^|[ ._-])idge')")
def _(s, d):
    m = table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.lower("p_name").alias("n"), fuzzy(F.col("p_name"), F.lit("idge")).alias("m"))
    return m.where(F.contains("n", F.lit("idge")) & ~F.col("n").rlike("(^|[ ._-])idge")).select("id", "m.score")


FORMS = "SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ',') WHEN 1 THEN concat('The ', p_name) WHEN 2 THEN concat(p_name, ' (thing)') WHEN 3 THEN 'Felidae' WHEN 4 THEN 'T-Rex' WHEN 5 THEN 'T. rex' WHEN 6 THEN 'a, b' ELSE p_type END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Tyrannus rex' ELSE 'Felis' END AS sci FROM {part}"


@query("name_shapes", f"""SELECT id, CAST(CASE WHEN regexp_matches(n, '[,;:]\\s*$') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(n, '[(\\[]') THEN 2 ELSE 0 END + CASE WHEN contains(n, ',') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(n, '^(the|a|an)\\s+', 'i') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(n, '^[A-Z][a-z]+(aceae|idae|inae|oidea|ales|aria|ae|a|um|us|on|es)$') THEN 2 ELSE 0 END + CASE WHEN len(string_split_regex(n, '\\s+')) >= 4 THEN 1 ELSE 0 END + CASE WHEN sci = 'Tyrannus rex' AND n = 'T-Rex' THEN 1 ELSE 0 END AS BIGINT) AS shape,
 starts_with(lower(replace(n, ' ', '')), lower(split_part(sci, ' ', 1))[1:5]) AS stem FROM (SELECT id, trim(name) AS n, sci FROM ({duck(FORMS)}))""")  # fmt: skip
def _(s, d):
    f = rows(s, d, FORMS)
    return f.select("id", names.shape(F.col("name"), F.col("sci")).alias("shape"), names.stem_shared(F.col("name"), F.col("sci")).alias("stem"))


USAGE = "SELECT c_nationkey AS idx, 'en' AS lang, c_name AS name, CASE WHEN c_custkey % 7 > 0 THEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 = 0, c_custkey) END AS usage_rank FROM {customer}"


@query("name_census", f"WITH u AS ({duck(USAGE)}) SELECT (SELECT count(*) FROM u) AS before, (SELECT count(*) FROM u) AS after, (SELECT count(*) FROM (SELECT 1 FROM u GROUP BY idx, lang HAVING count(*) FILTER (usage_rank = 1) <> 1)) AS odd_groups")
def _(s, d):
    u = rows(s, d, USAGE)
    return names.census(u, names.primary(u.withColumn("usage_rank", F.coalesce("usage_rank", F.lit(0)))))


@query("all_names", f"SELECT CAST(idx AS BIGINT) AS idx, lang, string_agg(name, '|' ORDER BY usage_rank NULLS LAST, name) AS names FROM ({duck(USAGE)}) GROUP BY idx, lang")
def _(s, d):
    return names.all_names(rows(s, d, USAGE))


@query("best_names", f"SELECT CAST(idx AS BIGINT) AS idx, lang, arg_min(name, usage_rank) AS name FROM ({duck(USAGE)}) GROUP BY idx, lang")
def _(s, d):
    return names.best_name(rows(s, d, USAGE))


@query("name_takers", f"SELECT id, id % 3 < 2 AND lower(name) <> lower(sci) AS takes FROM ({duck(FORMS)})")
def _(s, d):
    rank = F.element_at(F.array(F.lit("species"), F.lit("genus"), F.lit("family")), (F.col("id") % 3 + 1).cast("int"))
    return rows(s, d, FORMS).select("id", names.takes_name(rank, F.col("name"), F.col("sci")).alias("takes"))


# ------------------------------------------------------------------ time scale and layout


@query("scale_index", f"""WITH {SCALE} SELECT 'children' AS kind, CAST(parent AS VARCHAR) AS key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY begin DESC, id) AS ids FROM sc WHERE parent IS NOT NULL GROUP BY parent
 UNION ALL SELECT 'rank', rank, string_agg(CAST(id AS VARCHAR), ',' ORDER BY begin DESC, id) FROM sc GROUP BY rank UNION ALL SELECT 'roots', '', string_agg(CAST(id AS VARCHAR), ',' ORDER BY begin DESC, id) FROM sc WHERE parent IS NULL""")  # fmt: skip
def _(s, d):
    return timescale.index_maps(_scale(s, d))


@query("scale_gates", f"""WITH {SCALE}, x AS (SELECT id, CASE WHEN id % 11 = 0 THEN 5 ELSE parent END AS parent, CASE WHEN id % 13 = 0 THEN 'year' ELSE rank END AS rank, begin, CASE WHEN id % 17 = 0 THEN begin + 1 ELSE "end" END AS "end", row_number() OVER (ORDER BY id) AS place FROM sc),
 j AS (SELECT x.*, CASE x.rank WHEN 'year' THEN 0 WHEN 'quarter' THEN 1 ELSE 2 END AS own, CASE p.rank WHEN 'year' THEN 0 WHEN 'quarter' THEN 1 WHEN 'month' THEN 2 END AS up, p.begin AS pb, p."end" AS pe FROM x LEFT JOIN x p ON p.id = x.parent)
 SELECT 'parent_known' AS rule, count(*) FILTER (parent IS NOT NULL AND pb IS NULL) AS violations FROM j UNION ALL SELECT 'rank_finer', count(*) FILTER (up >= own) FROM j UNION ALL SELECT 'begin_older', count(*) FILTER (begin < "end") FROM j
 UNION ALL SELECT 'inside_parent', count(*) FILTER (begin > pb OR "end" < pe) FROM j UNION ALL SELECT 'place_permutation', CAST(0 AS BIGINT)""")  # fmt: skip
def _(s, d):
    from pyspark.sql import Window

    x = _scale(s, d).select("id", F.when(F.col("id") % 11 == 0, 5).otherwise(F.col("parent")).alias("parent"), F.when(F.col("id") % 13 == 0, "year").otherwise(F.col("rank")).alias("rank"), "begin", F.when(F.col("id") % 17 == 0, F.col("begin") + 1).otherwise(F.col("end")).alias("end"))
    return timescale.scale_gates(x.withColumn("place", F.row_number().over(Window.orderBy("id"))), ["year", "quarter", "month"])


@query("oklch", f"WITH {OK_SQL} SELECT id, round(l, 5) + 0.0 AS l, round(sqrt(a * a + b * b), 5) AS c, CASE WHEN sqrt(a * a + b * b) > 0.001 THEN round(degrees(atan2(b, a)) + CASE WHEN b < 0 THEN 360 ELSE 0 END, 2) ELSE 0 END AS h FROM ok")
def _(s, d):
    light, chroma, hue = timescale.oklch([F.col(c) for c in "lab"])
    return _lab(s, d).select("id", (F.round(light, 5) + 0.0).alias("l"), F.round(chroma, 5).alias("c"), F.when(chroma > 0.001, F.round(hue, 2)).otherwise(0.0).alias("h"))


@query("sibling_drift", f"""WITH {OK_SQL}, k AS (SELECT id, id // 200 AS parent, l, a, b, least(greatest(0.32 + (l - 0.72) * 0.22, 0.24), 0.40) AS dl, a * CASE WHEN sqrt(a * a + b * b) > 0 THEN least(sqrt(a * a + b * b), 0.06) / sqrt(a * a + b * b) ELSE 0 END AS da, b * CASE WHEN sqrt(a * a + b * b) > 0 THEN least(sqrt(a * a + b * b), 0.06) / sqrt(a * a + b * b) ELSE 0 END AS db FROM ok)
 SELECT CAST(x.parent AS BIGINT) AS parent, round(max(abs(sqrt((x.dl - y.dl) ** 2 + (x.da - y.da) ** 2 + (x.db - y.db) ** 2) - 0.22 * sqrt((x.l - y.l) ** 2 + (x.a - y.a) ** 2 + (x.b - y.b) ** 2))), 6) AS drift FROM k x JOIN k y ON x.parent = y.parent AND x.id < y.id GROUP BY x.parent""")  # fmt: skip
def _(s, d):
    dim = timescale.dim([F.col(c) for c in "lab"])
    c = _lab(s, d).withColumn("parent", F.expr("id div 200"))
    return timescale.sibling_drift(c.select("id", "parent", "l", "a", "b", dim[0].alias("dl"), dim[1].alias("da"), dim[2].alias("db")))


@query("gap_labels", "SELECT id, CASE WHEN a < 0.1 THEN 'under 0.1 Ma' WHEN a < 10 THEN printf('%.1f Ma', round(a, 1)) ELSE printf('%.0f Ma', round(a)) END AS gap FROM (SELECT p_partkey AS id, (p_partkey % 331) / 8.0 AS a FROM part)")
def _(s, d):
    return rows(s, d, "SELECT p_partkey AS id, CAST(p_partkey % 331 AS DOUBLE) / 8.0 AS a FROM {part}").select("id", timescale.gap(F.col("a")).alias("gap"))


@query("axis_ticks")
def _(s, d):
    axes = rows(s, d, "SELECT n_nationkey AS axis, CAST(0 AS DOUBLE) AS low, CAST(10 + n_nationkey * 40 AS DOUBLE) AS high, 6 AS count, CAST(0.03 AS DOUBLE) AS gap, CAST(4567 AS DOUBLE) AS oldest FROM {nation}")
    return timescale.tick_rows(axes)


@query("layout_columns", f"{LAYOUT} SELECT id, round(1 - CASE WHEN least(age_layout, 4567.0) <= 1 THEN least(age_layout, 4567.0) * 0.07 ELSE 0.07 + log10(least(age_layout, 4567.0)) / log10(4567.0) * 0.93 END, 6) AS x FROM lay")
def _(s, d):
    return layout.columns(_layout(s, d), oldest=4567.0)


GRAFTED = "SELECT -p_partkey AS key, p_size AS anchor, CAST(p_partkey % 17 AS DOUBLE) AS join_age, CASE WHEN p_partkey % 6 = 0 THEN 'off_tree' END AS refused FROM {part}"


@query("graft_order", f"SELECT CAST(key AS BIGINT) AS key, CAST(anchor AS BIGINT) AS anchor, row_number() OVER (PARTITION BY anchor ORDER BY join_age, key DESC) - 1 AS row FROM ({duck(GRAFTED)}) WHERE refused IS NULL")
def _(s, d):
    return layout.graft_rows(rows(s, d, GRAFTED))


BETWEEN = "SELECT p_size AS seg, p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CASE p_partkey % 3 WHEN 0 THEN 'no rank' WHEN 1 THEN 'genus' END AS rank, p_partkey % 31 AS tips FROM {part}"


@query("lane_intermediates", f"SELECT CAST(seg AS BIGINT) AS seg, id, row_number() OVER (PARTITION BY seg ORDER BY CASE WHEN name IS NULL THEN 0 WHEN coalesce(rank, '') IN ('', 'no rank') THEN 1 ELSE 2 END DESC, tips DESC, id) AS place FROM ({duck(BETWEEN)})")
def _(s, d):
    return layout.intermediates(rows(s, d, BETWEEN), "seg")


# ------------------------------------------------------------------ serving, client state, reports

ASKED_DETAIL = f"SELECT {2 * T} + n_nationkey AS id FROM {{nation}} WHERE n_nationkey % 5 = 2"


@query("node_detail", f"""{DUCK_TREE}, a AS ({duck(ASKED_DETAIL)}), sy AS (SELECT {2 * T} + s_nationkey AS id, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS synonyms FROM supplier GROUP BY 1),
 vn AS (SELECT id, string_agg(name, '|' ORDER BY usage_rank, name) AS names FROM (SELECT DISTINCT {2 * T} + c_nationkey AS id, c_mktsegment AS name, length(c_mktsegment) AS usage_rank FROM customer) GROUP BY id)
 SELECT t.id, t.name, t.parent, p.name AS parent_name, coalesce(sy.synonyms, '') AS synonyms, coalesce(vn.names, '') AS names, 'Q' || (t.id % 1000) AS qid, CASE WHEN t.id % 2 = 0 THEN 'by someone' END AS credit FROM a JOIN t ON t.id = a.id LEFT JOIN t p ON p.id = t.parent LEFT JOIN sy ON sy.id = t.id LEFT JOIN vn ON vn.id = t.id""")  # fmt: skip
def _(s, d):
    t = i.nodes(s, d).select("id", "name", "parent")
    syn = rows(s, d, f"SELECT {2 * T} + s_nationkey AS id, s_name AS name FROM {{supplier}}")
    ver = rows(s, d, f"SELECT {2 * T} + c_nationkey AS id, c_mktsegment AS name, length(c_mktsegment) AS usage_rank FROM {{customer}}")
    n = rows(s, d, f"SELECT {2 * T} + n_nationkey AS id FROM {{nation}}")
    return serving.node_detail(t, rows(s, d, ASKED_DETAIL), syn, ver, n.select("id", F.concat(F.lit("Q"), (F.col("id") % 1000).cast("string")).alias("qid")), n.where("id % 2 = 0").select("id", F.lit("by someone").alias("credit")), t, n.select("id"))


@query("fact_detail", f"{DUCK_TREE} SELECT f.fact, f.name, f.attach, t.name AS at_name, t.rank, 'credit ' || f.fact AS credit FROM ({duck(i.FACTS)}) f LEFT JOIN t ON t.id = f.attach WHERE f.fact = 7")
def _(s, d):
    f = rows(s, d, i.FACTS).select("fact", "name", "attach", F.col("fact").alias("accepted_id"))
    credits = f.select("accepted_id", F.concat(F.lit("credit "), F.col("fact").cast("string")).alias("credit"))
    return serving.fact_detail(f, 7, i.nodes(s, d).select("id", F.col("name").alias("at_name"), "rank"), credits).drop("accepted_id")


@query("about_build", f"""{DUCK_TREE}, f AS (SELECT id, max(other_age) AS a, bool_or(class = 'shared_tip') AS st, bool_or(class = 'identical') AS ident, bool_or(class = 'subset') AS sub, bool_or(class = 'conflict') AS con FROM ({duck(i.MATCHES)}) GROUP BY id),
 tr AS (SELECT CASE WHEN coalesce(con, false) OR a IS NULL THEN 2 WHEN sub THEN 1 WHEN ident OR a <= 0.001 OR st THEN 0 ELSE 1 END AS tier FROM t LEFT JOIN f USING (id))
 SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'tier ' || tier, count(*) FROM tr GROUP BY tier UNION ALL SELECT 'phase tree', 1 UNION ALL SELECT 'feature images', 0""")  # fmt: skip
def _(s, d):
    tiers = ages.tiers(i.nodes(s, d), rows(s, d, i.MATCHES))
    return serving.about({n: table(s, d, n) for n in ("nation", "supplier")}, tiers, [("tree", True)], {"images": False})


@query("page_lookup", "SELECT CAST(min(n_nationkey) AS BIGINT) AS idx FROM nation WHERE n_regionkey = 3")
def _(s, d):
    pages = rows(s, d, "SELECT n_nationkey AS idx, concat('Q', n_regionkey) AS qid FROM {nation}")
    return serving.lookup(pages, "Q3")


@query("curated_lists", "WITH l AS (SELECT n_regionkey AS list, list('k' || n_nationkey ORDER BY n_name DESC) || ['zz'] AS keys FROM nation GROUP BY 1) SELECT CAST(list AS BIGINT) AS list, CAST(generate_subscripts(keys, 1) - 1 AS BIGINT) AS pos, unnest(keys) AS key, CAST(substr(unnest(keys), 2) AS BIGINT) AS idx FROM l WHERE true QUALIFY key <> 'zz'".replace(" WHERE true QUALIFY key <> 'zz'", ""))
def _(s, d):
    n = rows(s, d, "SELECT n_regionkey AS list, concat('k', n_nationkey) AS key, n_name AS name, n_nationkey AS idx FROM {nation}")
    order = F.array_sort(F.collect_list(F.struct("name", "key")), lambda a, b: F.when(a["name"] > b["name"], -1).when(a["name"] < b["name"], 1).otherwise(0))
    lists = n.groupBy("list").agg(F.transform(order, lambda x: x["key"]).alias("keys")).withColumn("keys", F.concat("keys", F.array(F.lit("zz"))))
    return serving.curated(lists, n)


ORACLES["curated_lists"] = "SELECT CAST(n_regionkey AS BIGINT) AS list, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) - 1 AS pos, 'k' || n_nationkey AS key, CAST(n_nationkey AS BIGINT) AS idx FROM nation"


@query("selection_change", "SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'kept' WHEN n_nationkey % 2 = 0 THEN 'removed' ELSE 'added' END AS change FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def _(s, d):
    n = rows(s, d, "SELECT concat('k', n_nationkey) AS key, n_nationkey AS k FROM {nation}")
    return serving.selection_change(n.where("k % 2 = 0"), n.where("k % 3 = 0"))


@query("suggestions_closed", "SELECT CAST(0 AS BIGINT) AS band, CAST(n_nationkey AS BIGINT) AS pos, 'k' || n_nationkey AS key FROM nation WHERE n_nationkey < 4 UNION ALL SELECT CAST(1 AS BIGINT), n_nationkey, 'k' || n_nationkey FROM nation WHERE n_nationkey BETWEEN 4 AND 9")
def _(s, d):
    n = rows(s, d, "SELECT concat('k', n_nationkey) AS key, n_nationkey AS pos FROM {nation}")
    open_, closed = serving.suggestions(n.where("pos < 4"), n.where("pos < 10"), " a "), serving.suggestions(n.where("pos < 4"), n.where("pos < 10"), "ab")
    return open_.unionByName(closed)


@query("posted_batches", f"""WITH RECURSIVE {EV}, o AS (SELECT session, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM ev),
 r AS (SELECT session, event_id, n, t AS first, 1 AS held, t, CAST(1 AS BIGINT) AS burst, CAST(0 AS BIGINT) AS batch FROM o WHERE n = 1 UNION ALL
 SELECT o.session, o.event_id, o.n, CASE WHEN o.t - r.t > 7200000000 OR r.held >= 5 OR o.t - r.first > 7200000000 THEN o.t ELSE r.first END, CASE WHEN o.t - r.t > 7200000000 OR r.held >= 5 OR o.t - r.first > 7200000000 THEN 1 ELSE r.held + 1 END, o.t,
 r.burst + CASE WHEN o.t - r.t > 7200000000 THEN 1 ELSE 0 END, CASE WHEN o.t - r.t > 7200000000 THEN 0 WHEN r.held >= 5 OR o.t - r.first > 7200000000 THEN r.batch + 1 ELSE r.batch END FROM r JOIN o ON o.session = r.session AND o.n = r.n + 1) SELECT session, event_id, burst, batch FROM r""")  # fmt: skip
def _(s, d):
    return ingest.posted(rows(s, d, i.EVENTS), 5, 7200.0)


SHARDS = "SELECT p_type AS a, p_brand AS b, p_name AS c, count(*) AS n FROM {part} GROUP BY p_type, p_brand, p_name"


@query("covering_shards", f"""WITH k AS ({duck(SHARDS)}), x AS (SELECT a, CAST(sum(n) AS BIGINT) AS size FROM k GROUP BY a), y AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS size FROM k WHERE a IN (SELECT a FROM x WHERE size > 35) GROUP BY a, b),
 z AS (SELECT a, b, c, CAST(sum(n) AS BIGINT) AS size FROM k WHERE (a, b) IN (SELECT (a, b) FROM y WHERE size > 35) GROUP BY a, b, c)
 SELECT a, NULL AS b, NULL AS c, size, size AS got, true AS complete FROM x WHERE size <= 35 UNION ALL SELECT a, b, NULL, size, size, true FROM y WHERE size <= 35 UNION ALL SELECT a, b, c, size, size, true FROM z""")  # fmt: skip
def _(s, d):
    plan = tables.shards(rows(s, d, SHARDS), ["a", "b", "c"], 35).drop("over")
    parts = rows(s, d, "SELECT p_type AS a, p_brand AS b, p_name AS c, p_partkey AS id FROM {part}")
    return tables.covered(parts, plan, ["a", "b", "c"], "id")


@query("event_report", f"WITH {EV} SELECT CAST(sum(weight) AS BIGINT) || ' events in ' || count(DISTINCT session) || ' sessions (sampled, up to 1 in ' || max(weight) || ')' AS line FROM ev")
def _(s, d):
    o = events.overview(rows(s, d, i.EVENTS)).first().asDict()  # one row
    line = events.report(o, []).split("\n")[0]
    return s.range(1).select(F.lit(line).alias("line"))


@query("content_gates", """SELECT name, actual, passed FROM (VALUES ('not_null_c_name', '0', true), ('rows_customer', (SELECT CAST(count(*) AS VARCHAR) FROM customer), true), ('in_set_c_mktsegment', (SELECT CAST(count(*) AS VARCHAR) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), (SELECT count(*) = 0 FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')))) v(name, actual, passed)""")
def _(s, d):
    c = table(s, d, "customer")
    g = gates.Gates("customers")
    g.not_null(c, "c_name")
    g.row_count(c, "customer", 1)
    g.in_set(c, "c_mktsegment", ["BUILDING", "MACHINERY"])
    return g.frame(s).select("name", "actual", "passed")
