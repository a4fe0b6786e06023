"""Registered queries: resolution, search, spelling, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy
from ..operators import names, paths, resolve, search, serving, spelling
from . import inputs as i
from .hierarchy import INDUCED
from .inputs import DUCK_TREE, T, duck, full, rows, tree

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


PREC = f"""cd AS ({duck(i.CANDIDATES)}), pr AS (SELECT * FROM (VALUES ('manual', 1), ('ott_sourceinfo', 2), ('phylopic_resolve', 5), ('name_exact', 6)) v(method, p)),
 win AS (SELECT source, source_id, idx, method FROM (SELECT cd.*, row_number() OVER (PARTITION BY source, source_id ORDER BY p, input_pos) AS k FROM cd JOIN pr USING (method)) WHERE k = 1)"""


@query("xref_precedence", f"WITH {PREC} SELECT source, source_id, idx, method FROM win")
def _(s, d):
    return resolve.precedence(rows(s, d, i.CANDIDATES))


@query("xref_blocked", f"WITH {PREC} SELECT c.method, c.n - coalesce(w.n, 0) AS blocked FROM (SELECT method, count(*) AS n FROM cd GROUP BY method) c LEFT JOIN (SELECT method, count(*) AS n FROM win GROUP BY method) w USING (method)")
def _(s, d):
    c = rows(s, d, i.CANDIDATES)
    return resolve.blocked(c, resolve.precedence(c))


FACTS2 = "SELECT concat('', p_partkey) AS id, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_extant, concat('n', p_partkey % 90) AS name, p_partkey % 180 AS accepted_id FROM {part}"


@query("xref_refusals", f"""WITH {PREC}, f AS ({duck(FACTS2)}), lv AS (SELECT {2 * T} + n_nationkey AS idx FROM nation WHERE n_nationkey % 2 = 0), fl AS (SELECT {2 * T} + n_nationkey AS idx FROM nation WHERE n_nationkey % 8 = 0),
 a AS (SELECT w.*, f.name, f.accepted_id, coalesce(f.is_extant = false AND w.idx IN (SELECT idx FROM lv) AND w.idx NOT IN (SELECT idx FROM fl) AND w.method <> 'manual', false) AS bad FROM win w LEFT JOIN f ON f.id = w.source_id),
 b AS (SELECT *, CASE WHEN NOT bad THEN idx END AS left_idx FROM a), tw AS (SELECT name FROM b WHERE left_idx IS NOT NULL AND method = 'name_exact' GROUP BY name HAVING count(DISTINCT accepted_id) > 1),
 e AS (SELECT *, coalesce(left_idx IS NOT NULL AND method = 'name_exact' AND name IN (SELECT name FROM tw), false) AS amb FROM b)
 SELECT source, source_id, CASE WHEN NOT amb THEN left_idx END AS idx, method, bad OR amb AS refused, CASE WHEN bad THEN idx WHEN amb THEN left_idx END AS withdrawn FROM e""")  # fmt: skip
def _(s, d):
    f = rows(s, d, FACTS2)
    nodes = rows(s, d, f"SELECT {2 * T} + n_nationkey AS id, n_nationkey AS n FROM {{nation}}")
    first = resolve.refuse_extinct(resolve.precedence(rows(s, d, i.CANDIDATES)), f, nodes.where("n % 2 = 0"), nodes.where("n % 8 = 0"))
    return resolve.refuse_ambiguous(first, f)


INFO = "SELECT p_partkey AS id, concat('ncbi:', p_partkey, ', GBIF:', p_size, ',study7:1,worms:', CASE WHEN p_size % 2 = 0 THEN 'x:y' ELSE '' END, ',plain') AS sourceinfo FROM {part}"


@query("sourceinfo_explode", f"""WITH x AS (SELECT id, unnest(string_split(sourceinfo, ',')) AS item, generate_subscripts(string_split(sourceinfo, ','), 1) - 1 AS pos FROM ({duck(INFO)}))
 SELECT id, CAST(pos AS BIGINT) AS pos, lower(trim(split_part(item, ':', 1))) AS namespace, trim(substr(item, instr(item, ':') + 1)) AS value FROM x WHERE instr(item, ':') > 0 AND lower(trim(split_part(item, ':', 1))) IN ('ncbi', 'gbif', 'irmng', 'worms', 'if', 'silva') AND trim(substr(item, instr(item, ':') + 1)) <> ''""")  # fmt: skip
def _(s, d):
    return resolve.source_pairs(rows(s, d, INFO))


@query("source_counts", f"""WITH x AS (SELECT id, unnest(string_split(sourceinfo, ',')) AS item FROM ({duck(INFO)})) SELECT lower(trim(split_part(item, ':', 1))) AS namespace, count(*) AS ids, count(DISTINCT id) AS taxa FROM x
 WHERE instr(item, ':') > 0 AND lower(trim(split_part(item, ':', 1))) IN ('ncbi', 'gbif', 'irmng', 'worms', 'if', 'silva') AND trim(substr(item, instr(item, ':') + 1)) <> '' GROUP BY 1""")  # fmt: skip
def _(s, d):
    return resolve.source_pairs(rows(s, d, INFO)).groupBy("namespace").agg(F.count("*").alias("ids"), F.count_distinct("id").alias("taxa"))


CHAIN = ("SELECT o_orderkey AS a_id, o_custkey * 2 AS b_key FROM {orders}", "SELECT c_custkey * 2 AS b_key, c_nationkey % 20 AS c_key FROM {customer} WHERE c_custkey % 4 <> 0", "SELECT n_nationkey AS c_key, n_regionkey AS node FROM {nation} WHERE n_nationkey % 3 <> 0")


@query("chain_score", f"""SELECT count(*) AS asked, count(b.c_key) AS hop1, count(c.node) AS hop2, round(count(c.node) / count(*), 6) AS end_to_end FROM ({duck(CHAIN[0])}) a LEFT JOIN ({duck(CHAIN[1])}) b USING (b_key) LEFT JOIN ({duck(CHAIN[2])}) c ON c.c_key = b.c_key""")
def _(s, d):
    return resolve.chain_scores(*[rows(s, d, q) for q in CHAIN])


OFFERS = "SELECT p_name AS name, p_size AS rank, p_partkey AS key FROM {part} WHERE p_partkey % 3 <> 0"
WANTED = "SELECT p_partkey AS id, p_name AS name, p_size AS rank FROM {part} WHERE p_partkey % 2 = 0"


@query("unique_name_join", f"""WITH p AS (SELECT name, rank, count(DISTINCT key) AS n, min(key) AS only_key, array_to_string(list_sort(list(DISTINCT key))[1:32], ',') AS candidates FROM ({duck(OFFERS)}) GROUP BY ALL)
 SELECT w.id, w.name, CAST(w.rank AS BIGINT) AS rank, CASE WHEN n = 1 THEN only_key END AS key, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, candidates FROM ({duck(WANTED)}) w LEFT JOIN p USING (name, rank)""")  # fmt: skip
def _(s, d):
    out = resolve.unique_join(rows(s, d, WANTED), rows(s, d, OFFERS), ["name", "rank"], "key")
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


TRIES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey END AS k1, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 END AS k2, p_partkey * 2 AS k3 FROM {part}"


@query("first_landing", f"""WITH n AS (SELECT p_partkey AS key, p_size AS node FROM part WHERE p_partkey % 4 <> 1), a AS ({duck(TRIES)}), u AS (SELECT id, k1 AS key, 0 AS t FROM a UNION ALL SELECT id, k2, 1 FROM a UNION ALL SELECT id, k3, 2 FROM a)
 SELECT u.id, CAST(arg_min(n.node, t) AS BIGINT) AS node, CAST(min(t) AS BIGINT) AS try FROM u JOIN n USING (key) GROUP BY u.id""")  # fmt: skip
def _(s, d):
    return resolve.first_landing(rows(s, d, TRIES), ["k1", "k2", "k3"], rows(s, d, "SELECT p_partkey AS key, p_size AS node FROM {part} WHERE p_partkey % 4 <> 1"))


@query("regressions", f"""WITH {PREC}, now AS (SELECT * FROM win WHERE CAST(source_id AS BIGINT) % 5 <> 0) SELECT source, source_id FROM win WHERE idx IS NOT NULL AND source_id NOT IN (SELECT source_id FROM now WHERE idx IS NOT NULL) AND CAST(source_id AS BIGINT) % 10 <> 0""")
def _(s, d):
    was = resolve.precedence(rows(s, d, i.CANDIDATES))
    return resolve.regressions(was, was.where("CAST(source_id AS BIGINT) % 5 <> 0"), was.where("CAST(source_id AS BIGINT) % 10 = 0"))


@query("cohorts_top", "SELECT c_custkey AS id, 'top' AS cohort FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(s, d):
    return resolve.cohorts(rows(s, d, "SELECT c_custkey AS id, c_acctbal AS w FROM {customer}"), "w", "id", 25, 25).where("cohort = 'top'")


@query("coverage_weighted", "SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_custkey % 4 = 0) AS hits, round(avg(CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0.0 END), 6) AS share, round(sum(CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 100 ELSE 0 END) / sum(c_custkey % 100), 6) AS weighted FROM customer GROUP BY 1")
def _(s, d):
    return resolve.coverage(rows(s, d, "SELECT c_mktsegment AS segment, c_custkey AS id, c_custkey % 100 AS w FROM {customer}"), "segment", F.col("id") % 4 == 0, "w")


SEED_OFFERS = "SELECT c_nationkey AS node, c_custkey AS asset, 1 + c_custkey % 5 AS pass, c_custkey % 4 = 0 AS is_primary, c_custkey % 50 AS modified FROM {customer}"


@query("seed_cascade", f"SELECT CAST(node AS BIGINT) AS node, asset, pass FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pass, CASE WHEN is_primary THEN 0 ELSE 1 END, modified DESC, asset) AS k FROM ({duck(SEED_OFFERS)})) WHERE k = 1")
def _(s, d):
    return resolve.seeds(rows(s, d, SEED_OFFERS)).select("node", "asset", F.col("pass"))


@query("attach_walk", f"""WITH RECURSIVE f AS ({duck(i.PARTS)}), r AS ({duck(i.RESOLVED)}), w AS (SELECT f.id, CASE WHEN o.id IS NOT NULL THEN f.id ELSE f.accepted_id END AS cur, CAST(0 AS BIGINT) AS walk FROM f LEFT JOIN r o ON o.id = f.id
 UNION ALL SELECT w.id, f.parent_id, w.walk + 1 FROM w JOIN f ON f.id = w.cur WHERE w.cur NOT IN (SELECT id FROM r) AND f.parent_id IS NOT NULL), e AS (SELECT id, arg_max(cur, walk) AS cur, max(walk) AS walk FROM w GROUP BY id)
 SELECT e.id, coalesce(r.idx, 0) AS idx, coalesce(r.method, 0) AS method, e.walk, r.id AS via FROM e LEFT JOIN r ON r.id = e.cur""")  # fmt: skip
def _(s, d):
    return resolve.attach(rows(s, d, i.PARTS), rows(s, d, i.RESOLVED))


DONOR = "SELECT p_partkey AS id, concat('n', p_partkey % 60) AS name, CAST(floor(p_partkey / 2) AS BIGINT) * 2 AS accepted_id FROM {part}"


@query("accepted_donor", f"""WITH f AS (SELECT id, name, CASE WHEN id % 120 >= 60 THEN id - 60 ELSE id END AS accepted_id FROM ({duck(DONOR)})), r AS (SELECT id, id * 10 AS idx, id % 3 AS method FROM f WHERE id % 2 = 1)
 SELECT accepted_id, id AS donor, idx FROM (SELECT f.accepted_id, f.id, r.idx, row_number() OVER (PARTITION BY f.accepted_id ORDER BY r.method, f.id) AS k FROM f JOIN r USING (id) JOIN f a ON a.id = f.accepted_id AND a.accepted_id = a.id WHERE a.name = f.name AND f.id <> f.accepted_id) WHERE k = 1""")  # fmt: skip
def _(s, d):
    f = rows(s, d, DONOR).withColumn("accepted_id", F.when(F.col("id") % 120 >= 60, F.col("id") - 60).otherwise(F.col("id")))
    return resolve.donors(f, f.where("id % 2 = 1").select("id", (F.col("id") * 10).alias("idx"), (F.col("id") % 3).alias("method")))


@query("rank_fallback", "WITH o AS (SELECT p_size AS id, min(p_brand) AS r FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) = 1) SELECT CAST(k AS BIGINT) AS id, coalesce(CASE WHEN k % 3 = 0 THEN 'own' END, o.r) AS rank FROM range(1, 51) t(k) LEFT JOIN o ON o.id = k")
def _(s, d):
    nodes = s.range(1, 51).select("id", F.when(F.col("id") % 3 == 0, "own").alias("rank"))
    return resolve.rank_fallback(nodes, rows(s, d, "SELECT p_size AS id, p_brand AS rank FROM {part}"))


@query("homonym_agreement", f"""{DUCK_TREE}, q AS (SELECT c_nationkey AS id, {3 * T} + c_custkey AS cited FROM customer), n AS (SELECT q.id, q.cited, arg_min(c.anc, c.hops) AS anc FROM q JOIN c ON c.id = q.cited JOIN t ON t.id = c.anc JOIN nation ON n_nationkey = q.id AND n_name = t.name GROUP BY ALL)
 SELECT CAST(id AS BIGINT) AS id, min(anc) AS node FROM n GROUP BY id HAVING count(DISTINCT anc) = 1""")  # fmt: skip
def _(s, d):
    cites = rows(s, d, f"SELECT c_nationkey AS id, n_name AS name, {3 * T} + c_custkey AS cited FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey")
    return resolve.agreed(cites, tree(s, d))


@query("alias_dedupe", f"""WITH a AS ({duck(i.ALIASES)}), g AS (SELECT idx, lang, lower(name) AS folded, min(kind) AS kind, count(DISTINCT source) AS n_sources FROM a GROUP BY ALL), f AS (SELECT *, lower(name) AS folded, row_number() OVER (PARTITION BY idx, lang, lower(name) ORDER BY source_rank, kind, source_id, name) AS k FROM a)
 SELECT CAST(f.idx AS BIGINT) AS idx, f.lang, f.name, f.source, g.kind, g.n_sources FROM f JOIN g USING (idx, lang, folded) WHERE f.k = 1""")  # fmt: skip
def _(s, d):
    return resolve.dedupe(rows(s, d, i.ALIASES))


ALIAS_SOURCES = f"SELECT idx, lang, name, source_id, CASE source WHEN 'x' THEN 'wikidata' WHEN 'y' THEN 'wikidata_p225' ELSE 'list' END AS source, CASE WHEN source_id % 4 = 0 THEN 'FRANCE' WHEN source_id % 4 = 1 THEN n_name END AS sci_name FROM ({i.ALIASES}) a JOIN {{nation}} ON n_nationkey = idx"
ALIAS_NODES = "SELECT n_nationkey AS idx, CASE n_nationkey WHEN 3 THEN 'Building' WHEN 4 THEN 'machinery' ELSE n_name END AS name FROM {nation}"


@query("alias_prune", f"""WITH a AS ({duck(ALIAS_SOURCES)}), n AS ({duck(ALIAS_NODES)}) SELECT CAST(idx AS BIGINT) AS idx, lang, name, source_id FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.idx = a.idx AND lower(n.name) = lower(a.name)) AND NOT (source LIKE 'wikidata%' AND EXISTS (SELECT 1 FROM n WHERE n.name = a.name AND n.idx <> a.idx))
 AND NOT (source = 'wikidata' AND sci_name IS NOT NULL AND EXISTS (SELECT 1 FROM n WHERE n.idx = a.idx AND lower(n.name) <> lower(sci_name)))""")  # fmt: skip
def _(s, d):
    return resolve.prune_aliases(rows(s, d, ALIAS_SOURCES), rows(s, d, ALIAS_NODES)).select("idx", "lang", "name", "source_id")


@query("shortened_names", "SELECT p_partkey AS id, p_name || '|' || split_part(p_name, ' ', 1) AS tries FROM part")
def _(s, d):
    return rows(s, d, "SELECT p_partkey AS id, p_name FROM {part}").select("id", F.array_join(resolve.shortened(F.col("p_name")), "|").alias("tries"))


# ------------------------------------------------------------------ search

CORPUS = f"""nm AS ({duck(i.NAMES)}), sci AS (SELECT idx, kind, name FROM nm WHERE kind = 0), ab AS (SELECT idx, CAST(1 AS BIGINT) AS kind, name[1] || '. ' || split_part(name, ' ', 2) AS name FROM sci WHERE len(string_split(name, ' ')) = 2),
 c2 AS (SELECT idx, kind, name FROM nm WHERE kind = 2 AND lower(name) NOT IN (SELECT lower(x.name) FROM (SELECT * FROM sci UNION ALL SELECT * FROM ab) x WHERE x.idx = nm.idx)),
 c3 AS (SELECT idx, kind, name FROM nm WHERE kind = 3), cp AS (SELECT * FROM sci UNION ALL SELECT * FROM ab UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)"""


def _corpus(s, d):
    n = rows(s, d, i.NAMES)
    empty = n.limit(0).select("idx", "name")
    return i._once(s, d, "corpus", lambda: search.corpus(n.where("kind = 0").select("idx", "name"), n.where("kind = 2").select("idx", "name"), n.where("kind = 3").select("idx", "name"), empty, empty))


@query("search_corpus", f"WITH {CORPUS} SELECT idx, kind, name FROM cp")
def _(s, d):
    return _corpus(s, d)


SCORES = "sc AS (SELECT p_partkey AS idx, round(ln(1 + p_size) + CASE WHEN p_partkey % 5 = 0 THEN 0.5 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 0.25 ELSE 0 END + 0.6 * least(ln(1 + p_partkey % 12) / ln(11), 1), 6) AS score FROM part)"


def _scores(s, d):
    p = rows(s, d, "SELECT p_partkey AS idx, p_size AS tips FROM {part}")
    return p.select("idx", F.round(search.rank_score(F.col("tips"), F.col("idx") % 5 == 0, F.col("idx") % 7 == 0, F.col("idx") % 12), 6).alias("score"))


@query("rank_score", f"WITH {SCORES} SELECT idx, score FROM sc")
def _(s, d):
    return _scores(s, d)


NUM = f"{CORPUS}, {SCORES}, num AS (SELECT row_number() OVER (ORDER BY score DESC, kind, length(name), name, idx) AS id, idx, kind, name FROM cp JOIN sc USING (idx))"


def _numbered(s, d):
    return i._once(s, d, "numbered", lambda: search.numbered(_corpus(s, d), _scores(s, d)).select(F.col("id").cast("long").alias("id"), "idx", "kind", "name"))


@query("search_numbered", f"WITH {NUM} SELECT id, idx, kind, name FROM num")
def _(s, d):
    return _numbered(s, d)


@query("postings", f"WITH {NUM}, w AS (SELECT id, regexp_split_to_array(lower(name), '[^a-z0-9]+') AS a FROM num), e AS (SELECT id, unnest(list_filter(a, lambda x: x <> '')) AS term, generate_subscripts(list_filter(a, lambda x: x <> ''), 1) - 1 AS pos FROM w) SELECT term, id, CAST(pos AS BIGINT) AS pos FROM e")
def _(s, d):
    return search.postings(_numbered(s, d))


@query("search_query", f"""WITH {NUM}, h AS (SELECT num.*, CASE WHEN lower(name) = 'small ri' THEN 0 ELSE 1 END AS stage FROM num WHERE lower(name) = 'small ri' OR (regexp_matches(lower(name), '(^|[^a-z0-9])small([^a-z0-9]|$)') AND regexp_matches(lower(name), '(^|[^a-z0-9])ri'))),
 o AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY stage, CASE WHEN stage = 0 THEN kind END, id) AS k FROM h) SELECT row_number() OVER (ORDER BY stage, CASE WHEN stage = 0 THEN kind END, id) AS place, idx, kind, name FROM o WHERE k = 1 ORDER BY place LIMIT 20""")  # fmt: skip
def _(s, d):
    return search.two_stage(_numbered(s, d), search.postings(_numbered(s, d)), "small ri")


@query("search_phrase", f"WITH {NUM} SELECT id FROM num WHERE regexp_matches(lower(name), '(^|[^a-z0-9])small[^a-z0-9]+ri')")
def _(s, d):
    return search.matching(search.postings(_numbered(s, d)), "small ri", "phrase")


PLURALS = "[{w}, {w} || 's', {w} || 'es'] || CASE WHEN {w} LIKE '%y' THEN [{w}[:-2] || 'ies'] ELSE [] END"
HITS = "(list_contains(" + PLURALS.format(w="{b}") + ", {a}) OR list_contains(" + PLURALS.format(w="{a}") + ", {b}))"


@query("match_band", f"""WITH {NUM}, q AS (SELECT id, name, string_split(lower(name), ' ') AS w, unnest(['widget', 'blue', 'small rod', 'cold wid', 'large bolts', 'widgets']) AS q FROM num WHERE kind = 0), p AS (SELECT *, string_split(q, ' ') AS v FROM q),
 st AS (SELECT *, unnest(range(0, greatest(len(w) - len(v) + 1, 0))) AS s FROM p), fl AS (SELECT id, q, s, w, v, len(list_filter(range(1, len(v) + 1), lambda j: {HITS.format(a="w[s + j]", b="v[j]")})) = len(v) AS whole, len(list_filter(range(1, len(v)), lambda j: {HITS.format(a="w[s + j]", b="v[j]")})) = len(v) - 1 AND starts_with(w[s + len(v)], v[-1]) AS part FROM st),
 bd AS (SELECT id, q, min(CASE WHEN whole AND s + len(v) = len(w) THEN 1 WHEN whole THEN 2 WHEN part THEN 3 ELSE 4 END) AS b FROM fl GROUP BY ALL) SELECT p.id, p.q, CAST(CASE WHEN lower(p.name) = p.q THEN 0 ELSE coalesce(bd.b, 4) END AS BIGINT) AS band FROM p LEFT JOIN bd USING (id, q)""")  # fmt: skip
def _(s, d):
    asked = F.explode(F.array(*map(F.lit, ["widget", "blue", "small rod", "cold wid", "large bolts", "widgets"])))
    return _numbered(s, d).where("kind = 0").withColumn("q", asked).select("id", "q", search.match_band(F.col("name"), F.col("q")).cast("long").alias("band"))


def _decorated(s, d):
    bands = search.best_bands(_numbered(s, d), "small")
    p = rows(s, d, "SELECT p_partkey AS idx, p_size AS tips, p_partkey % 4 AS n_names, p_partkey % 9 = 0 AS denotes, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END AS headline_band FROM {part}")
    return search.decorate(bands, p)


@query("search_decorated", f"""WITH {NUM}, bs AS (SELECT idx, kind, name, string_split(lower(name), ' ') AS w, CASE kind WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 3 END AS strength FROM num WHERE kind <> 4),
 bb AS (SELECT *, CASE WHEN lower(name) = 'small' THEN 0 WHEN list_contains(['small', 'smalls', 'smalles'], w[-1]) THEN 1 WHEN len(list_intersect(w, ['small', 'smalls', 'smalles'])) > 0 THEN 2 WHEN len(list_filter(w, lambda x: starts_with(x, 'small'))) > 0 THEN 3 ELSE 4 END AS b FROM bs),
 be AS (SELECT idx, min(b) AS band, min(b) FILTER (kind = 0) AS own, arg_min(name, (b, -strength, name)) AS matched FROM bb WHERE b < 4 GROUP BY idx),
 de AS (SELECT be.*, p_size AS tips, p_partkey % 9 = 0 AS denotes, band = 0 AND coalesce(own, 4) <> 0 AND p_partkey % 9 <> 0 AS lone, p_partkey % 4 < 2 AND p_size <= 1 AS tiny, p_partkey % 3 <> 0 AS far FROM be JOIN part ON p_partkey = idx),
 sp AS (SELECT *, CASE WHEN lone AND tiny THEN 1 ELSE band END AS step, lone AND NOT tiny AND far AS open FROM de), lg AS (SELECT max(tips) FILTER (step = 1) AS largest FROM sp),
 fi AS (SELECT idx, CAST(CASE WHEN open AND tips * 100 < coalesce(largest, 0) THEN 1 ELSE step END AS BIGINT) AS band, matched, tips, denotes FROM sp, lg)
 SELECT idx, band, matched FROM fi JOIN sc USING (idx) ORDER BY band, denotes DESC, score DESC, tips DESC, idx % 5 = 0 DESC, idx % 7 = 0 DESC, idx % 2 = 0 DESC, matched, idx LIMIT 50""")  # fmt: skip
def _(s, d):
    out = _decorated(s, d).join(_scores(s, d), "idx").withColumns({"tier": F.lit(0), "is_broken": F.lit(False), "has_image": F.col("idx") % 5 == 0, "measured": F.col("idx") % 7 == 0, "has_alias": F.col("idx") % 2 == 0, "name": F.col("matched"), "kind": F.lit(0)})
    return out.orderBy(*search.result_order()).limit(50).select("idx", "band", "matched")


@query("interleave", "WITH a AS (SELECT n_nationkey AS key, n_regionkey % 4 AS band, row_number() OVER (ORDER BY n_regionkey % 4, n_nationkey) AS pos, 0 AS corpus FROM nation UNION ALL SELECT r_regionkey + 100, r_regionkey % 3, row_number() OVER (ORDER BY r_regionkey % 3, r_regionkey), 1 FROM region) SELECT row_number() OVER (ORDER BY band, pos, corpus) AS place, CAST(corpus AS BIGINT) AS corpus, CAST(key AS BIGINT) AS key, CAST(band AS BIGINT) AS band FROM a")
def _(s, d):
    a = rows(s, d, "SELECT n_nationkey AS key, n_regionkey % 4 AS band, row_number() OVER (ORDER BY n_regionkey % 4, n_nationkey) AS pos FROM {nation}")
    b = rows(s, d, "SELECT r_regionkey + 100 AS key, r_regionkey % 3 AS band, row_number() OVER (ORDER BY r_regionkey % 3, r_regionkey) AS pos FROM {region}")
    return search.interleave(a.select("key", "band", "pos"), b.select("key", "band", "pos"))


@query("weak_answer", "SELECT CAST(band // 10 AS BIGINT) AS answer, CAST(min(band % 10) AS BIGINT) AS best, count(*) AS rows, min(band % 10) > 2 AND count(*) <= 8 AS weak FROM (SELECT n_regionkey * 10 + CASE WHEN n_regionkey % 2 = 0 THEN 3 + n_nationkey % 2 ELSE n_nationkey % 5 END AS band FROM nation UNION ALL SELECT CAST(43 AS INTEGER) FROM supplier) GROUP BY 1")
def _(s, d):
    a = rows(s, d, "SELECT n_regionkey AS answer, CASE WHEN n_regionkey % 2 = 0 THEN 3 + n_nationkey % 2 ELSE n_nationkey % 5 END AS band FROM {nation} UNION ALL SELECT 4, 3 FROM {supplier}")
    out = [search.weak(a.where(F.col("answer") == k)).select(F.lit(k).cast("long").alias("answer"), "best", "rows", "weak") for k in range(5)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


SECOND = "SELECT p_partkey AS fact, p_name AS name, p_partkey % 3 AS walk, p_partkey % 13 AS n_occs, p_partkey % 2 = 0 AS is_primary, p_partkey % 9 AS penalty FROM {part}"


@query("second_catalogue", f"""WITH f AS (SELECT *, CASE WHEN lower(name) = 'small' THEN 0 WHEN starts_with(lower(name), 'small') THEN 1 ELSE 2 END AS tier FROM ({duck(SECOND)}) WHERE is_primary AND walk <> 0 AND contains(lower(name), 'small')), o AS (SELECT * FROM f ORDER BY tier, penalty, n_occs DESC, name, fact LIMIT 96),
 u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, penalty, n_occs DESC, fact) AS k FROM o), b AS (SELECT *, string_split(lower(name), ' ') AS w FROM u WHERE k = 1), c AS (SELECT *, CASE WHEN lower(name) = 'small' THEN 0 WHEN list_contains(['small', 'smalls', 'smalles'], w[-1]) THEN 1 WHEN len(list_intersect(w, ['small', 'smalls', 'smalles'])) > 0 THEN 2 WHEN len(list_filter(w, lambda x: starts_with(x, 'small'))) > 0 THEN 3 ELSE 4 END AS band FROM b)
 SELECT fact, name, CAST(tier AS BIGINT) AS tier, CAST(band AS BIGINT) AS band FROM c ORDER BY band, tier, penalty, n_occs DESC, name, fact LIMIT 24""")  # fmt: skip
def _(s, d):
    return search.second_catalogue(rows(s, d, SECOND), "small")


@query("hits_by_key", "WITH k AS (SELECT p_partkey AS pos, concat('k', p_partkey % 30) AS key FROM part), n AS (SELECT concat('k', n_nationkey) AS key, n_nationkey AS idx FROM nation) SELECT min(pos) AS pos, k.key, CAST(n.idx AS BIGINT) AS idx FROM k JOIN n USING (key) GROUP BY ALL")
def _(s, d):
    return search.hits(rows(s, d, "SELECT p_partkey AS pos, concat('k', p_partkey % 30) AS key FROM {part}"), rows(s, d, "SELECT concat('k', n_nationkey) AS key, n_nationkey AS idx FROM {nation}"))


@query("session_boost", "SELECT event_id, round(least(user_id % 20, 12) * 14 * pow(2, -(event_id % 90) / 21.0) + 40 * pow(2, -(event_id % 90) / 21.0), 4) AS boost FROM events")
def _(s, d):
    return rows(s, d, "SELECT event_id, user_id % 20 AS u, event_id % 90 AS days FROM {events}").select("event_id", F.round(search.boost(F.col("u"), F.col("days")), 4).alias("boost"))


LWT = "'^[^l]*l[^w]*w[^t]*t'"


#: The letters in order, none of the words holding the query whole; each letter's place follows from the one before.
@query("fuzzy_score", f"""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS h FROM part WHERE regexp_matches(lower(p_name), {LWT}) AND NOT contains(lower(p_name), 'lwt')), a AS (SELECT *, strpos(h, 'l') - 1 AS i FROM n), b AS (SELECT *, i + strpos(h[i + 2:], 'w') AS j FROM a), c AS (SELECT *, j + strpos(h[j + 2:], 't') AS k FROM b),
 p AS (SELECT *, CASE WHEN i = 0 OR h[i] IN (' ', '.', '_', '-') THEN 10 ELSE 2 END - least(i, 12) AS x, CASE WHEN j = i + 1 THEN 16 ELSE CASE WHEN h[j] IN (' ', '.', '_', '-') THEN 10 ELSE 2 END - least(j - i - 1, 12) END AS y, CASE WHEN k = j + 1 THEN CASE WHEN j = i + 1 THEN 20 ELSE 16 END ELSE CASE WHEN h[k] IN (' ', '.', '_', '-') THEN 10 ELSE 2 END - least(k - j - 1, 12) END AS z FROM c)
 SELECT id, CAST(x + y + z - length(h) // 12 AS DOUBLE) AS score, CASE WHEN j = i + 1 AND k = j + 1 THEN i || '-' || (k + 1) WHEN j = i + 1 THEN i || '-' || (j + 1) || ',' || k || '-' || (k + 1) WHEN k = j + 1 THEN i || '-' || (i + 1) || ',' || j || '-' || (k + 1) ELSE i || '-' || (i + 1) || ',' || j || '-' || (j + 1) || ',' || k || '-' || (k + 1) END AS ranges FROM p""")  # fmt: skip
def _(s, d):
    return rows(s, d, "SELECT p_partkey AS id, p_name AS name FROM {part}").withColumn("m", fuzzy(F.col("name"), F.lit("lwt"))).select("id", "m.score", "m.ranges").where("score IS NOT NULL")


@query("random_pool", "SELECT p_partkey AS idx FROM part WHERE p_name IS NOT NULL AND p_partkey % 5 = 0")
def _(s, d):
    n = rows(s, d, "SELECT p_partkey AS idx, p_name AS name FROM {part}")
    return search.random_pool(n, n.where("idx % 5 = 0"))


#: The index misses one name in seven and says that one in eleven of the others match.
@query("search_audit", f"WITH {NUM}, h AS (SELECT id, regexp_matches(lower(name), '(^|[^a-z0-9])small') AS hit FROM num), f AS (SELECT id FROM h WHERE hit AND id % 7 <> 3 OR NOT hit AND id % 11 = 4) SELECT count(*) FILTER (NOT hit AND id IN (SELECT id FROM f)) AS invented, count(*) FILTER (hit AND id NOT IN (SELECT id FROM f)) AS dropped FROM h")
def _(s, d):
    n = _numbered(s, d)
    scanned = n.where(F.lower("name").rlike("(^|[^a-z0-9])small"))
    found = search.matching(search.postings(n), "small").where("id % 7 <> 3").unionByName(n.select("id").join(scanned.select("id"), "id", "left_anti").where("id % 11 = 4"))
    return search.audit(found, scanned)


# ------------------------------------------------------------------ spelling

SPELL = "wd AS (SELECT DISTINCT p_name, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS word FROM part), ix AS (SELECT word, count(DISTINCT p_name) AS n FROM wd WHERE length(word) >= 4 GROUP BY word)"
KEYED = """list_reduce(list_prepend(x[1], list_filter(string_split(x[2:], ''), lambda y: y <> 'h' AND NOT contains('aeiouy', y))), lambda a, b: CASE WHEN a[-1] = b THEN a ELSE a || b END)"""


@query("spelling_index", f"WITH {SPELL}, p AS (SELECT word, n, replace(word, 'ph', 'f') AS x FROM ix) SELECT {KEYED} AS key, word, n FROM p")
def _(s, d):
    return spelling.index(rows(s, d, "SELECT p_name AS name FROM {part}"))


@query("phonetic_key", f"WITH w AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS w FROM part), p AS (SELECT lower(w) AS word, replace(lower(w), 'ph', 'f') AS x FROM w) SELECT DISTINCT word, {KEYED} AS key FROM p")
def _(s, d):
    w = rows(s, d, "SELECT DISTINCT p_type FROM {part}").select(F.explode(F.split("p_type", " ")).alias("w")).select(F.lower("w").alias("word")).distinct()
    return w.select("word", spelling.phonetic(F.col("word")).alias("key"))


#: Each longer word of the types with its first inner vowel replaced, and with it doubled, before a word that is known.
@query("spelling_correct", f"""WITH wd AS (SELECT DISTINCT p_type, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS word FROM part), ix AS (SELECT word, count(DISTINCT p_type) AS n, replace(word, 'ph', 'f') AS x FROM wd WHERE length(word) >= 4 GROUP BY word), ky AS (SELECT word, n, {KEYED} AS key FROM ix),
 wr AS (SELECT DISTINCT word[1] || regexp_replace(word[2:], '^([^aeiou]*)[aeiou]', '\\1y') AS bad FROM ix WHERE length(word) >= 6 UNION SELECT DISTINCT word[1] || regexp_replace(word[2:], '^([^aeiou]*)([aeiou])', '\\1\\2\\2') FROM ix WHERE length(word) >= 6),
 nw AS (SELECT bad, {KEYED} AS key FROM (SELECT bad, replace(bad, 'ph', 'f') AS x FROM wr) WHERE bad NOT IN (SELECT word FROM ix)),
 nr AS (SELECT nw.bad, ky.word, ky.n, damerau_levenshtein(replace(nw.bad, 'ph', 'f'), replace(ky.word, 'ph', 'f')) AS d FROM nw JOIN ky USING (key)),
 bs AS (SELECT bad, word FROM (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY d, n DESC, length(word), word) AS k FROM nr WHERE d <= CASE WHEN length(bad) >= 10 THEN 2 ELSE 1 END) WHERE k = 1)
 SELECT bad || ' steel' AS query, word || ' steel' AS fixed FROM bs""")  # fmt: skip
def _(s, d):
    idx = spelling.index(rows(s, d, "SELECT p_type AS name FROM {part}"))
    long_ = idx.where(F.length("word") >= 6)
    changed = lambda to: F.concat(F.substring("word", 1, 1), F.regexp_replace(F.expr("substring(word, 2)"), "^([^aeiou]*)([aeiou])", to), F.lit(" steel"))
    wrong = long_.select(changed("$1y").alias("query")).union(long_.select(changed("$1$2$2").alias("query"))).distinct()
    return spelling.correct_queries(wrong, idx)


# ------------------------------------------------------------------ names

EVIDENCE = "SELECT c_custkey AS id, c_nationkey AS idx, c_mktsegment AS name, CASE c_custkey % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'l' ELSE 'a' END AS kind, c_custkey % 6 <> 5 AS asked, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 END AS target, 1 AS own, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE 'other' END AS title, c_custkey % 8 AS n_sources, c_custkey % 3 = 0 AS stem FROM {customer}"
BAND = """ev AS (SELECT *, CASE WHEN NOT asked THEN NULL WHEN target IS NULL THEN 'none' WHEN target <> own THEN 'elsewhere' WHEN lower(title) = lower(name) THEN 'title' ELSE 'redirect' END AS found FROM (%s)),
 bd AS (SELECT *, CAST(CASE WHEN found = 'title' THEN 1 WHEN found = 'redirect' THEN 2 WHEN found = 'elsewhere' THEN CASE kind WHEN 'v' THEN 4 WHEN 'l' THEN 5 ELSE 6 END ELSE CASE kind WHEN 'v' THEN 3 WHEN 'l' THEN 4 ELSE 5 END END AS BIGINT) AS band FROM ev)""" % duck(EVIDENCE)


def _banded(s, d):
    e = rows(s, d, EVIDENCE)
    return e.withColumn("found", names.evidence(F.col("target"), F.col("own"), F.col("asked"), F.col("title"), F.col("name"))).withColumn("band", names.band(F.col("kind"), F.col("found")))


@query("name_bands", f"WITH {BAND} SELECT id, found, band FROM bd")
def _(s, d):
    return _banded(s, d).select("id", "found", "band")


RANK = f"{BAND}, fr AS (SELECT *, name || ' ' || id AS fname, stem AND max(CASE WHEN stem THEN 0 ELSE 1 END) OVER (PARTITION BY idx, band) = 1 AS stemmy FROM bd), rk AS (SELECT id, CAST(idx AS BIGINT) AS idx, fname, row_number() OVER (PARTITION BY idx ORDER BY band, stemmy, n_sources DESC, length(fname), fname) AS usage_rank FROM fr)"


def _ranked(s, d):
    return names.ranked(_banded(s, d).select("id", "idx", F.lit("en").alias("lang"), F.concat_ws(" ", "name", "id").alias("name"), "band", "stem", "n_sources"))


@query("name_rank", f"WITH {RANK} SELECT id, idx, usage_rank FROM rk")
def _(s, d):
    return _ranked(s, d).select("id", "idx", "usage_rank")


@query("headline_names", f"WITH {RANK} SELECT idx, fname AS name FROM rk WHERE usage_rank = 1")
def _(s, d):
    return names.headline(_ranked(s, d)).select("idx", "name")


@query("name_coverage", "WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.0 END AS has FROM part) SELECT round(avg(has), 6) AS plain, round(sum(has * p_size) / sum(p_size), 6) AS weighted, (SELECT round(avg(has), 6) FROM (SELECT has FROM x ORDER BY p_size DESC, p_partkey LIMIT 50)) AS largest FROM x")
def _(s, d):
    n = rows(s, d, "SELECT p_partkey AS idx, p_size AS tips FROM {part}")
    return names.coverage(n, n.where("idx % 4 = 0"), 50)


@query("name_target", "SELECT CAST(c_nationkey AS BIGINT) AS idx, arg_min('Q' || c_custkey, c_custkey) AS qid, arg_min(c_name, c_custkey) AS title FROM customer GROUP BY 1")
def _(s, d):
    return names.target(rows(s, d, "SELECT c_nationkey AS idx, concat('Q', c_custkey) AS qid, c_name AS title FROM {customer}"))


@query("display_names", "SELECT p_partkey AS id, upper(p_name[1]) || p_name[2:] AS shown, split_part(lower(p_name), ' ', len(string_split(p_name, ' '))) AS head FROM part")
def _(s, d):
    return rows(s, d, "SELECT p_partkey AS id, p_name FROM {part}").select("id", names.display(F.col("p_name")).alias("shown"), names.head_word(F.col("p_name")).alias("head"))


# ------------------------------------------------------------------ views


@query("entry_view", f"""{DUCK_TREE} SELECT m.id, m.name, m.tip_count, i.asset, a.age, CAST(CASE WHEN a.age IS NULL THEN 2 ELSE 0 END AS BIGINT) AS tier FROM m LEFT JOIN ({duck(i.SEEDS)}) i USING (id) LEFT JOIN ({duck(i.AGES)}) a USING (id)""")
def _(s, d):
    a = rows(s, d, i.AGES).withColumn("tier", F.lit(0).cast("long"))
    none = tree(s, d).select("id").limit(0)
    return serving.entry(full(s, d).select("id", "name", "tip_count"), rows(s, d, i.SEEDS), a, none, none, none).select("id", "name", "tip_count", "asset", "age", "tier")


@query("segment_notability", f"""WITH f AS (SELECT fact, name, attach, fact % 9 AS penalty, n_occs FROM ({duck(i.FACTS)}) WHERE attach % 5 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY penalty, n_occs DESC, fact) AS k FROM f)
 SELECT (SELECT count(DISTINCT name) FROM f) AS total, row_number() OVER (ORDER BY penalty, n_occs DESC, name, fact) AS n, fact, name FROM o WHERE k = 1 ORDER BY n LIMIT 200""")  # fmt: skip
def _(s, d):
    f = rows(s, d, i.FACTS).withColumn("penalty", F.col("fact") % 9)
    return serving.segment_facts(f, f.where("attach % 5 = 0").select(F.col("attach").alias("id")).distinct())


@query("about_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("region", "nation", "customer", "part", "orders")))
def _(s, d):
    from ..runtime import table

    return serving.about({t: table(s, d, t) for t in ("region", "nation", "customer", "part", "orders")})


@query("focus_path", f"{INDUCED} SELECT ind.id, ind.id NOT IN (SELECT anc FROM c WHERE id = {3 * T + 5}) AS dimmed FROM ind")
def _(s, d):
    shown = paths.induced_subtree(tree(s, d), rows(s, d, i.CHOSEN))
    return serving.focus(shown, tree(s, d), 3 * T + 5)


@query("view_state", "SELECT event_id, array_to_string(list_distinct_ordered, ',') AS keys FROM (SELECT event_id, CASE WHEN event_id % 3 = event_id % 5 THEN ['k' || event_id % 3] ELSE ['k' || event_id % 3, 'k' || event_id % 5] END AS list_distinct_ordered FROM events)")
def _(s, d):
    e = rows(s, d, "SELECT event_id, concat('http://x.example/v?keys=K', event_id % 3, ',k', event_id % 5, ',,&axis=linear') AS url FROM {events}")
    return e.select("event_id", F.array_join(serving.view_state(F.col("url")), ",").alias("keys"))


@query("suggestions", "SELECT CAST(0 AS BIGINT) AS band, CAST(n_nationkey AS BIGINT) AS pos, n_name AS key FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 1, n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def _(s, d):
    n = rows(s, d, "SELECT n_nationkey AS pos, n_name AS key FROM {nation}")
    return serving.suggestions(n.where("pos < 5"), n)


@query("recents", "SELECT key, row_number() OVER (ORDER BY ts DESC, key) AS pos FROM (SELECT event_type AS key, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY 1) ORDER BY pos LIMIT 6")
def _(s, d):
    return serving.recents(rows(s, d, "SELECT event_type AS key, ts, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'c' END AS build FROM {events}"), "b")


@query("enqueue_new", "SELECT min(event_id) AS pos, concat('k', event_id % 40) AS key FROM events WHERE event_id % 40 NOT IN (1, 2, 3) GROUP BY 2")
def _(s, d):
    w = rows(s, d, "SELECT event_id AS pos, concat('k', event_id % 40) AS key FROM {events}")
    return serving.enqueue(w, w.where("key IN ('k1', 'k2')"), w.where("key = 'k3'"))
