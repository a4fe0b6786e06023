"""Queries of the SQL functions (``serve``), the term index and the hot names, over the part table.

Nodes are the parts, part i under part floor(i / 4); facts are parts too, attached to others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import serve
from ..operators import search, term_index
from ..operators import tree as trees
from . import inputs as i
from .entities import HITS, NUM, SECOND, _numbered, _scores
from .further import NODES
from .inputs import duck, rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


SHOWN = "SELECT p_partkey AS idx, concat('k', p_partkey) AS key, p_name AS name, p_type AS rank, CASE WHEN p_partkey >= 4 THEN CAST(floor(p_partkey / 4) AS BIGINT) END AS parent, p_size AS tips, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS headline, concat('Q', p_partkey % 1000) AS page, p_partkey % 5 = 0 AS has_image, p_partkey % 7 = 0 AS measured FROM {part}"
ATTACHED = f"SELECT f.*, fact % 97 + 1 AS attach FROM ({SECOND}) f"
BROKEN = "SELECT concat('b', s_suppkey) AS key, CASE WHEN s_suppkey % 50 = 1 THEN 'Small Wid' ELSE s_name END AS name FROM {supplier}"
SCALE = f"SELECT id, concat(rank, ' ', id) AS name, rank, parent, begin, \"end\" FROM ({i.SCALE}) z"


def _index(s, d):
    return term_index.load(s, i._once_path(s, d, "terms", lambda path: term_index.save(_numbered(s, d), path)))


def _served(s, d):
    nodes = i._once(s, d, "served", lambda: _with_lineage(rows(s, d, SHOWN)).join(_scores(s, d), "idx"))
    names = _numbered(s, d).withColumn("title", F.col("idx") % 9 == 0)
    hot = i._once(s, d, "hot", lambda: term_index.hot_names(nodes))
    serve.serve(s, nodes=nodes, names=names, terms=_index(s, d), hot=hot, facts=rows(s, d, ATTACHED), broken=rows(s, d, BROKEN), scale=rows(s, d, SCALE))


def _with_lineage(nodes):
    return trees.lineages(nodes.withColumnRenamed("idx", "id")).withColumnRenamed("id", "idx")


def band(name: str) -> str:
    """DuckDB: the band of a name of words and spaces for 'small wid'."""
    w = f"string_split(lower({name}), ' ')"
    whole, last = HITS.format(a=f"{w}[s]", b="'small'"), HITS.format(a=f"{w}[s + 1]", b="'wid'")
    each = f"CASE WHEN {whole} AND {last} THEN CASE WHEN s + 1 = len({w}) THEN 1 ELSE 2 END WHEN {whole} AND starts_with({w}[s + 1], 'wid') THEN 3 ELSE 4 END"
    return f"CASE WHEN lower({name}) = 'small wid' THEN 0 ELSE coalesce(list_min(list_transform(range(1, len({w})), lambda s: {each})), 4) END"


ORDER = "lvl, tier, broken, denotes DESC, score DESC, tips DESC, has_image DESC, measured DESC, named DESC, name, kind, idx, key"


@query("search_answer", f"""WITH {NUM}, nd AS ({duck(SHOWN)}), fa AS ({duck(ATTACHED)}), br AS ({duck(BROKEN)}),
 hit AS (SELECT * FROM num WHERE regexp_matches(lower(name), '(^|[^a-z0-9])small([^a-z0-9]|$)') AND regexp_matches(lower(name), '(^|[^a-z0-9])wid')),
 fst AS (SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY CASE WHEN lower(name) = 'small wid' THEN 0 ELSE 1 END, CASE WHEN lower(name) = 'small wid' THEN kind ELSE 0 END, id) AS k FROM hit) WHERE k <= 160),
 pre AS (SELECT idx FROM (SELECT nd.idx, row_number() OVER (PARTITION BY v ORDER BY tips DESC, nd.idx) AS k FROM nd, (SELECT unnest(['small wid', 'Small wid']) AS v) WHERE starts_with(name, v)) WHERE k <= 128 UNION SELECT idx FROM nd WHERE name IN ('small wid', 'Small wid')),
 cand AS (SELECT idx FROM fst UNION SELECT idx FROM pre WHERE (SELECT count(DISTINCT idx) < 40 FROM fst) UNION SELECT idx FROM num WHERE kind = 3 AND lower(name) = 'small wid'),
 bnd AS (SELECT num.idx, kind, name, num.idx % 9 = 0 AS title, {band("name")} AS band FROM num JOIN cand USING (idx)),
 bst AS (SELECT idx, min(band) AS band, coalesce(min(band) FILTER (kind = 0), 4) AS own, coalesce(bool_or(title AND band = 0) FILTER (kind = 3), false) AS denotes, count(*) FILTER (kind = 3) AS n_names,
  arg_min({{'name': name, 'kind': kind}}, (band, CASE kind WHEN 0 THEN -6 WHEN 1 THEN -5 WHEN 2 THEN -4 WHEN 3 THEN -1 ELSE 0 END, name)) AS m FROM bnd GROUP BY idx),
 lo AS (SELECT bst.*, nd.name, nd.tips, sc.score, has_image, measured, nd.headline, band = 0 AND own <> 0 AND NOT denotes AS lone FROM bst JOIN nd USING (idx) JOIN sc USING (idx)),
 st AS (SELECT *, CASE WHEN lone AND n_names < 2 AND tips <= 1 THEN 1 ELSE band END AS step, lone AND NOT (n_names < 2 AND tips <= 1) AS open FROM lo),
 la AS (SELECT coalesce(max(tips) FILTER (step = 1), 0) AS largest FROM st),
 rw AS (SELECT idx, CAST(NULL AS VARCHAR) AS key, CASE WHEN open AND tips * 100 < largest THEN 1 ELSE step END AS lvl, CASE WHEN m.kind IN (2, 5) THEN 1 ELSE 0 END AS tier, false AS broken, denotes, score, tips, has_image, measured, n_names > 0 AS named, m.name AS matched, m.kind AS kind, name FROM st, la
  UNION ALL SELECT NULL, key, 0, 0, true, false, 0, 0, false, false, false, name, 4, name FROM (SELECT * FROM br WHERE lower(name) = 'small wid' ORDER BY key LIMIT 2)),
 pg AS (SELECT *, row_number() OVER (ORDER BY {ORDER.replace("idx, key", "idx NULLS FIRST, key")}) AS pos FROM rw QUALIFY pos <= 20),
 ti AS (SELECT *, CASE WHEN lower(name) = 'small wid' THEN 0 WHEN starts_with(lower(name), 'small wid') THEN 1 ELSE 2 END AS tier FROM fa WHERE is_primary AND walk <> 0 AND contains(lower(name), 'small wid')),
 ov AS (SELECT *, row_number() OVER (ORDER BY tier, penalty, n_occs DESC, name, fact) AS k FROM ti QUALIFY k <= 80),
 oe AS (SELECT *, {band("name")} AS lvl FROM ov QUALIFY row_number() OVER (PARTITION BY name ORDER BY k) = 1),
 fo AS (SELECT *, row_number() OVER (ORDER BY lvl, k) AS pos FROM oe QUALIFY pos <= 20),
 pl AS (SELECT *, CASE WHEN NOT broken THEN row_number() OVER (PARTITION BY broken ORDER BY pos) END AS own FROM pg),
 mg AS (SELECT corpus, pos, row_number() OVER (ORDER BY lvl, own, corpus) AS place FROM (SELECT 0 AS corpus, pos, lvl, own FROM pl WHERE NOT broken UNION ALL SELECT 1, pos, lvl, pos FROM fo))
 SELECT place, CAST(pl.pos AS INT) AS pos, 0 AS corpus, lvl AS band, coalesce(pl.key, nd.key) AS key, pl.idx AS idx, coalesce(nd.name, matched) AS name, nd.headline AS headline, nd.rank AS rank, nd.tips AS tips,
  CASE WHEN coalesce(lower(matched) = lower(nd.name), false) OR coalesce(lower(matched) = lower(nd.headline), false) OR broken THEN NULL ELSE matched END AS matched, CAST(NULL AS BIGINT) AS fact, CAST(NULL AS BIGINT) AS attach FROM pl LEFT JOIN mg ON mg.corpus = 0 AND mg.pos = pl.pos LEFT JOIN nd ON nd.idx = pl.idx
 UNION ALL SELECT place, fo.pos, 1, lvl, NULL, NULL, fo.name, NULL, NULL, NULL, NULL, fo.fact, fo.attach FROM fo JOIN mg ON mg.corpus = 1 AND mg.pos = fo.pos""")  # fmt: skip
def _(s, d):
    _served(s, d)
    return s.sql("EXECUTE IMMEDIATE search_rows USING 'small  wid' AS q, 20 AS n").withColumns({c: F.col(c).cast("long") for c in ("place", "band")})


KEYS = "array('k77', 'k5', 'k1500', 'k5', 'none', 'b51')"


@query("served_hits", f"WITH k AS (SELECT min(p) AS pos, key FROM (SELECT unnest(['k77', 'k5', 'k1500', 'k5', 'none', 'b51']) AS key, unnest(range(6)) AS p) GROUP BY key) SELECT CAST(pos AS INT) AS pos, key, idx, name, headline, rank, tips FROM k JOIN ({duck(SHOWN)}) n USING (key)")
def _(s, d):
    _served(s, d)
    return s.sql(f"SELECT * FROM hits({KEYS})")


@query("served_paths", f"""WITH RECURSIVE n AS ({duck(SHOWN)}), w AS (SELECT key, idx, parent, 0 AS up FROM n WHERE key IN ('k77', 'k5', 'k1500') UNION ALL SELECT w.key, n.idx, n.parent, w.up + 1 FROM w JOIN n ON n.idx = w.parent)
 SELECT w.key, CAST(max(w.up) OVER (PARTITION BY w.key) - w.up AS INT) AS step, w.idx, n.name, n.rank FROM w JOIN n ON n.idx = w.idx""")  # fmt: skip
def _(s, d):
    _served(s, d)
    return s.sql(f"SELECT * FROM paths({KEYS})")


@query("served_segment", f"""WITH n AS ({duck(SHOWN)}), f AS ({duck(ATTACHED)}), c AS (SELECT k AS idx, pos - 1 AS step FROM (SELECT unnest([4, 18, 74]) AS k, unnest([1, 2, 3]) AS pos)), a AS (SELECT f.* FROM f JOIN c ON c.idx = f.attach),
 o AS (SELECT *, row_number() OVER (ORDER BY penalty, n_occs DESC, name, fact) AS place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY penalty, n_occs DESC, fact) AS k FROM a) WHERE k = 1)
 SELECT 'node' AS kind, CAST(step AS BIGINT) AS step, CAST(c.idx AS BIGINT) AS id, n.name, CAST(NULL AS BIGINT) AS total FROM c JOIN n USING (idx) UNION ALL SELECT 'fact', place, fact, name, (SELECT count(DISTINCT name) FROM a) FROM o WHERE place <= 200""")  # fmt: skip
def _(s, d):
    _served(s, d)
    return s.sql("SELECT kind, CAST(step AS BIGINT) AS step, id, name, total FROM segment(1, 74)")


@query("served_node_detail", f"""WITH {NUM}, n AS ({duck(SHOWN)}) SELECT n.key, n.idx, n.name, n.rank, n.tips, n.headline, n.page, p.name AS parent_name, coalesce((SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM num WHERE idx = 77 AND kind = 2), '') AS synonyms,
 coalesce((SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM num WHERE idx = 77 AND kind = 3), '') AS aliases FROM n LEFT JOIN n p ON p.idx = n.parent WHERE n.key = 'k77'""")  # fmt: skip
def _(s, d):
    _served(s, d)
    return s.sql("SELECT * FROM node_detail('k77')")


@query("served_fact", f"SELECT f.fact, f.name, f.attach, n.key AS at_key, n.name AS at_name, f.n_occs FROM ({duck(ATTACHED)}) f LEFT JOIN ({duck(SHOWN)}) n ON n.idx = f.attach WHERE f.fact = 120")
def _(s, d):
    _served(s, d)
    return s.sql("SELECT * FROM fact(120)")


@query("served_timescale", f"SELECT id, name, rank, parent, begin, \"end\" FROM ({duck(SCALE)})")
def _(s, d):
    serve.serve(s, scale=rows(s, d, SCALE))  # the one table that it reads
    return s.sql("SELECT * FROM timescale()")


@query("served_about", f"""WITH {NUM} SELECT 'nodes' AS name, count(*) AS rows FROM part UNION ALL SELECT 'ranked', count(*) FROM part UNION ALL SELECT 'names', count(*) FROM num UNION ALL SELECT 'terms', sum(len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''))) FROM num
 UNION ALL SELECT 'hot', least(count(*), 50000) FROM part UNION ALL SELECT 'broken', count(*) FROM supplier UNION ALL SELECT 'facts', count(*) FROM part UNION ALL SELECT 'scale', count(*) FROM ({duck(SCALE)})""")  # fmt: skip
def _(s, d):
    _served(s, d)
    return s.sql("SELECT * FROM about()")


@query("index_query", f"WITH {NUM} SELECT id FROM num WHERE regexp_matches(lower(name), '(^|[^a-z0-9])small([^a-z0-9]|$)') AND regexp_matches(lower(name), '(^|[^a-z0-9])wi')")
def _(s, d):
    return search.matching(term_index.pruned(_index(s, d), "small wi"), "small wi")


@query("index_phrase", f"WITH {NUM} SELECT id FROM num WHERE regexp_matches(lower(name), '(^|[^a-z0-9])small[^a-z0-9]+w')")
def _(s, d):
    return search.matching(term_index.pruned(_index(s, d), "small w"), "small w", "phrase")


@query("hot_prefix", f"""WITH n AS ({duck(NODES)}), v AS (SELECT unnest(['s', 'S']) AS v) SELECT DISTINCT idx FROM (SELECT n.idx, row_number() OVER (PARTITION BY v.v ORDER BY tips DESC, n.idx) AS k FROM n, v WHERE starts_with(n.name, v.v)) WHERE k <= 20 UNION SELECT idx FROM n WHERE name IN ('s', 'S')""")
def _(s, d):
    nodes = rows(s, d, NODES)
    return term_index.prefix_hot(i._once(s, d, "hot_parts", lambda: term_index.hot_names(nodes, 500)), nodes, "s", 20)[0]
