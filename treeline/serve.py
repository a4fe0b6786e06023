"""The engine's tables as SQL: ``serve`` registers views and table functions.

    EXECUTE IMMEDIATE search_rows USING 'small widg' AS q, 20 AS n
    SELECT * FROM hits(array('k1', 'k2'))
    SELECT * FROM paths(array('k1', 'k2'))
    SELECT * FROM segment(0, 17)
    SELECT * FROM node_detail('k1')
    SELECT * FROM fact(7)
    SELECT * FROM timescale()
    SELECT * FROM about()

Each is one SELECT that Catalyst plans with the arguments in place.  A search, which
asks for more than a function's body may correlate, is a statement with the
parameters q and n: it finds and ranks on narrow columns, cuts, and only then joins
what is shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions
from .operators import search as found
from .operators import term_index

#: What ``serve`` reads; a caller's tables may hold more.
TABLES = {
    "nodes": "idx long, key string, name string, rank string, parent long, tips long, headline string, page string, lineage array<long>",
    "ranked": "idx long, name string, tips long, score double, has_image boolean, measured boolean, headline string",
    "names": "id long, idx long, kind long, name string, title boolean",
    "terms": term_index.SCHEMA,
    "hot": "idx long, name string, tips long",
    "broken": "key string, name string",
    "facts": "fact long, name string, attach long, walk long, is_primary boolean, penalty long, n_occs long",
    "scale": "id long, name string, rank string, parent long, begin double, end double",
}
#: Rows at most, candidates a row asked for, least letters for the index, rows of a segment.
MOST, AHEAD, LEAST_TERM, SEGMENT_ROWS = found.MOST, 8, 3, 200
_FROM, _TO = found._bases()

SCALARS = [
    ("folded", "s STRING", "STRING", f"regexp_replace(translate(lower(s), '{_FROM}', '{_TO}'), '\\\\p{{M}}', '')"),
    ("name_terms", "s STRING", "ARRAY<STRING>", "filter(split(folded(s), '[^\\\\p{L}\\\\p{N}]+'), t -> t <> '')"),
    ("asked", "q STRING", "STRING", "regexp_replace(trim(q), '\\\\s+', ' ')"),
    # Which of a query's words a term is, a bit each; the last word may be its beginning.
    ("term_mask", "t STRING, w ARRAY<STRING>", "BIGINT", "aggregate(transform(w, (x, i) -> if(t = x OR (i = size(w) - 1 AND startswith(t, x)), shiftleft(1L, i), 0L)), 0L, (m, b) -> m | b)"),
    ("spelled", "q STRING", "ARRAY<STRING>", "filter(array_distinct(array(q, upper(left(q, 1)) || substring(q, 2), upper(left(q, 1)) || lower(substring(q, 2)), lower(q))), v -> v <> '')"),
    ("page_rows", "n INT", "INT", f"least(if(n <= 0, {found.LIMIT}, n), {MOST})"),
]

_TERMS = "name_terms(:q)"
#: Candidates: by the index, exact names first, then by rank; by prefix where that is too few; by an exact common name.
CANDIDATES = f"""ids AS (SELECT id FROM served_terms WHERE exists({_TERMS}, x -> startswith(bucket, left(x, {term_index.LETTERS}))) AND term >= array_min({_TERMS}) AND term <= array_max({_TERMS}) || '\U0010ffff'
   AND term_mask(term, {_TERMS}) > 0 GROUP BY id HAVING bit_or(term_mask(term, {_TERMS})) = shiftleft(1L, size({_TERMS})) - 1),
 hit AS (SELECT n.idx, n.kind, n.id, if(lower(n.name) = lower(asked(:q)), 0, 1) AS stage FROM served_names n JOIN ids ON ids.id = n.id WHERE array_max(transform({_TERMS}, x -> length(x))) >= {LEAST_TERM}),
 first AS (SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY stage, if(stage = 0, kind, 0), id) AS k FROM hit) WHERE k <= {AHEAD} * page_rows(:n)),
 few AS (SELECT count(DISTINCT idx) < 2 * page_rows(:n) AS few FROM first),
 v AS (SELECT explode(s) AS v FROM (SELECT spelled(asked(:q)) AS s)),
 warm AS (SELECT v.v, h.idx, h.tips FROM served_hot h JOIN v ON startswith(h.name, v.v)),
 enough AS (SELECT v FROM warm GROUP BY v HAVING count(*) >= {found.PER_SPELLING}),
 cold AS (SELECT v.v, r.idx, r.tips FROM served_ranked r JOIN (SELECT v FROM v WHERE v NOT IN (SELECT v FROM enough)) v ON startswith(r.name, v.v)),
 pre AS (SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY v ORDER BY tips DESC, idx) AS k FROM (SELECT w.* FROM warm w JOIN enough e ON e.v = w.v UNION ALL SELECT * FROM cold)) WHERE k <= {found.PER_SPELLING}
   UNION SELECT r.idx FROM served_ranked r WHERE array_contains(spelled(asked(:q)), r.name)),
 cand AS (SELECT idx FROM first UNION SELECT idx FROM pre WHERE (SELECT few FROM few) UNION SELECT idx FROM served_names WHERE kind = 3 AND lower(name) = lower(asked(:q)))"""

#: Bands over all of a candidate's names; an exactness that only an alias gives is withdrawn from a lone tip, and from what a head row outweighs.
RANKING = f"""banded AS (SELECT n.idx, n.kind, n.name, n.title, match_band(n.name, asked(:q)) AS band FROM served_names n JOIN cand ON cand.idx = n.idx WHERE n.kind <> 4),
 best AS (SELECT idx, min(band) AS band, coalesce(min(band) FILTER (WHERE kind = 0), {functions.NONE}) AS own, coalesce(bool_or(title AND band = 0) FILTER (WHERE kind = 3), false) AS denotes, count_if(kind = 3) AS n_names,
   min_by(struct(name, kind), struct(band, -get(array(6, 5, 4, 1, 0, 3), CAST(kind AS INT)) AS s, name)) AS m FROM banded GROUP BY idx),
 lone AS (SELECT b.*, r.name, r.tips, r.score, r.has_image, r.measured, r.headline, b.band = 0 AND b.own <> 0 AND NOT b.denotes AS lone FROM best b JOIN served_ranked r ON r.idx = b.idx),
 step AS (SELECT *, if(lone AND n_names < 2 AND tips <= 1, {functions.HEAD}, band) AS step, lone AND NOT (n_names < 2 AND tips <= 1) AND coalesce(match_band(headline, asked(:q)), {functions.NONE}) > {functions.HEAD} AS open FROM lone),
 large AS (SELECT coalesce(max(tips) FILTER (WHERE step = {functions.HEAD}), 0) AS tips FROM step),
 final AS (SELECT s.*, if(open AND s.tips * {found.SIZE_RATIO} < large.tips, {functions.HEAD}, step) AS at FROM step s CROSS JOIN large),
 rows AS (SELECT idx, CAST(NULL AS STRING) AS key, at, if(m.kind IN (2, 5), 1, 0) AS tier, false AS broken, denotes, score, tips, has_image, measured, n_names > 0 AS named, m.name AS matched, m.kind AS kind, name FROM final
   UNION ALL SELECT NULL, key, 0, 0, true, false, 0D, 0L, false, false, false, name, 4L, name FROM (SELECT key, name FROM served_broken WHERE lower(name) = lower(asked(:q)) ORDER BY key LIMIT {found.EXPLAINED})),
 page AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY at, tier, broken, denotes DESC, score DESC, tips DESC, has_image DESC, measured DESC, named DESC, name, kind, idx, key) AS pos FROM rows) WHERE pos <= page_rows(:n))"""

#: The second catalogue's page, as ``search.second_catalogue`` makes it.
FOSSILS = f"""tiered AS (SELECT fact, name, penalty, n_occs, CASE WHEN lower(name) = lower(asked(:q)) THEN 0 WHEN startswith(lower(name), lower(asked(:q))) THEN 1 ELSE 2 END AS tier FROM served_facts
   WHERE is_primary AND walk <> 0 AND contains(lower(name), lower(asked(:q)))),
 over AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY tier, penalty, n_occs DESC, name, fact) AS k FROM tiered) WHERE k <= 4 * page_rows(:n)),
 one AS (SELECT *, match_band(name, asked(:q)) AS at FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS nth FROM over) WHERE nth = 1),
 fossil AS (SELECT * FROM (SELECT fact, name, at, row_number() OVER (ORDER BY at, k) AS pos FROM one) WHERE pos <= page_rows(:n))"""

#: Both pages in one order by band, own position (broken rows have none) and catalogue; what is shown joins last.
ANSWER = """placed AS (SELECT idx, key, at, matched, kind, broken, pos, if(broken, NULL, row_number() OVER (PARTITION BY broken ORDER BY pos)) AS own FROM page),
 slots AS (SELECT 0 AS corpus, pos, at, own FROM placed WHERE NOT broken UNION ALL SELECT 1, pos, at, pos FROM fossil),
 merged AS (SELECT corpus, pos, row_number() OVER (ORDER BY at, own, corpus) AS place FROM slots)
 SELECT m.place, p.pos, 0 AS corpus, p.at AS band, coalesce(p.key, n.key) AS key, p.idx, coalesce(n.name, p.matched) AS name, n.headline, n.rank, n.tips,
   if(lower(p.matched) = lower(n.name) OR lower(p.matched) = lower(n.headline) OR p.broken, NULL, p.matched) AS matched, CAST(NULL AS BIGINT) AS fact, CAST(NULL AS BIGINT) AS attach
  FROM placed p LEFT JOIN merged m ON m.corpus = 0 AND m.pos = p.pos LEFT JOIN served_nodes n ON n.idx = p.idx
 UNION ALL SELECT m.place, f.pos, 1, f.at, NULL, NULL, f.name, NULL, NULL, NULL, NULL, f.fact, s.attach FROM fossil f JOIN merged m ON m.corpus = 1 AND m.pos = f.pos JOIN served_facts s ON s.fact = f.fact"""

SEARCH = f"WITH {CANDIDATES}, {RANKING}, {FOSSILS}, {ANSWER}"
SELECTS = [
    ("hits", "keys ARRAY<STRING>", "pos INT, key STRING, idx BIGINT, name STRING, headline STRING, rank STRING, tips BIGINT",
     "WITH k AS (SELECT min(pos) AS pos, key FROM posexplode(keys) AS t(pos, key) GROUP BY key) SELECT k.pos, n.key, n.idx, n.name, n.headline, n.rank, n.tips FROM k JOIN served_nodes n ON n.key = k.key WHERE k.key NOT IN (SELECT key FROM served_broken WHERE key IS NOT NULL)"),
    ("paths", "keys ARRAY<STRING>", "key STRING, step INT, idx BIGINT, name STRING, rank STRING",
     "WITH k AS (SELECT n.key, posexplode(reverse(n.lineage)) AS (step, anc) FROM served_nodes n WHERE array_contains(keys, n.key)) SELECT k.key, k.step, a.idx, a.name, a.rank FROM k JOIN served_nodes a ON a.idx = k.anc"),
    ("segment", "upper BIGINT, lower BIGINT", "kind STRING, step INT, id BIGINT, name STRING, total BIGINT",
     f"""WITH t AS (SELECT idx AS low, posexplode(reverse(lineage)) AS (step, anc) FROM served_nodes),
     c AS (SELECT t.anc AS idx, t.step - u.step - 1 AS step FROM t JOIN t u ON u.low = t.low WHERE t.low = segment.lower AND u.anc = segment.upper AND t.step > u.step),
     f AS (SELECT f.*, row_number() OVER (PARTITION BY f.name ORDER BY penalty, n_occs DESC, fact) AS k FROM served_facts f JOIN c ON c.idx = f.attach),
     o AS (SELECT *, row_number() OVER (ORDER BY penalty, n_occs DESC, name, fact) AS place FROM f WHERE k = 1)
     SELECT 'node', c.step, c.idx, n.name, CAST(NULL AS BIGINT) FROM c JOIN served_nodes n ON n.idx = c.idx
     UNION ALL SELECT 'fact', o.place, o.fact, o.name, (SELECT count(DISTINCT name) FROM f) FROM o WHERE o.place <= {SEGMENT_ROWS}"""),
    ("node_detail", "asked_key STRING", "key STRING, idx BIGINT, name STRING, rank STRING, tips BIGINT, headline STRING, page STRING, parent_name STRING, synonyms STRING, aliases STRING",
     """WITH d AS (SELECT * FROM served_nodes WHERE key = asked_key),
     s AS (SELECT n.idx, array_join(array_sort(collect_set(n.name) FILTER (WHERE n.kind = 2)), '|') AS synonyms, array_join(array_sort(collect_set(n.name) FILTER (WHERE n.kind = 3)), '|') AS aliases FROM served_names n JOIN d ON d.idx = n.idx GROUP BY n.idx)
     SELECT d.key, d.idx, d.name, d.rank, d.tips, d.headline, d.page, p.name, coalesce(s.synonyms, ''), coalesce(s.aliases, '') FROM d LEFT JOIN served_nodes p ON p.idx = d.parent LEFT JOIN s ON s.idx = d.idx"""),
    ("fact", "asked_fact BIGINT", "fact BIGINT, name STRING, attach BIGINT, at_key STRING, at_name STRING, n_occs BIGINT",
     "SELECT f.fact, f.name, f.attach, n.key, n.name, f.n_occs FROM served_facts f LEFT JOIN served_nodes n ON n.idx = f.attach WHERE f.fact = asked_fact"),
    ("timescale", "", "id BIGINT, name STRING, rank STRING, parent BIGINT, begin DOUBLE, `end` DOUBLE", "SELECT id, name, rank, parent, begin, `end` FROM served_scale"),
    ("about", "", "name STRING, rows BIGINT", " UNION ALL ".join(f"SELECT '{t}', count(*) FROM served_{t}" for t in TABLES)),
]


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def serve(spark: SparkSession, **tables: DataFrame) -> None:
    """Register ``TABLES`` (those not given are empty; ``hot`` and ``ranked`` follow
    from the nodes where they aren't) and the functions above."""
    if "ranked" not in tables and "nodes" in tables and {"score", "has_image", "measured"} <= set(tables["nodes"].columns):
        tables["ranked"] = tables["nodes"]
    if "hot" not in tables and "ranked" in tables:
        tables["hot"] = term_index.hot_names(tables["ranked"])
    functions.register(spark)
    for name, columns in TABLES.items():
        empty = spark.createDataFrame([], columns)
        df = tables.get(name, empty)
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema]).createOrReplaceTempView(f"served_{name}")
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, columns, body in SELECTS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    spark.sql("DECLARE OR REPLACE VARIABLE search_rows STRING DEFAULT " + _quoted(SEARCH))


def search(spark: SparkSession, query: str, limit: int = found.LIMIT) -> tuple[DataFrame, dict[str, str]]:
    """The answer, and {'corrected': spelling} if it is another spelling's because
    the query has none, or {'suggested': spelling} if that one answers better.

    Only a weak answer (no whole word, few rows) asks for another spelling.  The two
    branches are decided on the driver from one row each.
    """
    from .operators import spelling

    ask = lambda q: spark.sql(SEARCH, args={"q": q, "n": limit})
    state = lambda df: df.agg(F.min(F.when(F.col("place").isNotNull(), F.col("band"))).alias("best"), F.count("place").alias("rows"), F.count("*").alias("all")).first()
    answer = ask(query)
    was = state(answer)
    if (was["best"] is not None and was["best"] <= functions.TOKEN) or was["rows"] > found.WEAK_ROWS:
        return answer, {}
    index = spelling.index(spark.table("served_names").where("kind <> 4").select("name"))
    fixed = spelling.correct_queries(spark.createDataFrame([(query,)], "query string"), index).first()
    if fixed is None:
        return answer, {}
    other = ask(fixed["fixed"])
    better = state(other)
    if not better["rows"] or better["best"] >= (functions.NONE if was["best"] is None else was["best"]):
        return answer, {}
    return (answer, {"suggested": fixed["fixed"]}) if was["all"] else (other, {"corrected": fixed["fixed"]})
