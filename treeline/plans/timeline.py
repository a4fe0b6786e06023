"""Registered queries: time scales, events, settled input, gates, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import events, gates, timescale
from ..operators import tree as trees
from ..runtime import shared_dir
from ..sources import newick, turtle
from ..streaming import ingest, settle
from . import inputs as i
from .inputs import DUCK_TREE, duck, full, rows, tree

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _scale(s, d):
    return i._once(s, d, "scale", lambda: rows(s, d, i.SCALE).withColumn("name", F.concat("rank", F.lit(" "), F.col("id").cast("string"))))


SCALE = f"sc AS (SELECT CAST(id AS BIGINT) AS id, CAST(parent AS BIGINT) AS parent, rank, begin, \"end\", rank || ' ' || id AS name FROM ({duck(i.SCALE)}))"


@query("timescale_tree", f"WITH {SCALE} SELECT id, parent, rank, begin, \"end\", CAST(CASE rank WHEN 'year' THEN 0 WHEN 'quarter' THEN 1 ELSE 2 END AS BIGINT) AS depth, row_number() OVER (ORDER BY CASE rank WHEN 'year' THEN 0 WHEN 'quarter' THEN 1 ELSE 2 END, begin DESC, id) AS place FROM sc")
def _(s, d):
    return timescale.intervals(_scale(s, d), ["year", "quarter", "month"]).drop("name")


@query("timescale_containment", f"WITH {SCALE}, m AS (SELECT id, parent, CASE WHEN id % 5 = 0 THEN begin + 2 ELSE begin END AS begin, CASE WHEN id % 7 = 0 THEN \"end\" - 2 ELSE \"end\" END AS \"end\" FROM sc) SELECT m.id, m.parent FROM m JOIN m p ON p.id = m.parent WHERE m.begin > p.begin OR m.\"end\" < p.\"end\"")
def _(s, d):
    moved = _scale(s, d).withColumn("begin", F.col("begin") + F.when(F.col("id") % 5 == 0, 2).otherwise(0)).withColumn("end", F.col("end") - F.when(F.col("id") % 7 == 0, 2).otherwise(0))
    return timescale.containment(moved)


POINTS = "SELECT p_partkey AS id, CAST(p_partkey % 97 AS DOUBLE) + 0.5 AS x FROM {part}"


@query("interval_join", f"WITH {SCALE} SELECT p.id, sc.id AS interval FROM ({duck(POINTS)}) p JOIN sc ON sc.begin >= p.x AND p.x > sc.\"end\"")
def _(s, d):
    return timescale.interval_join(rows(s, d, POINTS), _scale(s, d).withColumnRenamed("id", "interval"), "x", 3.0).select("id", "interval")


@query("symlog_axis", "SELECT p_partkey AS id, round(CASE WHEN p_size / 4.0 <= 1 THEN p_size / 4.0 * 0.07 ELSE 0.07 + log10(p_size / 4.0) / log10(4567.0) * 0.93 END, 6) AS x FROM part")
def _(s, d):
    age = F.col("p_size") / 4.0
    return rows(s, d, "SELECT p_partkey AS id, p_size FROM {part}").select("id", F.round(timescale.symlog(age, 4567.0), 6).alias("x"))


@query("symlog_roundtrip", "SELECT p_partkey AS id, round(p_size / 4.0, 4) AS age FROM part")
def _(s, d):
    x = timescale.symlog(F.col("p_size") / 4.0, 4567.0)
    return rows(s, d, "SELECT p_partkey AS id, p_size FROM {part}").select("id", F.round(timescale.symlog_inverse(x, 4567.0), 4).alias("age"))


COLOURS = "SELECT p_partkey AS id, p_partkey % 16 AS parent, concat('#', lower(lpad(hex(p_partkey * 7919 % 16777216), 6, '0'))) AS colour FROM {part}"
LIN = "CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END"
OK_SQL = f"""ch AS (SELECT id, parent, CAST('0x' || colour[2:3] AS INTEGER) / 255.0 AS r0, CAST('0x' || colour[4:5] AS INTEGER) / 255.0 AS g0, CAST('0x' || colour[6:7] AS INTEGER) / 255.0 AS b0 FROM (SELECT p_partkey AS id, p_partkey % 16 AS parent, '#' || lower(lpad(hex(p_partkey * 7919 % 16777216), 6, '0')) AS colour FROM part)),
 li AS (SELECT id, parent, {LIN.format(v="r0")} AS r, {LIN.format(v="g0")} AS g, {LIN.format(v="b0")} AS b FROM ch),
 lm AS (SELECT id, parent, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS x, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS y, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS z FROM li),
 ok AS (SELECT id, parent, 0.2104542553 * x + 0.7936177850 * y - 0.0040720468 * z AS l, 1.9779984951 * x - 2.4285922050 * y + 0.4505937099 * z AS a, 0.0259040371 * x + 0.7827717662 * y - 0.8086757660 * z AS b FROM lm)"""


def _lab(s, d):
    c = rows(s, d, COLOURS)
    return c.select("id", "parent", *[x.alias(n) for n, x in zip("lab", timescale.oklab(F.col("colour")), strict=True)])


@query("oklab", f"WITH {OK_SQL} SELECT id, round(l, 5) + 0.0 AS l, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b FROM ok")
def _(s, d):
    return _lab(s, d).select("id", *[(F.round(c, 5) + 0.0).alias(c) for c in "lab"])


@query("oklab_dim", f"WITH {OK_SQL} SELECT id, round(least(greatest(0.32 + (l - 0.72) * 0.22, 0.24), 0.40), 5) AS l, round(least(sqrt(a * a + b * b), 0.060), 5) AS chroma FROM ok")
def _(s, d):
    dim = timescale.dim([F.col(c) for c in "lab"])
    return _lab(s, d).select("id", F.round(dim[0], 5).alias("l"), F.round(F.hypot(dim[1], dim[2]), 5).alias("chroma"))


#: All parts.  Rounded once, to the operator's digits.
@query("sibling_colours", f"WITH {OK_SQL} SELECT p.parent, round(min(sqrt((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))), 6) AS least FROM ok p JOIN ok q ON p.parent = q.parent AND p.id < q.id GROUP BY p.parent")
def _(s, d):
    return timescale.sibling_distance(_lab(s, d))


SRGB = "printf('%02x', CAST(round(255 * CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE pow({v}, 1 / 2.4) * 1.055 - 0.055 END) AS INTEGER))"


@query("dimmed_colours", f"""WITH {OK_SQL}, d AS (SELECT id, least(greatest(0.32 + (l - 0.72) * 0.22, 0.24), 0.40) AS l, a, b, sqrt(a * a + b * b) AS c FROM ok),
 e AS (SELECT id, l, CASE WHEN c > 0 THEN a * least(c, 0.06) / c ELSE 0 END AS a, CASE WHEN c > 0 THEN b * least(c, 0.06) / c ELSE 0 END AS b FROM d),
 m AS (SELECT id, pow(l + 0.3963377774 * a + 0.2158037573 * b, 3) AS x, pow(l - 0.1055613458 * a - 0.0638541728 * b, 3) AS y, pow(l - 0.0894841775 * a - 1.2914855480 * b, 3) AS z FROM e),
 g AS (SELECT id, least(greatest(4.0767416621 * x - 3.3077115913 * y + 0.2309699292 * z, 0), 1) AS r, least(greatest(-1.2684380046 * x + 2.6097574011 * y - 0.3413193965 * z, 0), 1) AS g, least(greatest(-0.0041960863 * x - 0.7034186147 * y + 1.7076147010 * z, 0), 1) AS b FROM m)
 SELECT id, '#' || {SRGB.format(v="r")} || {SRGB.format(v="g")} || {SRGB.format(v="b")} AS colour FROM g""")  # fmt: skip
def _(s, d):
    return _lab(s, d).select("id", timescale.hexadecimal(timescale.dim([F.col(c) for c in "lab"])).alias("colour"))


@query("tiling", f"""WITH {SCALE}, w AS (SELECT *, (id % 7) * 40.0 + 20 AS px FROM sc), k AS (SELECT parent AS id, avg(CASE WHEN px >= greatest(46.0, length(name) * 7.3 + 10) THEN 1.0 ELSE 0.0 END) AS share FROM w WHERE parent IS NOT NULL GROUP BY parent),
 sp AS (SELECT w.id, w.parent, coalesce(k.share >= 0.7, false) AS split FROM w LEFT JOIN k USING (id))
 SELECT a.id FROM sp a LEFT JOIN sp b ON b.id = a.parent LEFT JOIN sp c ON c.id = b.parent WHERE NOT a.split AND coalesce(b.split, true) AND coalesce(c.split, true)""")  # fmt: skip
def _(s, d):
    t = trees.lineages(_scale(s, d)).withColumn("px", (F.col("id") % 7) * 40.0 + 20)
    return timescale.tiling(t)


@query("age_figures", "SELECT id, CASE WHEN a < 0.05 THEN 'present' WHEN a >= 10 THEN printf('%.0f', round(a)) ELSE printf('%.1f', round(a, 1)) END AS shown FROM (SELECT p_partkey AS id, p_partkey % 33 * p_partkey % 9 / 4.0 + CASE WHEN p_partkey % 3 = 0 THEN 0.13 ELSE 0 END AS a FROM part)")
def _(s, d):
    p = rows(s, d, "SELECT p_partkey AS id, CAST(p_partkey % 33 * p_partkey % 9 / 4.0 + CASE WHEN p_partkey % 3 = 0 THEN 0.13 ELSE 0 END AS DOUBLE) AS a FROM {part}")
    return p.select("id", timescale.figure(F.col("a")).alias("shown"))


# ------------------------------------------------------------------ events

EV = f"ev AS ({duck(i.EVENTS)})"


@query("events_overview", f"WITH {EV} SELECT CAST(sum(weight) AS BIGINT) AS weighted, count(*) AS raw, CAST(max(weight) AS BIGINT) AS worst, count(DISTINCT session) AS sessions, min(ts) AS first, max(ts) AS last FROM ev")
def _(s, d):
    return events.overview(rows(s, d, i.EVENTS))


@query("top_subjects", f"WITH {EV} SELECT subject, CAST(sum(weight) AS BIGINT) AS weighted, count(DISTINCT session) AS sessions FROM ev WHERE kind = 'search' GROUP BY subject ORDER BY weighted DESC, subject LIMIT 10")
def _(s, d):
    return events.top_subjects(rows(s, d, i.EVENTS), "search", 10)


@query("trees_made", f"WITH {EV} SELECT tree, CAST(len(string_split(tree, ',')) AS BIGINT) AS size, CAST(sum(weight) AS BIGINT) AS weighted FROM ev WHERE kind = 'tree' AND cause IN ('add', 'remove') GROUP BY ALL")
def _(s, d):
    return events.tree_sets(rows(s, d, i.EVENTS), True)


@query("trees_received", f"WITH {EV} SELECT tree, CAST(len(string_split(tree, ',')) AS BIGINT) AS size, cause, CAST(sum(weight) AS BIGINT) AS weighted FROM ev WHERE kind = 'tree' AND cause NOT IN ('add', 'remove') GROUP BY ALL")
def _(s, d):
    return events.tree_sets(rows(s, d, i.EVENTS), False)


@query("daily_pivot", f"WITH {EV} SELECT CAST(ts AS DATE) AS day, CAST(sum(CASE WHEN kind = 'add' THEN weight ELSE 0 END) AS BIGINT) AS \"add\", CAST(sum(CASE WHEN kind = 'search' THEN weight ELSE 0 END) AS BIGINT) AS search, CAST(sum(CASE WHEN kind = 'tree' THEN weight ELSE 0 END) AS BIGINT) AS tree, count(DISTINCT session) AS sessions FROM ev GROUP BY 1")
def _(s, d):
    return events.daily(rows(s, d, i.EVENTS), ["add", "search", "tree"])


@query("labelled_subjects", f"WITH {EV}, n AS ({duck(i.KEYS)}) SELECT e.subject, e.weighted, coalesce(n.name, e.subject) AS label FROM (SELECT subject, CAST(sum(weight) AS BIGINT) AS weighted FROM ev WHERE kind = 'add' GROUP BY subject) e LEFT JOIN n ON n.key = e.subject")
def _(s, d):
    top = events.top_subjects(rows(s, d, i.EVENTS), "add", 1000).drop("sessions")
    return events.labelled(top, rows(s, d, i.KEYS))


@query("labelled_trees", f"WITH {EV}, n AS ({duck(i.KEYS)}), x AS (SELECT tree, unnest(string_split(tree, ',')) AS key, generate_subscripts(string_split(tree, ','), 1) AS pos FROM (SELECT DISTINCT tree FROM ev)) SELECT tree, string_agg(coalesce(n.name, x.key), ' + ' ORDER BY pos) AS label FROM x LEFT JOIN n USING (key) GROUP BY tree")
def _(s, d):
    return events.tree_labels(rows(s, d, i.EVENTS), rows(s, d, i.KEYS))


@query("retention_window", f"WITH {EV} SELECT count(*) AS n FROM ev WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY")
def _(s, d):
    return events.retained(rows(s, d, i.EVENTS), "2024-01-30 00:00:00", 10).agg(F.count("*").alias("n"))


@query("settled_trees", f"""WITH {EV}, k AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(tree, ','))), ',') AS key, lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS nxt FROM ev WHERE len(list_distinct(string_split(tree, ','))) > 1),
 l AS (SELECT *, lag(key) OVER (PARTITION BY session ORDER BY ts, event_id) AS before FROM k WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) > 3600000000) SELECT session, ts, key, cause FROM l WHERE before IS NULL OR before <> key""")  # fmt: skip
def _(s, d):
    return settle.settled_trees(rows(s, d, i.EVENTS), 3600.0)


@query("settled_queries", f"""WITH RECURSIVE {EV}, o AS (SELECT session, ts, trim(subject) AS q, row_number() OVER (PARTITION BY session ORDER BY ts, subject) AS n FROM ev WHERE length(trim(subject)) >= 2),
 r AS (SELECT session, n, q AS standing, ts AS heard, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS TIMESTAMP) AS done_at FROM o WHERE n = 1 UNION ALL
 SELECT session, n, CASE WHEN fresh THEN q WHEN length(q) >= length(standing) THEN q ELSE standing END, ts, CASE WHEN fresh THEN standing END, CASE WHEN fresh THEN heard END FROM (
 SELECT o.session, o.n, o.q, o.ts, r.standing, r.heard, epoch_us(o.ts) - epoch_us(r.heard) > 3600000000 OR NOT (starts_with(o.q, r.standing) OR starts_with(r.standing, o.q)) AS fresh FROM r JOIN o ON o.session = r.session AND o.n = r.n + 1)),
 e AS (SELECT session, n, done_at AS ts, done AS query FROM r WHERE done IS NOT NULL UNION ALL SELECT session, n + 1, heard, standing FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC) AS k FROM r) WHERE k = 1)
 SELECT session, ts, query FROM (SELECT *, lag(query) OVER (PARTITION BY session ORDER BY n) AS before FROM e) WHERE before IS NULL OR before <> query""")  # fmt: skip
def _(s, d):
    return settle.settled_queries(rows(s, d, i.EVENTS), 3600.0)


@query("last_cause", f"WITH {EV} SELECT event_id, last_value(CASE WHEN event_id % 3 <> 2 THEN cause END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cause FROM ev")
def _(s, d):
    e = rows(s, d, i.EVENTS).withColumn("cause", F.when(F.col("event_id") % 3 != 2, F.col("cause")))
    return ingest.last_cause(e).select("event_id", "cause")


@query("ingest_validation", f"WITH {EV} SELECT CAST(session AS VARCHAR) AS session, kind, subject, CAST(len(string_split(tree, ',')) AS BIGINT) AS size FROM ev WHERE event_id % 7 <> 3")
def _(s, d):
    e = rows(s, d, i.EVENTS)
    kind = F.when(F.col("event_id") % 7 == 3, "junk").otherwise(F.col("kind"))
    body = F.to_json(F.struct(F.col("session").cast("string").alias("session"), F.array(F.struct(kind.alias("kind"), "subject", "tree", "cause")).alias("events")))
    return ingest.validated(e.select("ts", body.alias("body"))).select("session", "kind", "subject", "size")


@query("draw_queue", f"""WITH {EV}, q AS (SELECT session, subject AS key, min(ts) AS ts FROM ev GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, key) - 1 AS n FROM q)
 SELECT session, key, round(max(epoch_us(ts) / 1e6 - n * 60.0) OVER (PARTITION BY session ORDER BY ts, key) + n * 60.0, 6) AS release FROM n""")
def _(s, d):
    return ingest.release_plan(rows(s, d, i.EVENTS).select("session", F.col("subject").alias("key"), "ts"), 60.0)


# ------------------------------------------------------------------ gates and sources


@query("gate_report", """WITH c AS (SELECT c_custkey % 1000 AS k, CASE WHEN c_custkey % 50 <> 7 THEN c_name END AS name, c_nationkey + CASE WHEN c_custkey % 90 = 4 THEN 25 ELSE 0 END AS nation, c_acctbal FROM customer)
 SELECT name, '0' AS expected, CAST(n AS VARCHAR) AS actual, n = 0 AS passed, true AS blocking, '' AS note FROM (
 SELECT 'name_present' AS name, count(*) FILTER (name IS NULL) AS n FROM c UNION ALL SELECT 'nation_in_range', count(*) FILTER (nation NOT BETWEEN 0 AND 24) FROM c
 UNION ALL SELECT 'balance_is_number', count(*) FILTER (c_acctbal IS NULL) FROM c UNION ALL SELECT 'unique_k', (SELECT count(*) FROM (SELECT k FROM c GROUP BY k HAVING count(*) > 1)) UNION ALL SELECT 'fk_nation', count(*) FILTER (nation > 24) FROM c)""")
def _(s, d):
    from ..runtime import table

    n = table(s, d, "nation")
    c = table(s, d, "customer").selectExpr("c_custkey % 1000 AS k", "CASE WHEN c_custkey % 50 <> 7 THEN c_name END AS name", "c_nationkey + CASE WHEN c_custkey % 90 = 4 THEN 25 ELSE 0 END AS nation", "c_acctbal")
    g = gates.Gates("customers")
    g.rules(c, {"name_present": F.col("name").isNotNull(), "nation_in_range": F.col("nation").between(0, 24), "balance_is_number": F.col("c_acctbal").isNotNull()})
    g.unique(c, "k")
    g.foreign(c, "nation", n, "n_nationkey")
    return g.frame(s)


@query("spot_checks", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey = 3 THEN 'wrong' ELSE n_name END AS expected, n_name AS actual, n_nationkey <> 3 AS passed FROM nation WHERE n_nationkey < 6")
def _(s, d):
    n = rows(s, d, "SELECT n_nationkey AS id, n_name AS v FROM {nation}")
    return gates.expectations(n, n.where("id < 6").withColumn("v", F.when(F.col("id") == 3, "wrong").otherwise(F.col("v"))), "id", "v")


@query("newick_roundtrip", f"{DUCK_TREE}, s AS (SELECT id, parent, rank, idx FROM t) SELECT a.idx, b.idx AS parent, a.rank || '_ott' || a.id AS label, a.id AS ext_id FROM s a LEFT JOIN s b ON b.id = a.parent")
def _(s, d):
    t = full(s, d).withColumn("label", F.concat_ws("", "rank", F.lit("_ott"), F.col("id").cast("string")))
    up = t.select(F.col("id").alias("parent"), F.col("subtree_out").alias("p_out"))
    path = f"{shared_dir(s)}/treeline-{uuid.uuid4().hex}"
    newick.save(t.join(up, "parent", "left").withColumn("is_last", F.col("subtree_out") == F.col("p_out")), path)
    return newick.read(s, path).select("idx", "parent", "label", "ext_id")


@query("turtle_extract", "SELECT 'http://x.example/' || n_nationkey AS subject, n_name AS label, CAST(n_nationkey + 0.5 AS DOUBLE) AS begin FROM nation")
def _(s, d):
    n = rows(s, d, "SELECT n_nationkey AS k, n_name AS name FROM {nation}")
    line = F.concat(F.lit("ex:"), F.col("k").cast("string"), F.lit(' a ex:Age ; ex:label "'), F.col("name"), F.lit('"@en, "x"@de ; ex:begin [ ex:value '), (F.col("k") + 0.5).cast("string"), F.lit(" ; ex:error 0.6 ] .\n"))
    text = n.agg(F.concat(F.lit("@prefix ex: <http://x.example/> .\n"), F.array_join(F.array_sort(F.collect_list(line)), "")).alias("value"))
    turtle.register(s)
    text.createOrReplaceTempView("_turtle_extract")
    t = s.sql("SELECT t.* FROM _turtle_extract, LATERAL turtle(value) t")
    ns = "http://x.example/"
    return turtle.one(t, ns + "label", "label", "en").join(turtle.bounds(t, ns + "begin", ns + "value", ns + "error", "begin"), "subject").select("subject", "label", "begin")
