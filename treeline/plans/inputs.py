"""Inputs of the registered queries, derived from the provided tables.

Each input is one SELECT that both engines read alike ({table} stands for a
table), so that a query's operators and its oracle start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree as trees
from ..runtime import materialise, shared_dir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
T = 1_000_000_000_000

#: Geographic tree: world, region, nation, customer, order; ids are level * 10^12 + key.
TREE = f"""
SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, 'world' AS name, 'root' AS rank
UNION ALL SELECT {T} + r_regionkey, CAST(0 AS BIGINT), r_name, 'region' FROM {{region}}
UNION ALL SELECT {2 * T} + n_nationkey, {T} + n_regionkey, n_name, 'nation' FROM {{nation}}
UNION ALL SELECT {3 * T} + c_custkey, {2 * T} + c_nationkey, c_name, 'customer' FROM {{customer}}
UNION ALL SELECT {4 * T} + o_orderkey, {3 * T} + o_custkey, concat('order ', o_orderkey), 'order' FROM {{orders}}"""
#: The same customers under market segments: a second topology.
SEGMENTS = f"""
SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent
UNION ALL SELECT DISTINCT {5 * T} + length(c_mktsegment) * 100 + ascii(c_mktsegment), CAST(0 AS BIGINT) FROM {{customer}}
UNION ALL SELECT DISTINCT {6 * T} + (length(c_mktsegment) * 100 + ascii(c_mktsegment)) * 1000 + c_nationkey, {5 * T} + length(c_mktsegment) * 100 + ascii(c_mktsegment) FROM {{customer}}
UNION ALL SELECT {3 * T} + c_custkey, {6 * T} + (length(c_mktsegment) * 100 + ascii(c_mktsegment)) * 1000 + c_nationkey FROM {{customer}}"""
CHOSEN = f"SELECT {3 * T} + c_custkey AS id FROM {{customer}} WHERE c_custkey % 97 = 5 UNION ALL SELECT {2 * T} + n_nationkey FROM {{nation}} WHERE n_nationkey = 7 UNION ALL SELECT CAST(-5 AS BIGINT) UNION ALL SELECT {2 * T} + n_nationkey FROM {{nation}} WHERE n_nationkey = 7"
#: Days between an order and the end of 1999; finished orders are dated.
ORDER_AGES = f"SELECT {4 * T} + o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice) / 100 END AS age, o_orderstatus AS status FROM {{orders}}"
AGES = f"SELECT id, age FROM ({ORDER_AGES}) o WHERE age IS NOT NULL UNION ALL SELECT {3 * T} + c_custkey, abs(c_acctbal) FROM {{customer}} WHERE c_custkey % 3 = 0 UNION ALL SELECT {2 * T} + n_nationkey, CAST(6000 + n_nationkey * 10 AS DOUBLE) FROM {{nation}} WHERE n_nationkey % 2 = 0"
MATCHES = f"""
SELECT {3 * T} + c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN abs(c_acctbal) END AS other_age,
 CASE c_custkey % 5 WHEN 0 THEN 'shared_tip' WHEN 1 THEN 'identical' WHEN 2 THEN 'subset' WHEN 3 THEN 'conflict' ELSE 'matched' END AS class FROM {{customer}}
UNION ALL SELECT {3 * T} + c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN abs(c_acctbal) END, 'conflict' FROM {{customer}} WHERE c_custkey % 10 = 1"""
LENGTHS = f"SELECT {3 * T} + c_custkey AS id, floor(abs(c_acctbal)) / 1000 AS length FROM {{customer}} UNION ALL SELECT {4 * T} + o_orderkey, CAST(o_orderkey % 13 AS DOUBLE) FROM {{orders}} UNION ALL SELECT {2 * T} + n_nationkey, CAST(n_nationkey AS DOUBLE) FROM {{nation}}"
SEEDS = f"SELECT {3 * T} + c_custkey AS id, c_custkey AS asset FROM {{customer}} WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 <> 1 UNION ALL SELECT {4 * T} + o_orderkey, 1000000 + o_orderkey FROM {{orders}} WHERE o_orderkey % 50 = 3"
FACTS = f"""
SELECT s_suppkey AS fact, s_name AS name, {2 * T} + s_nationkey AS attach, s_suppkey % 3 AS walk, s_suppkey % 11 AS n_occs, s_suppkey % 2 = 0 AS is_primary, s_suppkey % 5 <> 0 AS is_extinct,
 CAST(7000 + s_suppkey % 40 * 10 AS DOUBLE) AS oldest, CAST(5900 + s_suppkey % 30 * 20 AS DOUBLE) AS youngest FROM {{supplier}}"""
#: Facts in their own tree: part i under part floor(i / 4).
PARTS = "SELECT p_partkey AS id, CASE WHEN p_partkey >= 4 THEN CAST(floor(p_partkey / 4) AS BIGINT) END AS parent_id, CASE WHEN p_partkey % 6 = 0 THEN CAST(floor(p_partkey / 3) AS BIGINT) ELSE p_partkey END AS accepted_id, p_name AS name, p_size AS size, p_retailprice AS price FROM {part} WHERE p_partkey >= 1"
RESOLVED = f"SELECT p_partkey AS id, {2 * T} + p_partkey % 25 AS idx, p_partkey % 6 + 1 AS method FROM {{part}} WHERE p_partkey % 9 = 1"
CANDIDATES = f"""
SELECT 'a' AS source, concat('', p_partkey % 400) AS source_id, CASE WHEN p_partkey % 17 <> 0 THEN {2 * T} + p_partkey % 25 END AS idx,
 CASE p_partkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'ott_sourceinfo' WHEN 2 THEN 'phylopic_resolve' ELSE 'name_exact' END AS method, p_partkey AS input_pos FROM {{part}}"""
#: Names: kinds 0 part names, 2 types, 3 brands, over part keys.
NAMES = "SELECT p_partkey AS idx, CAST(0 AS BIGINT) AS kind, p_name AS name FROM {part} UNION ALL SELECT p_partkey, CAST(2 AS BIGINT), p_type FROM {part} UNION ALL SELECT p_partkey, CAST(3 AS BIGINT), p_brand FROM {part} WHERE p_partkey % 2 = 0"
EVENTS = """
SELECT event_id, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'search' ELSE 'tree' END AS kind, event_type, concat('k', event_id % 23) AS subject,
 CASE WHEN event_id % 4 = 0 THEN concat('k', event_id % 5) ELSE concat('k', event_id % 3, ',k', event_id % 5) END AS tree,
 CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'link' END AS cause, user_id AS session, ts, 1 + event_id % 4 AS weight FROM {events}"""
KEYS = "SELECT concat('k', n_nationkey) AS key, n_name AS name FROM {nation} WHERE n_nationkey % 4 <> 3"
ALIASES = """
SELECT c_nationkey AS idx, CASE c_custkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS lang, CASE WHEN c_custkey % 9 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name,
 CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS source, c_custkey % 3 AS source_rank, c_custkey % 3 AS kind, c_custkey AS source_id FROM {customer}"""
#: Months under quarters under years, as intervals of months before 1999.
SCALE = """
SELECT DISTINCT year(o_orderdate) * 100 AS id, CAST(NULL AS BIGINT) AS parent, 'year' AS rank, CAST((1999 - year(o_orderdate)) * 12 AS DOUBLE) AS begin, CAST((1999 - year(o_orderdate)) * 12 - 12 AS DOUBLE) AS "end" FROM {orders}
UNION ALL SELECT DISTINCT year(o_orderdate) * 100 + 20 + quarter(o_orderdate), year(o_orderdate) * 100, 'quarter', CAST((1999 - year(o_orderdate)) * 12 - quarter(o_orderdate) * 3 + 3 AS DOUBLE), CAST((1999 - year(o_orderdate)) * 12 - quarter(o_orderdate) * 3 AS DOUBLE) FROM {orders}
UNION ALL SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate), year(o_orderdate) * 100 + 20 + quarter(o_orderdate), 'month', CAST((1999 - year(o_orderdate)) * 12 - month(o_orderdate) + 1 AS DOUBLE), CAST((1999 - year(o_orderdate)) * 12 - month(o_orderdate) AS DOUBLE) FROM {orders}"""

_made: dict[tuple, DataFrame | str] = {}


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace('"end"', "`end`").format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = materialise(make())
    return _made[key]


def _once_path(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """A folder in the shared place that ``write`` has filled, once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        path = f"{shared_dir(spark)}/treeline-{uuid.uuid4().hex}"
        write(path)
        _made[key] = path
    return _made[key]


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint", "decimal(20,0)") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geographic tree as it stands: id, parent, name, rank."""
    return _longs(frame(spark, sf_dir, TREE))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geographic tree with idx, size, depth, its counts and layers; written once."""
    return _once(spark, sf_dir, "numbered tree", lambda: trees.numbered(nodes(spark, sf_dir)))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered tree with every node's lineage; written once."""
    return lined(spark, sf_dir).drop("tip_count", "child_count", "layer")


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tree`` with counts and layers."""
    return _once(spark, sf_dir, "tree", lambda: trees.lineages(numbered(spark, sf_dir)))


COUNTS = ("child_count", "child_count = 0 AS is_tip", "tip_count", "idx + size AS subtree_out")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).selectExpr("id", *COUNTS)


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered tree with its metrics."""
    return numbered(spark, sf_dir).selectExpr("*", *COUNTS[1::2])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "segments", lambda: trees.lineages(_longs(frame(spark, sf_dir, SEGMENTS))))


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return _longs(frame(spark, sf_dir, sql))


#: The oracle's tree: numbered by sorted paths, closure by recursion.
DUCK_TREE = f"""WITH RECURSIVE base AS ({duck(TREE)}),
p AS (SELECT id, parent, name, rank, '' AS path, CAST(0 AS BIGINT) AS depth FROM base WHERE parent IS NULL
 UNION ALL SELECT b.id, b.parent, b.name, b.rank, p.path || '/' || lpad(CAST(b.id % {T} AS VARCHAR), 12, '0'), p.depth + 1 FROM base b JOIN p ON b.parent = p.id),
t AS (SELECT id, parent, name, rank, depth, row_number() OVER (ORDER BY path) - 1 AS idx FROM p),
c AS (SELECT id, id AS anc, CAST(0 AS BIGINT) AS hops, parent AS nxt FROM t UNION ALL SELECT c.id, t.id, c.hops + 1, t.parent FROM c JOIN t ON c.nxt = t.id),
sz AS (SELECT anc AS id, count(*) AS size FROM c GROUP BY anc),
kids AS (SELECT parent AS id, count(*) AS child_count FROM t WHERE parent IS NOT NULL GROUP BY parent),
m0 AS (SELECT t.*, sz.size, coalesce(kids.child_count, 0) AS child_count FROM t JOIN sz USING (id) LEFT JOIN kids USING (id)),
tp AS (SELECT c.anc AS id, count(*) AS tip_count FROM c JOIN m0 ON c.id = m0.id WHERE m0.child_count = 0 GROUP BY c.anc),
m AS (SELECT m0.*, tp.tip_count FROM m0 JOIN tp USING (id))"""
