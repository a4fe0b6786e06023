"""A term index on disk, and the names that short queries ask for.

The index is a folder of Parquet files: postings (term, id, pos) under the
beginning of their term (``bucket``, ``LETTERS`` letters), in files sorted by (term,
id, pos).  A query reads the folders of its terms' beginnings only, and within them
the row groups whose terms can be meant.  Postings are dealt out by ranges of
(bucket, term, id), so a frequent term lies in several files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import PER_SPELLING, folded, postings, spellings

LETTERS = 2
SCHEMA = "term string, id long, pos long, bucket string"
#: Fixed value: names kept for short queries.
HOT_NAMES = 50_000


def save(names: DataFrame, path: str, group_bytes: int = 8 << 20) -> DataFrame:
    """Write the index of the numbered names (id, name) and read it back."""
    keyed = postings(names).withColumn("bucket", F.substring("term", 1, LETTERS))
    order = ["bucket", "term", "id", "pos"]
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", group_bytes).partitionBy("bucket").parquet(path)
    return load(names.sparkSession, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The index, with its columns' types stated: a beginning such as '12' stays text."""
    return spark.read.schema(SCHEMA).parquet(path)


def asked_terms(query: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", folded(query)) if w]


def near(words: list[str]) -> Column:
    """What an index row must satisfy to be read for these words, the last of them a
    prefix: its folder (a filter on partitions alone) and its term's range (a filter
    that row groups are skipped by)."""
    *whole, last = words
    folder = F.col("bucket").isin([w[:LETTERS] for w in whole]) if whole else F.lit(False)
    folder = folder | (F.col("bucket") == last[:LETTERS] if len(last) >= LETTERS else F.startswith("bucket", F.lit(last)))
    return folder & (F.col("term") >= min(words)) & (F.col("term") < max([*whole, last + "\U0010ffff"]) + "\0")


def pruned(index: DataFrame, query: str) -> DataFrame:
    """The rows of the index that ``search.matching`` needs for a query."""
    words = asked_terms(query)
    return index.where(near(words)) if words else index.limit(0)


# ------------------------------------------------------------------ hot names


def hot_names(nodes: DataFrame, most: int = HOT_NAMES) -> DataFrame:
    """(idx, name, tips): the ``most`` named nodes with most tips, a bounded table
    in the order of their names."""
    named = nodes.where("name IS NOT NULL").select("idx", "name", "tips")
    return named.orderBy(F.desc("tips"), "idx").limit(most).sort("name", "idx")


def prefix_hot(hot: DataFrame, nodes: DataFrame, query: str, most: int = PER_SPELLING) -> tuple[DataFrame, list[str]]:
    """(``search.prefix_top`` of the query, the spellings that the nodes were scanned for).

    Every name outside the hot table stands after all inside it, so a spelling that
    has ``most`` hot names needs no other; for the rest the nodes are scanned.  The
    counts are over the hot table, which is bounded.
    """
    asked = spellings(query)
    counts = hot.agg(*[F.count_if(F.startswith("name", F.lit(v))).alias(f"n{k}") for k, v in enumerate(asked)]).first() if asked else []
    scanned = [v for v, n in zip(asked, counts, strict=True) if n < most]
    out = nodes.where(F.col("name").isin(*asked)).select("idx")
    for v in asked:
        own = nodes if v in scanned else hot
        out = out.unionByName(own.where(F.startswith("name", F.lit(v))).orderBy(F.desc("tips"), "idx").limit(most).select("idx"))
    return out.distinct(), scanned
