"""Batch side of event analytics: overview, top subjects, sets, days, labels.

Events are (kind, subject, tree, cause, session, ts, weight); weight is the
sampling interval that a stored row stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retained(events: DataFrame, now, days: int) -> DataFrame:
    return events.where(F.col("ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def overview(events: DataFrame) -> DataFrame:
    return events.agg(F.sum("weight").alias("weighted"), F.count("*").alias("raw"), F.max("weight").alias("worst"), F.count_distinct("session").alias("sessions"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def top_subjects(events: DataFrame, kind: str, k: int) -> DataFrame:
    some = events.where((F.col("kind") == kind) & F.col("subject").isNotNull())
    return some.groupBy("subject").agg(F.sum("weight").alias("weighted"), F.count_distinct("session").alias("sessions")).orderBy(F.desc("weighted"), "subject").limit(k)


def tree_sets(events: DataFrame, made: bool) -> DataFrame:
    """Sets that users made (cause add or remove) or received, with their sizes."""
    own = F.col("cause").isin("add", "remove")
    some = events.where("kind = 'tree'").where(own if made else ~F.coalesce(own, F.lit(False)))
    by = ["tree", F.size(F.split("tree", ",")).cast("long").alias("size")] + ([] if made else ["cause"])
    return some.groupBy(*by).agg(F.sum("weight").alias("weighted"))


def daily(events: DataFrame, kinds: list[str]) -> DataFrame:
    """One row a day: weight of each kind, and distinct sessions."""
    day = events.withColumn("day", F.to_date("ts"))
    return day.groupBy("day").agg(*[F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0)).alias(k) for k in kinds], F.count_distinct("session").alias("sessions"))


def labelled(rows: DataFrame, names: DataFrame, column: str = "subject") -> DataFrame:
    """Add ``label``: a key's name, or the key itself."""
    return rows.join(names.select(F.col("key").alias(column), "name"), column, "left").withColumn("label", F.coalesce("name", column)).drop("name")


def tree_labels(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(tree, label): keys of a set replaced by names, joined by ' + ' in order."""
    keys = sets.select("tree").distinct().select("tree", F.posexplode(F.split("tree", ",")).alias("pos", "key"))
    named = keys.join(names, "key", "left").groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "key").alias("n")))).alias("a"))
    return named.select("tree", F.array_join(F.transform("a", lambda x: x["n"]), " + ").alias("label"))


def set_key(keys: Column) -> Column:
    """Identity of a set: sorted, distinct, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(keys)), ",")


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}{'' if n == 1 else 's'}"


def report(overall: dict, subjects: list[tuple]) -> str:
    """Plain-text report of collected (bounded) results."""
    note = "" if overall["worst"] in (None, 1) else f" (sampled, up to 1 in {overall['worst']})"
    lines = [f"{overall['weighted']} event{'s' * (overall['weighted'] != 1)} in {overall['sessions']} session{'s' * (overall['sessions'] != 1)}{note}"]
    return "\n".join(lines + [f"{n:>8}  {s}" for s, n in subjects])


def report_page(overall: dict, tables: dict[str, list[tuple]]) -> str:
    """The same as an HTML page: a heading, the sampling note where rows stand for
    more than one event, and a table for each named list of (subject, weight)."""
    from html import escape

    note = "" if overall["worst"] in (None, 1) else f"<p>Sampled: a stored row stands for up to {overall['worst']:,} events.</p>"
    rows = lambda some: "".join(f"<tr><td>{escape(str(s))}</td><td>{n:,}</td></tr>" for s, n in some) or "<tr><td>none</td></tr>"
    body = "".join(f"<h2>{escape(name)}</h2><table>{rows(some)}</table>" for name, some in tables.items())
    return f"<!doctype html><title>Report</title><h1>{plural(overall['weighted'] or 0, 'event')} in {plural(overall['sessions'] or 0, 'session')}</h1>{note}{body}"
