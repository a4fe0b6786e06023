"""Connected components by minimum labels and pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise


def components(edges: DataFrame, keep=materialise) -> DataFrame:
    """edges: (a, b) of comparable ids -> (id, label), label the least id reachable.

    Every round lowers each id's label to the least label among its neighbours
    and then to its label's label, so the rounds grow as the logarithm of the
    longest chain.  Rounds are cut by written tables; a lost executor repeats
    tasks only.  Joins are between written tables, so AQE can split hot ids.
    """
    write = Scratch(edges.sparkSession)
    both = write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        lower = write(labels.join(near, labels.id == near.a, "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("next")))
        up = lower.select(F.col("id").alias("of"), F.col("next").alias("above"))
        jumped = write(lower.join(up, lower.next == up.of, "left").select("id", "label", F.coalesce("above", "next").alias("next")))
        changed = jumped.where("next <> label").limit(1).count()
        labels = jumped.select("id", F.col("next").alias("label"))
        if not changed:
            found = keep(labels)
            write.drop()
            return found
