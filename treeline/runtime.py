"""Session helpers: tables in the shared folder cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A counted table of at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a task where the number of tasks follows the rows, which AQE then leaves alone.
TASK_ROWS = 250_000


def tasks(rows: int) -> int:
    """How many tasks share so many rows."""
    return max(1, -(-rows // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("treeline.shared.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("treeline.shared.dir", base)
    return base


def materialise(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/treeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split(df: DataFrame, by: str) -> DataFrame:
    """``materialise`` in folders by the values of a column, so that a filter on it reads those only."""
    path = f"{shared_dir(df.sparkSession)}/treeline-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, *figures: Column, by: str | None = None) -> tuple[DataFrame, dict]:
    """``materialise``, or ``split`` by a column, and aggregates of the rows, taken as they are written."""
    seen = Observation()
    path = f"{shared_dir(df.sparkSession)}/treeline-{uuid.uuid4().hex}"
    out = df.observe(seen, *figures).write
    (out.partitionBy(by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def counted(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """``materialise``, and how many rows satisfy a condition, counted as they are written."""
    out, seen = observed(df, F.count_if(F.expr(condition)).alias("n"))
    return out, seen["n"]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; beyond the limit the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
