"""Declarative data-quality gates; nothing is published unless the blocking ones pass."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise

SCHEMA = "name string, expected string, actual string, passed boolean, blocking boolean, note string"


@dataclass
class Gates:
    """Named assertions on aggregates; each reads as {expected, actual, passed}."""

    phase: str
    rows: list[tuple] = field(default_factory=list)

    def require(self, name: str, expected, actual, passed: bool | None = None, blocking: bool = True, note: str = "") -> bool:
        ok = bool(expected == actual if passed is None else passed)
        self.rows.append((name, str(expected), str(actual), ok, blocking, note))
        return ok

    def observe(self, name: str, actual, note: str = "") -> None:
        self.require(name, "-", actual, True, False, note)

    def rules(self, df: DataFrame, checks: dict[str, Column], blocking: bool = True) -> None:
        """Rows that break each rule, counted in one pass; 0 is expected."""
        got = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]).first()
        for n in checks:
            self.require(n, 0, got[n], blocking=blocking)

    def unique(self, df: DataFrame, *keys: str) -> None:
        self.require(f"unique_{'_'.join(keys)}", 0, df.groupBy(*keys).count().where("count > 1").count())

    def foreign(self, df: DataFrame, key: str, other: DataFrame, other_key: str) -> None:
        missing = df.where(F.col(key).isNotNull()).join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")
        self.require(f"fk_{key}", 0, missing.count())

    def not_null(self, df: DataFrame, *columns: str) -> None:
        self.rules(df, {f"not_null_{c}": F.col(c).isNotNull() for c in columns})

    def in_set(self, df: DataFrame, column: str, values: list) -> None:
        """Values outside a closed list; null is none of them and allowed."""
        self.rules(df, {f"in_set_{column}": F.col(column).isNull() | F.col(column).isin(values)})

    def row_count(self, df: DataFrame, name: str, low: int, high: int | None = None) -> None:
        n = df.count()
        self.require(f"rows_{name}", f"{low} to {'any' if high is None else high}", n, n >= low and (high is None or n <= high))

    def at_least(self, name: str, floor, actual, note: str = "") -> None:
        self.require(name, f">= {floor}", actual, actual is not None and actual >= floor, note=note)

    def drift(self, name: str, before, now, allowed) -> None:
        self.require(name, f">= {before} - {allowed}", now, before is None or now >= before - allowed)

    @property
    def failures(self) -> list[str]:
        return [r[0] for r in self.rows if not r[3] and r[4]]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def report(self) -> str:
        keys = ("name", "expected", "actual", "passed", "blocking", "note")
        return json.dumps({"phase": self.phase, "failed": self.failures, "gates": [dict(zip(keys, r, strict=True)) for r in self.rows]}, indent=1)

    def publish(self, df: DataFrame, path: str) -> None:
        """Write only what passes; the error names what failed."""
        if self.failures:
            raise ValueError(f"{self.phase}: gates failed: {', '.join(self.failures)}")
        df.write.mode("overwrite").parquet(path)


def expectations(actual: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, expected, actual, passed) of pinned spot checks; missing rows fail."""
    j = wanted.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "left")
    return j.select(key, "expected", "actual", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("passed"))


def build_id(tables: dict[str, DataFrame]) -> str:
    """Content hash of named tables: order-free sums of row hashes, then SHA-256."""
    parts = []
    for name, df in sorted(tables.items()):
        h = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.bit_xor("h").alias("x"), F.count("*").alias("n")).first()
        parts.append(f"{name}:{h['n']}:{h['x']}:{','.join(df.columns)}")
    import hashlib

    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, expected, actual, state) of pinned files (name, sha256) against a
    manifest: 'ok', 'changed' or 'missing', which is what a resumed download fetches."""
    actual = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("actual"))
    j = wanted.select("name", F.col("sha256").alias("expected")).join(actual, "name", "left")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("expected"), "ok").otherwise("changed")
    return j.select("name", "expected", "actual", state.alias("state"))


def package(spark: SparkSession, reports: list[str], tables: dict[str, DataFrame], aligned: list[tuple[str, str, str]] = (), floors: dict[str, int] | None = None) -> Gates:
    """Gates over earlier phases' reports and the tables to publish: every phase
    passed; tables that describe the same keys (table, table, key) hold the same
    ones; every table has its least number of rows."""
    out = Gates("package")
    for text in reports:
        try:
            r = json.loads(text)
            out.require(f"phase_{r['phase']}", [], r["failed"])
        except (ValueError, KeyError) as e:
            out.require("report_readable", "valid report", str(e)[:80], False)
    for a, b, key in aligned:
        one, two = tables[a].select(key), tables[b].select(key)
        out.require(f"keys_{a}_{b}", 0, one.exceptAll(two).count() + two.exceptAll(one).count())
    for name, df in tables.items():
        least = (floors or {}).get(name, 1)
        out.at_least(f"rows_{name}", least, df.limit(least).count())
    out.observe("build_id", build_id({n: materialise(d) for n, d in tables.items()}))
    return out
