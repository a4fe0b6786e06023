"""The build as phases: each reads earlier phases' tables and writes its own.

``python -m treeline PHASE SOURCE TARGET`` runs one phase, ``all`` every phase in
order.  A phase that has its report is skipped unless ``--again`` is given, so an
interrupted build resumes; a phase whose needs have no report is refused.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ages, gates, search
from .operators import tree as trees
from .plans import inputs


class Build:
    """Tables and reports of a build under one folder that all executors share."""

    def __init__(self, spark: SparkSession, source: str, target: str):
        self.spark, self.source, self.target = spark, source, target

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.target}/{name}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.target}/{name}")
        return self.read(name)

    def report(self, phase: str) -> str | None:
        """A finished phase's report, None if it has none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.target}/reports/{phase}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.text(f"{self.target}/reports/{phase}", wholetext=True).first()[0]


def tree_phase(b: Build) -> gates.Gates:
    t = b.write("tree", trees.preorder(trees.lineages(inputs.rows(b.spark, b.source, inputs.TREE))))
    m = b.write("metrics", trees.metrics(t))
    g = gates.Gates("tree")
    for r in trees.invariants(t, m).collect():
        g.require(r["rule"], 0, r["violations"])
    return g


def ages_phase(b: Build) -> gates.Gates:
    t = b.read("tree")
    known = b.write("ages", inputs.rows(b.spark, b.source, inputs.AGES))
    placed = b.write("layout", ages.layout_fill(t, known, 9999.0))
    g = gates.Gates("ages")
    g.require("placed", t.count(), placed.count())
    g.observe("older_than_parent", ages.violations(t, known).count())
    return g


def names_phase(b: Build) -> gates.Gates:
    rows = b.write("aliases", inputs.rows(b.spark, b.source, inputs.ALIASES))
    g = gates.Gates("names")
    g.not_null(rows, "idx", "name")
    return g


def search_phase(b: Build) -> gates.Gates:
    nodes = b.read("tree").join(b.read("metrics"), "id").select("idx", "name", F.col("tip_count").alias("tips"))
    found = search.numbered(search.corpus(nodes, *[nodes.limit(0)] * 4), search.signals(nodes))
    numbered = b.write("names", found)
    b.write("postings", search.postings(numbered))
    g = gates.Gates("search")
    g.unique(numbered, "id")
    return g


def package_phase(b: Build) -> gates.Gates:
    tables = {n: b.read(n) for n in ("tree", "metrics", "layout", "names")}
    return gates.package(b.spark, [b.report(p) for p in PHASES if p != "package"], tables, [("tree", "metrics", "id"), ("tree", "layout", "id")])


#: phase -> (phases it needs, what it does)
PHASES: dict[str, tuple[tuple[str, ...], Callable[[Build], gates.Gates]]] = {
    "tree": ((), tree_phase),
    "ages": (("tree",), ages_phase),
    "names": ((), names_phase),
    "search": (("tree",), search_phase),
    "package": (("tree", "ages", "names", "search"), package_phase),
}


def run(b: Build, phase: str, again: bool = False) -> bool:
    """Run a phase and keep its report; False if it was done already. Failed gates
    are an error and leave no report."""
    needs, work = PHASES[phase]
    missing = [n for n in needs if b.report(n) is None]
    if missing:
        raise ValueError(f"{phase} needs {', '.join(missing)}")
    if b.report(phase) is not None and not again:
        return False
    g = work(b)
    if g.failures:
        raise ValueError(f"{phase}: gates failed: {', '.join(g.failures)}")
    told = json.dumps(json.loads(g.report()))
    b.spark.range(1).select(F.lit(told).alias("value")).coalesce(1).write.mode("overwrite").text(f"{b.target}/reports/{phase}")
    return True


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="treeline", description=__doc__)
    p.add_argument("phase", choices=[*PHASES, "all"])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--again", action="store_true")
    a = p.parse_args(args)
    b = Build(SparkSession.builder.getOrCreate(), a.source, a.target)
    for phase in PHASES if a.phase == "all" else [a.phase]:
        print(phase, "done" if run(b, phase, a.again) else "was done before")
