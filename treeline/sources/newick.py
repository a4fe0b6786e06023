"""Newick trees: a reader by byte ranges, a table function for small texts, and writers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialise, observed, small

SCHEMA = "idx long, parent long, label string, ext_id long, branch_length double"
_TOKEN = re.compile(r"[(),;]|[^(),;]+")


def parse(text: str) -> Iterator[tuple]:
    """Rows in preorder; a node's number is given where it opens, its label where it closes."""
    parent: list[int | None] = []
    label: list[str] = []
    stack: list[int] = []
    fresh, done = True, False  # a node may open here; the root has ended

    def node() -> int:
        parent.append(stack[-1] if stack else None)
        label.append("")
        return len(parent) - 1

    current: int | None = None
    for token in _TOKEN.findall(re.sub(r"[\r\n]", "", text).strip()):
        if done and token.strip():
            raise ValueError("text after the end of the tree")
        if token == "(":
            if not fresh:
                raise ValueError("unexpected opening parenthesis")
            stack.append(node())
            current = None
        elif token in ",)":
            if not stack:
                raise ValueError("unbalanced parenthesis")
            if fresh:
                node()  # a nameless leaf
            if token == ")":
                current = stack.pop()
            fresh = token == ","
        elif token == ";":
            if stack:
                raise ValueError("unclosed parenthesis")
            done = True
        else:
            if "'" in token or '"' in token:
                raise ValueError("quoted labels aren't read")
            if fresh:
                current = node()
                fresh = False
            if current is not None:
                label[current] = token.strip()
            current = None
    if stack or not done:
        raise ValueError("unclosed tree")
    for i, (p, raw) in enumerate(zip(parent, label, strict=True)):
        yield (i, p, *split_label(raw))


def split_label(raw: str) -> tuple[str, int | None, float | None]:
    """(name, external id, branch length): the last colon splits if a number follows."""
    name, colon, tail = raw.rpartition(":")
    length = None
    if colon:
        try:
            length = float(tail)
        except ValueError:
            name = raw
    else:
        name = raw
    found = None if name.startswith("mrca") else re.search(r"(?:^|_)ott(\d+)$", name)
    return name, int(found[1]) if found else None, length


class NewickReader:
    """Table function: SELECT * FROM newick(text)."""

    def eval(self, text: str):
        yield from parse(text)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("newick", udtf(NewickReader, returnType=SCHEMA))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(part, at, text): what stands between commas, in the order of (part, at).
    A comma is the reader's line end, so one line of any length is read by byte
    ranges. Files of a folder are one text in the order of their names: the last
    piece of a file goes on in the first of the next (files end in a line end, as
    those of ``save`` do). A piece holds one leaf and the brackets about it."""
    raw = spark.read.option("lineSep", ",").text(path)
    raw = materialise(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"[\r\n]", "").alias("text")))
    # One row a range: the windows below have as many rows as there are ranges.
    ranges = raw.groupBy("file", "block").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    every = Window.orderBy("file", "block")
    ranges = ranges.select(
        "file", "block", F.row_number().over(every).alias("part"), F.when(F.row_number().over(every) == 1, F.col("low")).alias("start"),
        F.when(F.lag("file").over(every) != F.col("file"), F.col("low")).alias("goes_on"), F.when(F.lead("file").over(every) != F.col("file"), F.col("high")).alias("stays_open"),
    )
    placed = raw.join(small(ranges), ["file", "block"])
    goes_on, stays_open = (F.coalesce(F.col("at") == F.col(c), F.lit(False)) for c in ("goes_on", "stays_open"))
    text = F.when(F.col("at") == F.col("start"), F.ltrim("text")).otherwise(F.col("text")).alias("text")
    placed = placed.select("part", "at", text, goes_on.alias("goes_on"), (goes_on | stays_open).alias("seam"))
    seams = placed.where("seam").withColumn("piece", F.count_if(~F.col("goes_on")).over(Window.orderBy("part", "at")))  # two rows a file at most
    joined = seams.groupBy("piece").agg(F.min(F.struct("part", "at")).alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "text"))), lambda x: x["text"]), "").alias("text"))
    return placed.where("NOT seam").select("part", "at", "text").unionByName(joined.select("p.part", "p.at", "text"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``parse`` (in any order) for a text of any size. Sums of opening and
    closing brackets over the pieces give each its depth and its first node's number.
    A bracket closes the node last opened at its depth, and a piece's first node
    belongs to the one last opened a level above: both are running maxima within a
    range and depth, and what earlier ranges left open is carried over. No task
    needs more than a range (``spark.sql.files.maxPartitionBytes``). Malformed texts
    raise ValueError as in ``parse``."""
    p = pieces(spark, path).select("part", "at", F.regexp_replace("text", r";\s*$", "").alias("text"), F.col("text").rlike(r";\s*$").alias("end"))
    rest = F.expr("trim(LEADING '(' FROM text)")
    p = p.select("part", "at", "end", "text", (F.length("text") - F.length(rest)).cast("long").alias("k"), (F.size(F.split(rest, r"\)")) - 1).cast("long").alias("m"))
    p = materialise(p)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = p.groupBy("part").agg(F.sum(F.col("k") + 1).alias("nodes"), F.sum(F.col("k") - F.col("m")).alias("rise"))
    total = total.select("part", F.coalesce(F.sum("nodes").over(before), F.lit(0)).alias("nodes"), F.coalesce(F.sum("rise").over(before), F.lit(0)).alias("rise"))
    w = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    p = p.withColumns({"i": own(F.col("k") + 1), "d": own(F.col("k") - F.col("m"))}).join(small(total), "part")
    p = p.select("part", "at", "end", "text", "k", "m", (F.col("i") + F.col("nodes")).alias("first"), (F.col("d") + F.col("rise")).alias("depth"))
    count = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    p, seen = observed(
        p, F.coalesce(F.sum(F.col("k") - F.col("m")), F.lit(0)).alias("open"), count("end", "ends"), count("contains(text, ';')", "early"), count("text rlike '[\\'\"]'", "quoted"),
        count("length(text) - length(replace(text, '(', '')) > k", "opening"), count("depth + k < m OR first > 0 AND depth < 1", "unbalanced"),
    )
    for wrong, message in (
        (seen["quoted"], "quoted labels aren't read"), (seen["opening"], "unexpected opening parenthesis"), (seen["early"] or seen["ends"] > 1, "text after the end of the tree"),
        (seen["unbalanced"], "unbalanced parenthesis"), (seen["open"], "unclosed parenthesis"), (not seen["ends"], "unclosed tree"),
    ):
        if wrong:
            raise ValueError(message)

    parts = F.split(F.expr("trim(LEADING '(' FROM text)"), r"\)")
    none, word = F.lit(None).cast("long"), F.lit(None).cast("string")
    event = lambda d, o, opened, child, label: F.struct(d.alias("d"), o.cast("long").alias("o"), opened.alias("opened"), child.alias("child"), label.alias("label"))
    counted_up = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
    opens = F.transform(counted_up(F.col("k")), lambda t: event(F.col("depth") + t - 1, t, F.col("first") + t - 1, none, word))
    closes = F.transform(counted_up(F.col("m")), lambda s: event(F.col("depth") + F.col("k") - s, F.col("k") + s, none, none, F.get(parts, s.cast("int"))))
    asks = F.when(F.col("first") > 0, F.array(event(F.col("depth") - 1, F.lit(0), none, F.col("first"), word))).otherwise(F.array().cast("array<struct<d:bigint,o:bigint,opened:bigint,child:bigint,label:string>>"))
    events = p.select("part", "at", F.inline(F.concat(asks, opens, closes)))
    left = p.select("part", F.inline(F.transform(counted_up(F.col("k")), lambda t: F.struct((F.col("depth") + t - 1).alias("d"), (F.col("first") + t - 1).alias("opened"))))).groupBy("part", "d").agg(F.max("opened").alias("opened"))
    # What earlier ranges opened at a depth, for every range and depth that is asked for: one row each.
    asked = events.select("part", "d").distinct().join(left, ["part", "d"], "left")
    carried = asked.select("part", "d", F.max("opened").over(Window.partitionBy("d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = F.max("opened").over(Window.partitionBy("part", "d").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0))
    told = events.withColumn("here", here).where("opened IS NULL").join(carried, ["part", "d"]).withColumn("node", F.coalesce("here", "carried"))
    told = told.select(F.coalesce("child", "node").alias("idx"), F.when(F.col("child").isNotNull(), F.col("node")).alias("parent"), "label")
    leaf = p.select((F.col("first") + F.col("k")).alias("idx"), F.when(F.col("k") > 0, F.col("first") + F.col("k") - 1).alias("parent"), parts[0].alias("label"))
    inner = p.select(F.explode(counted_up(F.col("k") - 1)).alias("t"), "first").select((F.col("first") + F.col("t")).alias("idx"), (F.col("first") + F.col("t") - 1).alias("parent"), word.alias("label"))
    nodes = told.unionByName(leaf).unionByName(inner).groupBy("idx").agg(F.max("parent").alias("parent"), F.max("label").alias("raw"))
    return nodes.select("idx", "parent", *labelled(F.regexp_replace(F.coalesce("raw", F.lit("")), r"^\s+|\s+$", "")))


def labelled(raw: Column) -> list[Column]:
    """``split_label`` as expressions."""
    number = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
    tail = F.element_at(F.split(raw, ":"), -1)
    measured = F.contains(raw, F.lit(":")) & tail.rlike(number)
    name = F.when(measured, F.left(raw, F.length(raw) - F.length(tail) - 1)).otherwise(raw)
    found = F.when(~F.startswith(name, F.lit("mrca")), F.regexp_extract(name, r"(?:^|_)ott(\d+)$", 1))
    return [name.alias("label"), F.when(found != "", found.cast("long")).alias("ext_id"), F.when(measured, F.trim(tail).cast("double")).alias("branch_length")]


def fragments(tree: DataFrame) -> DataFrame:
    """(a, b, c, value): what every node of a numbered tree (idx, subtree_out, depth,
    label, child_count, is_last) puts before and after its subtree; in the order of
    (a, b, c) the values are the Newick text."""
    t = tree.select("idx", "depth", "label", "child_count", "subtree_out", "is_last")
    before = t.where("child_count > 0").select(F.col("idx").alias("a"), F.lit(0).cast("long").alias("b"), F.col("depth").alias("c"), F.lit("(").alias("value"))
    end = F.when(F.col("depth") == 0, ";").when(F.col("is_last"), "").otherwise(",")
    after = t.select(F.col("subtree_out").alias("a"), F.lit(-1).cast("long").alias("b"), (-F.col("depth")).alias("c"), F.concat(F.when(F.col("child_count") > 0, F.lit(")")).otherwise(""), F.coalesce("label", F.lit("")), end).alias("value"))
    return before.unionByName(after)


def save(tree: DataFrame, path: str) -> None:
    """Write the text of a tree of any size: files in order, a node's fragment a
    line; readers of the format skip the line ends."""
    order = ["a", "b", "c"]
    fragments(tree).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def write(tree: DataFrame) -> DataFrame:
    """One row ``value`` for a small tree, such as a selection's; ``save`` writes large ones."""
    parts = F.array_sort(F.collect_list(F.struct("a", "b", "c", "value")))
    return fragments(tree).agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("value"))
