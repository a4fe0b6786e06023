"""Tabular sources: ragged delimited text, checkpoints, zipped members, arrays."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise


def piped(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """Tab-pipe-tab text; rows with too few fields or a key that isn't an integer are skipped."""
    cut = spark.read.text(path).select(F.split("value", r"\t\|\t?").alias("f")).where(F.size("f") >= len(columns))
    rows = cut.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return rows.withColumn(key, F.col(key).try_cast("long")).where(F.col(key).isNotNull())


def forwards(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of a two-column tab-separated file."""
    return spark.read.csv(path, sep="\t", schema="old long, new long", mode="DROPMALFORMED")


def headed(spark: SparkSession, path: str, schema: str, tri_state: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """CSV with a header; empty text is null; (yes, no) columns become booleans, other text null."""
    df = spark.read.csv(path, header=True, schema=schema)
    df = df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    for c, (yes, no) in (tri_state or {}).items():
        df = df.withColumn(c, F.when(F.col(c) == yes, True).when(F.col(c) == no, False))
    return df


def fixed_fields(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    r"""Headerless TSV (gzip read whole, then dealt out) with \N nulls: rows and malformed rows."""
    df = spark.read.csv(path, sep="\t", nullValue="\\N", schema=schema + ", _bad string", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", quote="")
    df = materialise(df.repartition(spark.sparkContext.defaultParallelism))
    return df.where("_bad IS NULL").drop("_bad"), df.where("_bad IS NOT NULL").select("_bad")


def checkpoint_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """NDJSON checkpoint: of a key's lines the last wins, a torn line is ignored."""
    lines = spark.read.text(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    rows = lines.select("_at", F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull() & F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "_at").alias("r")).select("r.*")


def json_map(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """(key, value...) rows of a large object field: {field: {key: value}}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{field} map<string,{value}>").alias("d"))
    return whole.select(F.explode(f"d.{field}").alias("key", "value"))


def zipped(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Tab-separated member of zip archives; its columns by header."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as file:
                    for part in pd.read_csv(file, sep="\t", dtype=str, chunksize=50_000, keep_default_na=False):
                        yield part.reindex(columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def pages(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """Replay of a crawl's page files (page_*.jsonl): a key's last page wins, torn lines are ignored."""
    return checkpoint_lines(spark, f"{folder}/page_*.jsonl", schema, key)


def plain_ids(df: DataFrame, key: str) -> DataFrame:
    """The rows, unless a key is a compound one ('accepted#synonym'), which would
    lead to the accepted row: that is an error."""
    n = df.where(F.contains(key, F.lit("#"))).count()
    if n:
        raise ValueError(f"{n} rows carry a compound id in {key}")
    return df


def array_file(content: bytes) -> np.ndarray:
    """One-dimensional little-endian .npy (versions 1 to 3) of a plain number type."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    major = content[6]
    if major not in (1, 2, 3):
        raise ValueError(f"version {major}")
    start, size = (10, struct.unpack("<H", content[8:10])[0]) if major == 1 else (12, struct.unpack("<I", content[8:12])[0])
    import ast

    head = ast.literal_eval(content[start : start + size].decode("utf-8" if major == 3 else "latin-1").strip())
    if head["fortran_order"] or len(head["shape"]) != 1 or head["descr"] not in ("<u1", "|u1", "<u2", "<u4", "<i4", "<i8", "<f4", "<f8"):
        raise ValueError(f"unsupported array {head}")
    out = np.frombuffer(content, dtype=head["descr"], offset=start + size)
    if len(out) < head["shape"][0]:
        raise ValueError("truncated")
    return out[: head["shape"][0]]


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, value) of array files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                a = array_file(content)
                for i in range(0, len(a), 100_000):
                    part = a[i : i + 100_000].astype(float)
                    yield pd.DataFrame({"path": p, "idx": np.arange(i, i + len(part)), "value": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, idx long, value double")


def shards(counts: DataFrame, by: list[str], cap: int) -> DataFrame:
    """Covering plan: at each level, groups within the cap are shards and larger
    ones are divided by the next column; what stays too large is flagged."""
    todo, out = counts, None
    for level in range(1, len(by) + 1):
        keys = by[:level]
        size = todo.groupBy(*keys).agg(F.sum("n").alias("size"))
        last = level == len(by)
        fit = size if last else size.where(F.col("size") <= cap)
        rows = fit.select(*[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in by], "size", (F.col("size") > cap).alias("over"))
        out = rows if out is None else out.unionByName(rows)
        if not last:
            todo = todo.join(size.where(F.col("size") > cap).select(*keys), keys, "left_semi")
    return out


def flat_items(items: DataFrame) -> DataFrame:
    """Nested API items (uuid, _links struct with arrays of href/title) to records with all external ids."""
    ids = F.transform("_links.resolvedExternalIds", lambda x: F.regexp_extract(x["href"], r"resolve/([^?]+)", 1))
    return items.select("uuid", F.col("_links.specificNode.title").alias("name"), F.array_distinct(F.filter(ids, lambda x: x != "")).alias("external_ids"))


def covered(rows: DataFrame, plan: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., size, got, complete): whether each planned shard's distinct keys are
    all there. Rows may come from overlapping shards."""
    got = None
    for level in range(1, len(by) + 1):
        some = rows.groupBy(*by[:level]).agg(F.count_distinct(key).alias("got")).select(*[F.col(b) if b in by[:level] else F.lit(None).cast("string").alias(b) for b in by], "got")
        got = some if got is None else got.unionByName(some)
    same = [plan[b].eqNullSafe(got[b]) for b in by]
    j = plan.join(got, same, "left").select(*[plan[b] for b in by], "size", F.coalesce("got", F.lit(0)).alias("got"))
    return j.withColumn("complete", F.col("got") == F.col("size"))


def distinct_keys(rows: DataFrame, key: str) -> DataFrame:
    """One row a key; which one doesn't depend on the order of the input."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
