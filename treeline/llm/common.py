"""Helpers shared by the training-data operators.

``materialise`` cuts lineage by writing a Parquet table into the folder that
``spark.checkpoint.dir`` names; every executor and the driver can read it, so a
lost executor only repeats tasks.  The setting is read from the session; only a
local session, as in tests, may leave it unset and gets a temporary folder.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white space characters of every word definition in this package.
SPACE = " \t\n\x0b\x0c\r"
#: Java and RE2 form of a word.
WORD = r"[^ \t-\r]+"
#: A table with at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("treeline.shared.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("treeline.shared.dir", base)
    return base


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/treeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes for its own steps: called like
    ``materialise``; ``drop`` removes them once what needs them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{shared_dir(self.spark)}/treeline-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a materialised table after counting it; beyond
    ``limit`` rows the join stays a shuffle that AQE may split."""
    return F.broadcast(df) if df.count() <= limit else df


def bind(value: Column, body) -> Column:
    """``let x = value in body(x)``: ``value`` is evaluated once although the
    body (which may hold lambdas) uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of an Arrow batch; Spark's default of 10,000 holds tens of megabytes of text several times over.
ARROW_ROWS = 2_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; a session that has Spark's default Arrow batches gets smaller ones."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an integer's decimal text, modulo ``modulus`` (null: as '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


# ---------------------------------------------------------------- Arrow helpers


def slices(batches: Iterator[pa.RecordBatch], text: str, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut record batches so that each holds about ``budget`` text bytes (one
    row at least), which bounds a worker's memory whatever the batch size is."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start, spent = 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, spent + budget, side="right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            spent, start = int(ends[stop - 1]), stop
        pa.default_memory_pool().release_unused()


def tidy(run: Callable) -> Callable:
    """Wrap a function of ``mapInArrow`` or ``applyInArrow``: after a partition (or
    group) the worker, which Spark keeps for the next task, gives its memory back."""

    def released() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    @functools.wraps(run)
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(given)
        released()

    return batches


class Remembered(dict):
    """A cache of at most about ``limit`` entries: the newer half outlives the older."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit // 2, {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def take(self, keys: list) -> tuple[list, list[int]]:
        """The keys' values, and where they are in neither half and None stands; makes room first."""
        self._rotate()
        got, missing = [*map(self.get, keys)], []
        for i, v in enumerate(got):
            if v is None:
                if (v := self.old.get(keys[i])) is None:
                    missing.append(i)
                else:
                    got[i] = self[keys[i]] = v
        return got, missing

    def _rotate(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        """Drop the older half."""
        self.old = {}

    def new_of(self, keys: set) -> list:
        """The keys that are in neither half; makes room first."""
        self._rotate()
        return [k for k in keys if k not in self and k not in self.old]


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split on the six white space characters.

    Returns (distinct words, code of each word occurrence, row offsets): the
    occurrences of row i are ``codes[offsets[i]:offsets[i + 1]]``; null rows have
    none.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    texts = pc.cast(texts, pa.large_string())
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    keep = pc.not_equal(pc.binary_length(flat), 0)
    flat = flat.filter(keep)
    row = row[keep.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    offsets = np.searchsorted(row, np.arange(len(parts) + 1))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets


def listed(words: pa.Array) -> list[str]:
    """Words without line feeds as a list, cut by Python from one text."""
    words = pc.cast(words, pa.large_string())
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py().split("\n") if len(words) else []


def hash64(values: list[str] | list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each value, the same in every process."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(v, seed) for v in values), dtype=np.uint64, count=len(values))


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """``hash64`` of a string array's values: those of one length together, long ones alone."""
    words = pc.cast(words, pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.zeros(0, np.uint8)
    start, size, out = offsets[:-1], np.diff(offsets), np.zeros(len(words), np.uint64)
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    for n in np.unique(size[size < 32]).tolist():
        own = np.flatnonzero(size == n)
        byte = data[start[own][:, None] + np.arange(n)]
        h, at = np.full(len(own), (seed + int(p5) + n) % 2**64, np.uint64), 0
        while at + 8 <= n:
            lane = np.ascontiguousarray(byte[:, at : at + 8]).view("<u8").ravel()
            h, at = turned(h ^ turned(lane * p2, 31) * p1, 27) * p1 + p4, at + 8
        if at + 4 <= n:
            lane = np.ascontiguousarray(byte[:, at : at + 4]).view("<u4").ravel().astype(np.uint64)
            h, at = turned(h ^ lane * p1, 23) * p2 + p3, at + 4
        for k in range(at, n):
            h = turned(h ^ byte[:, k].astype(np.uint64) * p5, 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        out[own] = h ^ (h >> np.uint64(32))
    rest = np.flatnonzero(size >= 32)
    out[rest] = hash64(words.take(pa.array(rest)).to_pylist(), seed)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]``, empty segments are 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]
