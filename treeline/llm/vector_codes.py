"""Vector code compression: product codebooks by Yinyang Lloyd in integers.

A component x becomes floor(256 x); a vector is cut into ``PARTS`` equal parts and
each part position has a codebook of at most ``ENTRIES`` entries, which starts as
that part of the first vectors by id.  Lloyd rounds assign every part to its
nearest entry (ties to the lower index) and move every entry to the floor of its
parts' mean.

Each codebook's entries are clustered into ``GROUPS`` groups once.  A part keeps
one lower bound a group on its distance to the group's entries other than its
own.  After a round a bound falls by the longest move in its group; the distance to
the part's own entry is computed exactly, and only groups whose bound doesn't
exceed it are scanned.  Scans are 32-bit matrix products with a stated error;
entries within that error of the nearest are compared again in integers, so every
result is that of exact arithmetic.

A round reads the vectors with their codes and bounds from a written table and
writes the next one; entries' sums are added up per task and by Spark, and only
codebooks (PARTS x ENTRIES rows) are on the driver.

Defined cases: rows whose vector is null, or holds null or non-finite components,
are dropped, and so are vectors whose length isn't the most frequent one (the
shorter of two) or no multiple of ``PARTS``; components of 2^20 or more are an
error; rows that repeat an id are coded each, in the order of their integers
where they start the codebooks; null ids come last; with fewer vectors the
codebooks are smaller; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialise, read, small, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
GROUPS = 8
#: Components under 2^20 keep every squared distance of a part within 63 bits.
LARGEST = 1 << 20
STATE = "v binary, code binary, bound binary"


class Codebook(NamedTuple):
    """Entries of one part position, the group of each, and how far each moved last."""

    entries: np.ndarray  # (entries, width) integers
    group: np.ndarray
    moved: np.ndarray


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group of each entry, by a few Lloyd rounds over the entries themselves."""
    groups = min(groups, len(entries))
    centre = entries[np.linspace(0, len(entries) - 1, groups).astype(int)].astype(float)
    own = np.zeros(len(entries), np.int64)
    for _ in range(5):
        own = ((entries[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centre[g] = entries[own == g].mean(axis=0)
    return own


def below(x: np.ndarray) -> np.ndarray:
    """Distances rounded down to half precision; beyond its range, its largest."""
    half = np.clip(x, -60_000, 60_000).astype(np.float16)
    return np.where(half.astype(np.float64) > np.clip(x, -60_000, None), np.nextafter(half, np.float16(-np.inf)), half)


def assign(x: np.ndarray, book: Codebook, own: np.ndarray | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """x: (n, width) integers; own, bound: each row's entry and bounds so far.

    Returns each row's entry, its squared distance, the bounds by group, and how
    many times a row met a group.
    """
    rows_, groups, entries = np.arange(len(x)), int(book.group.max()) + 1, book.entries
    if own is None:
        own, bound = np.zeros(len(x), np.int64), np.full((len(x), groups), -np.inf)
    else:
        drift = np.array([book.moved[book.group == g].max(initial=0.0) for g in range(groups)])
        own, bound = own.astype(np.int64), bound.astype(np.float64) - drift * (1 + 1e-9)
    best, found = own.copy(), square(x, entries[own])
    held = np.sqrt(found.astype(np.float64))
    scan = bound <= held[:, None] * (1 + 1e-9)
    x32, e32 = x.astype(np.float32), entries.astype(np.float32)
    norm_x, norm_e = np.einsum("ij,ij->i", x32, x32), np.einsum("ij,ij->i", e32, e32)
    top = float(norm_x.max(initial=0) + norm_e.max())
    slack = 0.0 if top < 1 << 21 else 1e-5 * top  # integers under 2^24 are exact; else more than (width + 8) roundings of 2^-24 each
    seen = []
    for g in range(groups):
        rows, members = np.flatnonzero(scan[:, g]), np.flatnonzero(book.group == g)
        if not len(rows) or not len(members):
            continue
        near = norm_x[rows, None] - 2 * (x32[rows] @ e32[members].T) + norm_e[members]
        least = near.min(axis=1)
        row, column = np.nonzero(near <= (least + np.float32(2 * slack))[:, None])
        exact = square(x[rows[row]], entries[members[column]])
        order = np.lexsort((members[column], exact, row))
        first = order[np.append(True, np.diff(row[order]) != 0)]
        entry, d = members[column[first]], exact[first]
        closer = (d < found[rows]) | ((d == found[rows]) & (entry < best[rows]))
        best[rows[closer]], found[rows[closer]] = entry[closer], d[closer]
        arg = near.argmin(axis=1)
        near[np.arange(len(rows)), arg] = np.inf
        seen.append((g, rows, members[arg], least, near.min(axis=1)))
    left = (best != own) & ~scan[rows_, book.group[own]]  # the entry that a row left counts in its group's bound now
    bound[left, book.group[own[left]]] = np.minimum(bound[left, book.group[own[left]]], held[left] * (1 - 1e-12))
    for g, rows, entry, least, second in seen:
        other = np.where(entry == best[rows], second, least).astype(np.float64)
        bound[rows, g] = np.sqrt(np.maximum(other - slack, 0)) * (1 - 1e-12)
    return best, found, below(bound), int(scan.sum())


# ---------------------------------------------------------------------- rounds


def _packed(x: np.ndarray) -> pa.Array:
    """Integer rows as bytes, in two bytes a number where they fit."""
    kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64
    return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    out = [np.frombuffer(v, np.int16 if len(v) == 2 * width else np.int64) for v in column.to_pylist()]
    return np.array(out, np.int64).reshape(-1, width)


def _by_part(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, PARTS, width)


def _assigned(rows: DataFrame, books: list[Codebook], width: int, last: bool) -> DataFrame:
    """rows: (id, label, ints) at first, else (id, label, v, code, bound); gives
    the latter with new codes and bounds, or (id, label, code, error) at last."""
    kept = {f.name: f.dataType for f in rows.schema if f.name in ("id", "label")}
    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in kept.items()) + (", code binary, error long" if last else f", {STATE}")
    first, dims = "ints" in rows.columns, PARTS * width
    groups = [int(b.group.max()) + 1 for b in books]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if first else _unpacked(b.column("v"), dims)
            parts = x.reshape(-1, PARTS, width)
            own = None if first else _by_part(b.column("code"), np.uint8, 1)
            bound = None if first else _by_part(b.column("bound"), np.float16, GROUPS)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            bounds = np.zeros((len(x), PARTS, GROUPS), np.float16)
            for p, book in enumerate(books):
                at = None if first else own[:, p, 0], None if first else bound[:, p, : groups[p]]
                code[:, p], found, bounds[:, p, : groups[p]], _ = assign(np.ascontiguousarray(parts[:, p]), book, *at)
                error += found
            ids = [b.column("id"), b.column("label")]
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([*ids, codes, pa.array(error)], ["id", "label", "code", "error"])
            else:
                told = pa.array([r.tobytes() for r in bounds], pa.binary())
                yield pa.RecordBatch.from_arrays([*ids, _packed(x), codes, told], ["id", "label", "v", "code", "bound"])

    return rows.mapInArrow(run, schema)


def _sums(state: DataFrame, width: int) -> list[tuple[int, int, int, list[int]]]:
    """(part, entry, count, sums) of all assigned parts: a row a task and entry, added up by Spark."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, code = _unpacked(b.column("v"), PARTS * width).reshape(-1, PARTS, width), _by_part(b.column("code"), np.uint8, 1)
            for p in range(PARTS):
                count[p] += np.bincount(code[:, p, 0], minlength=ENTRIES)
                for k in range(width):  # a batch's sums of numbers under 2^28 are exact in a double
                    total[p, :, k] += np.bincount(code[:, p, 0], weights=x[:, p, k], minlength=ENTRIES).astype(np.int64)
        part, entry = np.nonzero(count)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "count", "sums"])

    told = state.select("v", "code").mapInArrow(run, "part int, entry int, count long, sums array<long>")
    added = F.array(*[F.sum(F.col("sums")[k]) for k in range(width)])
    return [tuple(r) for r in told.groupBy("part", "entry").agg(F.sum("count"), added).collect()]


def moved(books: list[Codebook], sums: list[tuple[int, int, int, list[int]]]) -> list[Codebook]:
    entries = [b.entries.copy() for b in books]
    for part, entry, count, total in sums:
        entries[part][entry] = [t // count for t in total]
    return [Codebook(e, b.group, np.sqrt(square(e, b.entries).astype(np.float64))) for e, b in zip(entries, books, strict=True)]


def integers(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, ints) of the rows that take part."""
    v = F.col(vector)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.when(F.forall("v", lambda x: F.abs(x) < LARGEST), F.col("v")).otherwise(F.raise_error(F.lit("a component of 2^20 or more")))
    rows = rows.where(sound).select(F.col(key).alias("id"), F.col(label).alias("label"), v.cast("array<double>").alias("v"))
    size = F.size("v")
    often = rows.where((size > 0) & (size % PARTS == 0)).groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(size == (often[0]["size"] if often else -1))
    return rows.select("id", "label", F.transform(fits, lambda x: F.floor(x * SCALE)).alias("ints"))


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code binary, error) of each vector, entries of each part's codebook)."""
    spark = rows.sparkSession
    ints = integers(rows, key, vector, label)
    start = np.array([r["ints"] for r in ints.orderBy(F.asc_nulls_last("id"), "ints").limit(ENTRIES).collect()], np.int64)
    if not len(start):
        return ints.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = start.shape[1] // PARTS
    books = []
    for p in range(PARTS):
        e = np.ascontiguousarray(start[:, p * width : (p + 1) * width])
        books.append(Codebook(e, grouped(e, GROUPS), np.zeros(len(e))))
    state, older = ints, None
    for _ in range(ROUNDS):
        write = Scratch(spark)
        state = write(_assigned(state, books, width, last=False))
        if older:
            older.drop()
        books, older = moved(books, _sums(state, width)), write
    found = materialise(_assigned(state, books, width, last=True))
    older.drop()
    return found, [b.entries for b in books]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(read(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    totals = materialise(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    both = found.join(small(totals), F.col("label").eqNullSafe(F.col("_label")))
    return both.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
