"""Near duplicates by HyperMinHash.

A document's set are the 64-bit hashes of its distinct word shingles (``shingle``
words; texts with fewer words: all of them as one).  The leading bits of a hash
choose one of ``BUCKETS`` buckets; of the least remaining value in each bucket a
16-bit register keeps the number of leading zeros and ``MANTISSA`` bits after the
leading one.  Empty buckets copy the register of a bucket that a hash sequence of
their own number finds (densification), so short texts band like long ones.

Candidates share a band of ``ROWS`` registers.  Among texts with equal sets only
the one with the least id goes on.  A bucket of a band is represented by its hub,
the member that shares most buckets, and every member is first paired with the
hubs of its buckets: a star, so that a large group of near copies costs its size.
Pairs pass if the Jaccard similarity estimated from equal registers, corrected for
chance collisions, is within six standard errors of the threshold, and are then
verified on the full sets.

Two texts of one bucket share its hub, so what the stars left in different
components is found among the members of each hub: those outside its largest
component are held against all of its members, first by estimate, then on the full
sets.  This is done in blocks of about ``BLOCK`` set elements, inside the tasks: a
hub's members are dealt into blocks, a cell holds a block of outsiders and a block
of members, and a cell gives one link at most per outsider and component.  Rows
grow with the members (times the number of a hub's outsider blocks), never with
pairs, and groups of every size are treated alike.

A pair at the threshold shares no band with probability (1 - 0.8^6)^42 < 3e-6.

Defined cases: null, empty and blank texts have an empty set and stand alone;
repeated rows are one node; a null id stands alone or belongs to its copies'
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash64, materialise, mix64, read, slices, small, tidy, words_of
from .components import components

BUCKET_BITS, MANTISSA = 8, 10
BUCKETS = 1 << BUCKET_BITS
REST = 64 - BUCKET_BITS
ROWS = 6
BANDS = BUCKETS // ROWS
TRIES = 64
#: Set elements of a block; a cell compares two blocks.
BLOCK = 1 << 16
#: So many ids of candidate documents may be broadcast (8 bytes each).
NAMED = 2_000_000


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and row offsets."""
    words, codes, offsets = words_of(texts, lower=True)
    word = hash64(words.to_pylist())[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(offsets)
    take = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    row = np.repeat(np.arange(len(count)), take)
    at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + offsets[:-1][row]
    value = np.zeros(len(row), np.uint64)
    for k in range(size):
        inside = k < count[row]  # short texts: their words only
        next_word = word[np.minimum(at + k, max(len(word) - 1, 0))]
        value = np.where(inside, mix64(value * np.uint64(0x9E3779B97F4A7C15) + next_word + np.uint64(k + 1)), value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def registers(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) HyperMinHash registers; texts without shingles are 0."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    bucket = (value >> np.uint64(REST)).astype(np.int64)
    first = np.ones(len(value), bool)  # values are sorted, so the first of a bucket is its least
    first[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    least = value[first] & np.uint64((1 << REST) - 1)
    length = np.frexp((least >> np.uint64(3)).astype(np.float64))[1] + 3
    zeros = np.minimum(REST - length, 62).astype(np.uint64)
    mantissa = ((least << (zeros + np.uint64(1))) & np.uint64((1 << REST) - 1)) >> np.uint64(REST - MANTISSA)
    out = np.zeros((n, BUCKETS), np.int64)
    out[row[first], bucket[first]] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.int64) + 1
    full = out > 0
    some = full.any(axis=1)
    todo, place = np.nonzero(~full & some[:, None])
    for k in range(TRIES):
        if not len(todo):
            break
        source = (mix64(place.astype(np.uint64) * np.uint64(1024) + np.uint64(k + 1)) >> np.uint64(REST)).astype(np.int64)
        hit = full[todo, source]
        out[todo[hit], place[hit]] = out[todo[hit], source[hit]]
        todo, place = todo[~hit], place[~hit]
    for t, p in zip(todo.tolist(), place.tolist(), strict=True):
        own = np.flatnonzero(full[t])
        out[t, p] = out[t, own[np.searchsorted(own, p) % len(own)]]
    return out.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys of the bands."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(regs), BANDS))
    cut = regs[:, : BANDS * ROWS].astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return key.view(np.int64)


def zeros_law(n: np.ndarray) -> np.ndarray:
    """(sets, REST): probability of each number of leading zeros in a register of a
    set of n elements."""
    i, lam = np.arange(REST), np.maximum(n, 1)[:, None] / BUCKETS
    return (np.exp(-lam * 2.0 ** -(i + 1)) - np.exp(-lam * 2.0**-i)) / -np.expm1(-lam)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of these sizes are equal."""
    return (zeros_law(n_a) * zeros_law(n_b)).sum(axis=1) / (1 << MANTISSA)


def register_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


def sketch(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, digest, regs) of every document; its size doesn't depend on the texts'."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, "text"):
            value, offsets = shingle_sets(b.column("text"), size)
            regs = registers(value, offsets)
            digest = [xxhash.xxh3_128_digest(value[a:z].tobytes()) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offsets)), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "n", "digest", "regs"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, digest binary, regs binary")


def full_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, grams): a document's sorted set, 48 bits of each hash (enough to compare two sets)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            value, offsets = shingle_sets(b.column("text"), size)
            raw = value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            grams = [raw[6 * a : 6 * z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(grams, pa.binary())], ["id", "grams"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, grams binary")


def _only(rows: DataFrame, pairs: DataFrame, write: Scratch, key: str = "id") -> DataFrame:
    """The rows that some pair names: by a broadcast of their ids if these are
    few enough, else by a shuffle."""
    ids = write(pairs.select(F.col("a").alias("_of")).distinct().union(pairs.select("b").distinct()).distinct())
    return rows.join(small(ids, NAMED), F.col(key) == F.col("_of"), "left_semi")


def bands(nodes: DataFrame) -> DataFrame:
    """(key, id, n) of every band of every node."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                regs = register_rows(b.column("regs"))
                keys = band_keys(regs)
                pick = pa.array(np.repeat(np.arange(len(regs)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column("id").take(pick), b.column("n").take(pick)], ["key", "id", "n"])

    return nodes.select("id", "n", "regs").mapInArrow(run, "key long, id long, n long")


def least_estimate(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The threshold less six standard errors of the estimate."""
    return percent / 100 - 6 * np.sqrt(0.25 / np.minimum(np.minimum(n_a, n_b), BUCKETS))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, write: Scratch) -> DataFrame:
    """Pairs (a, b) whose estimated similarity may reach the threshold."""
    named = _only(nodes, pairs, write)
    side = lambda x: named.select(F.col("id").alias(x), F.col("regs").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                r = [register_rows(b.column(c)) for c in ("r_a", "r_b")]
                n = [b.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]
                p = chance(*n)
                found = ((r[0] == r[1]).mean(axis=1) - p) / (1 - p)
                yield b.select(["a", "b"]).filter(pa.array(found >= least_estimate(*n, percent)))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets
    (repeated rows of an id repeat its pairs, which does no harm)."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("grams").alias(f"g_{x}"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            last, one = None, frozenset()
            for x, y in zip(b.column("g_a"), b.column("g_b"), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, one = x, np.frombuffer(x, dtype="S6")
                two = np.frombuffer(y, dtype="S6")
                small, large = (one, two) if len(one) <= len(two) else (two, one)
                at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                both = int((large[at] == small).sum()) if len(large) else 0
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "g_a", "g_b")
    return both.mapInArrow(run, "a long, b long")


def _near_size(a: str, b: str, percent: int):
    """Sets further apart in size can't be similar enough."""
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _verify(pairs: DataFrame, nodes: DataFrame, sets_of, percent: int, write: Scratch) -> DataFrame:
    some = write(likely(pairs, nodes, percent, write))
    sets = write(sets_of(some))
    return write(confirmed(some, sets, percent))


def linked_in_cell(rows: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links of one cell: outsiders with members of other components, one for each
    outsider and component.  Columns: role (true: outsider), out (outside the
    hub's largest component), id, part, n, regs, grams."""
    rows = rows.combine_chunks()
    role = rows.column("role").to_numpy()
    who, of = np.flatnonzero(role), np.flatnonzero(~role)
    if not len(who) or not len(of):
        return [], []
    ids, part, n, out = (rows.column(c).to_numpy() for c in ("id", "part", "n", "out"))
    regs = register_rows(rows.column("regs"))
    grams = rows.column("grams").to_pylist()
    ends = np.cumsum([0] + [len(g) // 6 for g in grams])
    wide = np.zeros((ends[-1], 8), np.uint8)
    wide[:, 2:] = np.frombuffer(b"".join(grams), np.uint8).reshape(-1, 6)
    codes = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)[1].ravel()
    seen = np.zeros(len(codes), bool)
    law = zeros_law(n)
    n_of, part_of, ids_of, regs_of = n[of], part[of], ids[of], regs[of]
    a, b = [], []
    for i in who.tolist():
        p = law[of] @ law[i] / (1 << MANTISSA)
        near = (part_of != part[i]) & (100 * np.minimum(n_of, n[i]) >= percent * np.maximum(n_of, n[i])) & (~out[of] | (ids_of > ids[i]))
        near[near] = ((regs_of[near] == regs[i]).mean(axis=1) - p[near]) / (1 - p[near]) >= least_estimate(n_of[near], n[i], percent)
        some = np.flatnonzero(near)
        if not len(some):
            continue
        own = codes[ends[i] : ends[i + 1]]
        seen[own] = True
        both = np.array([np.count_nonzero(seen[codes[ends[k] : ends[k + 1]]]) for k in of[some].tolist()])
        seen[own] = False
        hit = some[100 * both >= percent * (n_of[some] + n[i] - both)]
        for k in hit[np.unique(part_of[hit], return_index=True)[1]].tolist():
            a.append(min(ids[i], ids_of[k]))
            b.append(max(ids[i], ids_of[k]))
    return a, b


def across(group: DataFrame, nodes: DataFrame, sets_of, percent: int, write: Scratch) -> DataFrame:
    """Links (a, b) between components among the members of one hub.

    group: (hub, id, n, part)."""
    parts = group.groupBy("hub", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = parts.groupBy("hub").agg(F.max(F.struct("c", "s", "part")).alias("top"), F.sum("s").alias("s"), F.count("*").alias("parts"))
    blocks = lambda s: F.ceil(s / F.lit(BLOCK)).cast("int")
    mixed = write(whole.where("parts > 1").select("hub", F.col("top.part").alias("most"), blocks(F.col("s") - F.col("top.s")).alias("i_blocks"), blocks(F.col("s")).alias("j_blocks")))
    rows = write(group.join(mixed, "hub").withColumn("out", F.col("part") != F.col("most")))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asking = rows.where("out").select("hub", "id", "part", "out", F.lit(True).alias("role"), block(F.col("i_blocks"), 1).alias("i"), every(F.col("j_blocks")).alias("j"))
    asked = rows.select("hub", "id", "part", "out", F.lit(False).alias("role"), block(F.col("j_blocks"), 2).alias("j"), every(F.col("i_blocks")).alias("i"))
    sets = write(sets_of(rows.select(F.col("id").alias("a"), F.col("hub").alias("b"))))
    told = write(nodes.join(sets, "id"))
    cells = asking.unionByName(asked).join(told, "id")

    def run(cell: pa.Table) -> pa.Table:
        a, b = linked_in_cell(cell, percent)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return write(cells.groupBy("hub", "i", "j").applyInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; ids are longs."""
    write = Scratch(docs.sparkSession)
    every = write(sketch(docs, key, text, shingle))
    sets = every.where("n > 0")
    copies = write(sets.groupBy("digest").agg(F.min("id").alias("head")))
    firsts = copies.select(F.col("head").alias("id"), "digest")
    nodes = write(sets.join(firsts, ["id", "digest"], "left_semi").drop("digest"))

    member = bands(nodes)
    shared = write(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    member = write(member.join(shared, "key"))
    weight = write(member.groupBy("id").agg(F.sum("size").alias("weight")))
    ranked = member.join(weight, "id")
    hub = write(ranked.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n")).alias("top")).select("key", (-F.col("top.minus")).alias("hub"), F.col("top.n").alias("n_hub")))
    group = write(member.join(hub, "key").select("hub", "n_hub", "id", "n").distinct())
    star = group.where((F.col("id") != F.col("hub")) & _near_size("n", "n_hub", percent))
    pairs = write(star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    sets_of = lambda some: full_sets(_only(docs.select(key, text), some, write, key), key, text, shingle)
    links = _verify(pairs, nodes, sets_of, percent, write)
    label = components(links, write)

    apart = write(group.join(label, "id", "left").select("hub", "id", "n", F.coalesce("label", "id").alias("part")))
    more = across(apart, nodes, sets_of, percent, write)
    if not more.isEmpty():
        label = components(links.unionByName(more), write)

    rep = materialise(copies.join(label, copies["head"] == label["id"], "left").select("digest", F.coalesce("label", "head").alias("least")))
    told = materialise(every.select("id", "n", "digest"))
    write.drop()
    out = told.join(rep, "digest", "left")
    component = F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)
