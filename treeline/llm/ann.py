"""Nearest neighbours by an inverted multi-index (largest inner product).

Equal vectors are one entry with its ``NEAR + 1`` least ids, which is all that a
result can need.  The two halves of a vector are quantised separately (k-means in
numpy on at most ``TRAIN`` entries, a bounded sample); an entry's cell is its pair
of centroids, and the counts of all cells (at most 256 x 256) go to the driver.

A query takes pairs of centroids by descending sum of the two inner products,
with a heap over the two sorted lists, until they hold its share of all entries;
the sum of the last pair is its limit.  That share is calibrated: for ``PROBES``
query vectors the true neighbours are found by brute force over all entries, and
the share is the least that finds ``AIM`` of them.  So clustered data visits few
entries, and data without structure as many as the recall needs.

Entries stand on shelves of about ``CHUNK``, each of a few first centroids (a large
one has several shelves).  A query goes once to every shelf with a cell it visits,
and a shelf only to the parts of the queries that visit it; shelves and parts follow
the counts, so no group grows with the input.  Within a group the entries of visited
cells are reranked on the original vectors in double precision.

Defined cases: vectors that are null, empty, zero, of another length than most,
or that hold null or non-finite components take no part; ties go to the smaller
id; repeated rows of one id count once; with fewer candidates all are returned;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, small, tidy

NEAR = 20
TRAIN, PROBES, AIM = 20_000, 96, 0.95
MOST = 256
CHUNK = 16_384


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector takes part, as doubles."""
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(sound)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["size"] if size else 0))


def entries(rows: DataFrame) -> DataFrame:
    """(v, ids): distinct vectors as bytes with their least ids.  A task first
    keeps the least ids of what it reads, so a hot vector sends few rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.list_(pa.int64()))], ["v", "ids"])

        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
            width = len(flat) // max(b.num_rows, 1)
            for i, x in zip(b.column("id").to_pylist(), flat.reshape(-1, width), strict=True):
                own = seen.setdefault(x.tobytes(), [])
                if i not in own and (len(own) <= NEAR or i < own[-1]):
                    own.append(i)
                    own.sort()
                    del own[NEAR + 1 :]
            if len(seen) > 50_000:
                yield told()
                seen = {}
        if seen:
            yield told()

    part = rows.mapInArrow(run, "v binary, ids array<long>")
    return part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, NEAR + 1).alias("ids"))


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        near = _nearest(x, centre)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centre.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class MultiIndex:
    """Centroids of both halves, counts of cells, and the share to visit."""

    def __init__(self, sample: np.ndarray, k: int):
        self.cut = sample.shape[1] // 2
        self.first = _k_means(sample[:, : self.cut], k, 1)
        self.second = _k_means(sample[:, self.cut :], k, 2)
        self.count = np.zeros((k, k), np.int64)
        self.goal = 0

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x[:, : self.cut], self.first), _nearest(x[:, self.cut :], self.second)

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut] @ self.first.T, x[:, self.cut :] @ self.second.T

    def visit(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Pairs by descending sum: a heap holds, of each started row, its best pair left."""
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
        while heap:
            s, i, j = heapq.heappop(heap)
            yield int(a[i]), int(b[j]), -s
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(one[a[i + 1]] + two[b[0]]), i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (-(one[a[i]] + two[b[j + 1]]), i, j + 1))

    def limit(self, one: np.ndarray, two: np.ndarray) -> tuple[float, list[int]]:
        """Sum of the last pair visited, and the first centroids visited."""
        held, rows, last = 0, set(), float("inf")
        for i, j, s in self.visit(one, two):
            if held >= self.goal and s < last:
                break
            if self.count[i, j]:
                held += int(self.count[i, j])
                rows.add(i)
            last = s
        return last, sorted(rows)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def _best(scores: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each row's ``near`` best visible entries; scores
    (single precision, -inf if not visible) only preselect."""
    k = min(near, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    size = np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0)
    q, e = np.nonzero((scores >= np.where(np.isfinite(floor), floor - 1e-5 * size, -np.inf)[:, None]) & np.isfinite(scores))
    exact = np.concatenate([(queries[q[i : i + 65536]] * vectors[e[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    many = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(many.sum()))
    begin = np.cumsum(many) - many
    rep = many[e]
    at = np.repeat(begin[e] - (np.cumsum(rep) - rep), rep) + np.arange(int(rep.sum()))
    q, exact, found = np.repeat(q, rep), np.repeat(exact, rep), flat[at]
    order = np.lexsort((found, -exact, q))
    q, exact, found = q[order], exact[order], found[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < near
    return q[keep], found[keep], exact[keep]


def _calibrated(index: MultiIndex, table: DataFrame, probes: list[bytes]) -> int:
    """Least number of entries to visit that finds AIM of the probes' neighbours."""
    q = np.frombuffer(b"".join(probes), dtype=np.float64).reshape(len(probes), -1)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            s = q @ x.T
            k = min(NEAR + 1, s.shape[1])
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), k)), pa.array(np.take_along_axis(s, top, axis=1).ravel()), b.column("c1").take(pa.array(top.ravel())), b.column("c2").take(pa.array(top.ravel()))], ["q", "s", "c1", "c2"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c1", "c2"))
    best = table.select("v", "c1", "c2").mapInArrow(run, "q long, s double, c1 int, c2 int").withColumn("r", rank).where(F.col("r").between(2, NEAR + 1)).collect()
    one, two = index.sums(q)
    need = []
    for i in range(len(q)):
        wanted = [(r["c1"], r["c2"]) for r in best if r["q"] == i]
        held, reached = 0, {}
        for a, b, _ in index.visit(one[i], two[i]):
            held += int(index.count[a, b])
            reached[a, b] = held
        need += [reached[c] for c in wanted]
    need.sort()
    return need[min(len(need) - 1, int(AIM * len(need)))] if need else 1


def _shelves(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """First shelf of each first centroid, and over how many shelves its entries are
    dealt: centroids share shelves of about ``CHUNK`` entries, large ones have several."""
    base, spread, held = [], [], 0
    shelf = 0
    for n in counts.tolist():
        if n > CHUNK:
            if held:
                shelf, held = shelf + 1, 0
            base.append(shelf)
            spread.append(-(-n // CHUNK))
            shelf += spread[-1]
            continue
        if held and held + n > CHUNK:
            shelf, held = shelf + 1, 0
        base.append(shelf)
        spread.append(1)
        held += n
    return base, spread


def nearest(rows: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", near: int = NEAR) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``asks``
    holds, a condition on the long column ``id``."""
    spark = rows.sparkSession
    sound = materialise(_usable(rows.where(F.col(key).isNotNull()), key, vector))
    table = materialise(entries(sound))
    schema = "query_id long, rank int, vec_id long, score double"
    n = table.count()
    if not n:
        return spark.createDataFrame([], schema)
    sample = _matrix(table.orderBy(F.xxhash64("v")).limit(TRAIN).select("v").toArrow().column("v"))
    index = MultiIndex(sample, int(np.clip(int(n**0.5 / 3), 1, min(MOST, len(sample)))))

    @tidy
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c1, c2 = index.cells(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], ["v", "ids", "c1", "c2"])

    table = materialise(table.mapInArrow(placed, "v binary, ids array<long>, c1 int, c2 int"))
    for r in table.groupBy("c1", "c2").count().collect():
        index.count[r["c1"], r["c2"]] = r["count"]

    @tidy
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False) + 0.0
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in flat.reshape(b.num_rows, -1)], pa.binary())], ["id", "v"])

    queries = materialise(sound.where(asks).mapInArrow(packed, "id long, v binary").distinct())
    wanted = materialise(queries.select("v").distinct())
    total = wanted.count()
    probes = [bytes(r["v"]) for r in wanted.orderBy(F.xxhash64("v")).limit(PROBES).collect()]
    if not probes:
        return spark.createDataFrame([], schema)
    index.goal = _calibrated(index, table, probes)
    base, spread = _shelves(index.count.sum(axis=1))
    parts = max(1, -(-total // CHUNK))

    @tidy
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                one, two = index.sums(_matrix(b.column("v")))
                told = [index.limit(one[i], two[i]) for i in range(b.num_rows)]
                out = [(i, limit, s) for i, (limit, used) in enumerate(told) for s in sorted({base[c] + e for c in used for e in range(spread[c])})]
                pick, limits, shelf = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("v").take(pa.array(pick)), pa.array(limits), pa.array(shelf, pa.int32()), b.column("part").take(pa.array(pick))], ["v", "limit", "shelf", "part"])

    dealt = wanted.repartition(min(-(-total // 64), 4 * spark.sparkContext.defaultParallelism), "v")  # one small file else
    routes = materialise(dealt.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")).mapInArrow(routed, "v binary, limit double, shelf int, part int"))
    visited = small(materialise(routes.select("shelf", "part").distinct()))
    at = lambda list_: F.get(F.array(*map(F.lit, list_)), F.col("c1"))
    shelves = table.withColumn("shelf", (at(base) + F.pmod(F.xxhash64("v", F.lit(1)), at(spread))).cast("int")).join(visited, "shelf")

    def rerank(group: tuple, shelf: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if shelf.num_rows and asked.num_rows:
            x, q = _matrix(shelf.column("v")), _matrix(asked.column("v"))
            x32, ids, limit = x.astype(np.float32).T, shelf.column("ids").to_pylist(), asked.column("limit").to_numpy()
            c1, c2 = shelf.column("c1").to_numpy(), shelf.column("c2").to_numpy()
            for at in range(0, len(q), 256):
                one, two = index.sums(q[at : at + 256])
                s = q[at : at + 256].astype(np.float32) @ x32
                s[one[:, c1] + two[:, c2] < limit[at : at + 256, None] - 1e-12] = -np.inf
                r, found, exact = _best(s, q[at : at + 256], x, ids, near + 1)
                out.append(pa.table({"v": asked.column("v").take(pa.array(r + at)).combine_chunks(), "id": found, "score": exact}))
        return pa.concat_tables(out) if out else pa.table({"v": pa.array([], pa.binary()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    by = ["shelf", "part"]
    partial = shelves.groupBy(*by).cogroup(routes.groupBy(*by)).applyInArrow(rerank, "v binary, id long, score double")
    order = [F.desc("score"), "id"]
    best = materialise(partial.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(*order))).where(F.col("r") <= near + 1).drop("r"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    own = asked.join(best, asked.qv == best.v).where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return own.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= near)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
