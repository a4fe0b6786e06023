"""Quality classifier: supervised subword embeddings in numpy.

A word's features are the word itself, its character n-grams (``GRAMS`` code
points of ``<word>``) and, where it repeats the word before it, one mark; each is
hashed to one of 2^``BITS`` buckets.  A document's vector is the average of the learned
vectors of all its features, and a softmax over the two labels reads it.  Both are
trained by stochastic gradient descent.

Since the output is linear in the average, a trained model is one number a bucket:
a document's logit is the mean of its features' numbers, so scoring takes each
distinct word once.  The score is shifted so that ``CUT`` is the cut with the best
balanced accuracy on a fifth of the training rows that the fit doesn't see.

Labels are learned from at most ``MAX_GOOD`` + ``MAX_POOR`` labelled rows (those whose
hashed id comes first, one text an id); every document is scored, over its whole text.

Defined cases: null and empty texts and texts without words have the average 0 and
get the score of the bias; equal texts get equal scores; a repeated label row counts
once, an id with both labels under both; an id with several texts takes part with
the least of them; null ids and labels other than 0 and 1 aren't learned from;
without training rows of both labels the score is the cut, so all are kept; other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, crc_mod, mix64, read, segment_sum, slices, tidy, words_of

MAX_GOOD, MAX_POOR = 2_500, 2_500
BITS, DIM, GRAMS, STEPS, BATCH, RATE = 18, 8, (3, 4), 500, 32, 4.0
LIMIT = 10.0  # no learned number leaves +-LIMIT, so that few or contradicting labels stay finite
CUT = 0.7
CACHE = 200_000
BLOCK = 20_000  # words whose features are found at a time
AGAIN = 0  # the bucket of the mark for a repeated word; no other feature has it


# -------------------------------------------------------------------- features


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the features of each word.

    A feature's hash sums its code points times powers of an odd number, in 64-bit
    integers; prefix sums give all n-grams of one size of all words in a pass.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    point = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(len(point))  # code points to the word's end, this one included
    base, powers = np.uint64(0x9E3779B97F4A7C15), [np.uint64(1)]
    found, whose = [], []
    mixed = mix64(point + np.uint64(1))
    with np.errstate(over="ignore"):
        for _ in range(max(GRAMS)):
            powers.append(powers[-1] * base)
        for n in GRAMS:
            start = np.flatnonzero(left >= n)
            total = np.zeros(len(start), np.uint64)
            for k in range(n):
                total += mixed[start + k] * powers[k]
            found.append(total + np.uint64(n))
            whose.append(owner[start])
        place = (np.arange(len(point)) - (ends - size)[owner]).astype(np.uint64)
        whole = np.add.reduceat(mix64(mixed + place * base), ends - size)
    found.append(whole)
    whose.append(np.arange(len(words)))
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    bucket = (mix64(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)[order]
    return np.maximum(bucket, AGAIN + 1), np.searchsorted(whose[order], np.arange(len(words) + 1))


def repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each document how many words equal the one before them."""
    same = np.zeros(len(codes), np.int64)
    same[1:] = codes[1:] == codes[:-1]
    same[offsets[:-1][offsets[:-1] < len(codes)]] = 0
    return segment_sum(same, offsets)


# ----------------------------------------------------------------------- model


class Model:
    """weight: a number a bucket (the learned vectors times the softmax's
    difference), bias and shift."""

    def __init__(self, weight: np.ndarray, bias: float, shift: float = 0.0):
        self.weight, self.bias, self.shift = weight, bias, shift
        self.seen = Remembered(CACHE)

    def __getstate__(self) -> tuple:
        return self.weight, self.bias, self.shift

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def of_words(self, words: list[str]) -> np.ndarray:
        """(sum of weights, number of features) of each word."""
        new = self.seen.new_of(set(words))
        for at in range(0, len(new), BLOCK):
            part = new[at : at + BLOCK]
            bucket, offsets = features(part)
            self.seen |= zip(part, zip(segment_sum(self.weight[bucket], offsets).tolist(), np.diff(offsets).tolist(), strict=True), strict=True)
        return np.array([self.seen[w] for w in words], dtype=float).reshape(-1, 2)

    def logits(self, texts: pa.Array) -> np.ndarray:
        words, codes, offsets = words_of(texts, lower=False)
        each, again = self.of_words(words.to_pylist()), repeats(codes, offsets)
        total = segment_sum(each[codes, 0], offsets) + again * self.weight[AGAIN]
        return total / np.maximum(segment_sum(each[codes, 1], offsets) + again, 1) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - self.shift + np.log(CUT / (1 - CUT)), -40, 40)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Model:
    """bags: (buckets, counts) of each document.  Both labels weigh the same."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = np.array([(labels == y).mean() for y in (0, 1)])
    weight = (0.5 / np.maximum(share, 1e-9))[labels].astype(np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    order = np.zeros(0, np.int64)
    for step in range(STEPS):
        while len(order) < BATCH:
            order = np.append(order, rng.permutation(len(bags)))
        pick, order = order[:BATCH], order[BATCH:]
        rate = np.float32(RATE * (1 - step / STEPS))
        used, back = np.unique(np.concatenate([bags[i][0] for i in pick]), return_inverse=True)
        part = np.zeros((len(pick), len(used)), np.float32)
        part[np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick]), back] = np.concatenate([bags[i][1] / bags[i][1].sum() for i in pick])
        rows = embed[used]
        mean = part @ rows
        z = mean @ out.T + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - target[pick]) * (weight[pick] / len(pick))[:, None]
        embed[used] = np.clip(rows - 10 * rate * (part.T @ (error @ out)), -LIMIT, LIMIT)
        out = np.clip(out - rate * (error.T @ mean), -LIMIT, LIMIT)
        bias -= rate * error.sum(axis=0) / 10
    return Model((embed @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the cuts with the best balanced accuracy; 0 without both labels."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    right = (np.append(0, np.cumsum(y == 0)) / (y == 0).sum() + np.append(np.cumsum(y[::-1])[::-1], 0) / y.sum()) / 2
    edge = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    top = edge[right >= right.max() - 1e-12]
    return float((top[0] + top[-1]) / 2)


def _compact(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words in blocks, which bounds what it needs at a time."""
    parts = [features(words.slice(k, BLOCK).to_pylist()) for k in range(0, len(words), BLOCK)]
    sizes = [np.diff(at) for _, at in parts]
    return np.concatenate([b.astype(np.int32) for b, _ in parts] or [np.zeros(0, np.int32)]), np.cumsum(np.concatenate([[0], *sizes]))


def train(texts: list[str | None], labels: np.ndarray, held: np.ndarray) -> Model | None:
    """held: rows kept out of the fit, for the cut."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels[~held].tolist())) < 2:
        return None
    words, codes, offsets = words_of(pa.array(texts, pa.string()), lower=False)
    bucket, at = _compact(words)
    again, bags = repeats(codes, offsets), []
    for i in np.flatnonzero(~held):
        own, times = np.unique(codes[offsets[i] : offsets[i + 1]], return_counts=True)
        size = at[own + 1] - at[own]
        flat = np.repeat(at[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        found, back = np.unique(np.append(bucket[flat], np.int32(AGAIN)), return_inverse=True)
        count = np.bincount(back, np.append(np.repeat(times, size), again[i]))
        bags.append((found[count > 0], count[count > 0].astype(np.float32)))
    model = fit(bags, labels[~held])
    rest = np.flatnonzero(held) if len(set(labels[held].tolist())) == 2 else np.flatnonzero(~held)
    model.shift = best_cut(model.logits(pa.array([texts[i] for i in rest], pa.string())), labels[rest])
    return model


# -------------------------------------------------------------------- operator


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Text, label and calibration flag of the bounded training sample."""
    order = F.xxhash64("doc_id", F.lit(12))
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    pick = [rows.where(F.col("quality") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, MAX_GOOD), (0, MAX_POOR))]
    chosen = pick[0].unionByName(pick[1]).withColumnRenamed("doc_id", "_of")  # bounded
    both = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_of"))
    one = both.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = one.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 0).orderBy("doc_id", "quality").toArrow()
    return got.column("text").to_pylist(), np.array(got.column("quality").to_pylist(), np.int64), np.array(got.column("held").to_pylist(), bool)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` added (replacing one of that name)."""
    rest = [c for c in docs.columns if c.lower() not in ("score", text.lower())]
    inner = docs.select(F.col(text).alias("_text"), F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row"))
    schema = inner.withColumn("score", F.lit(0.0)).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            found = model.scores(b.column("_text")) if model else np.full(b.num_rows, CUT)
            yield pa.RecordBatch.from_arrays([b.column("_text"), b.column("_row"), pa.array(found)], ["_text", "_row", "score"])

    made = inner.mapInArrow(run, schema)
    names = [c for c in docs.columns if c.lower() != "score"]
    return made.select(*[(F.col("_text") if c.lower() == text.lower() else F.col("_row")[c]).alias(c) for c in names], "score")


def quality(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """Every document with its ``score``, learned from the usable labels."""
    return score(docs, train(*labelled_sample(docs, labels, usable)))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 4) == 2
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, read(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
