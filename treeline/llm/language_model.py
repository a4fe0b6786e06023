"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Counting pass, over every training document: word counts (Arrow, pre-aggregated
in each slice, then summed by word).  They give the smoothed unigram score and
the model's outputs: the ``TOP`` most frequent words, the end token, and
``ENDINGS`` classes of all other words by a hash of their last letters.

The model predicts the class of a token from the two tokens before it: its score
is ``(p1 * R[c1] + p2 * R[c2]) . Q[w] + b[w]``.  It is fitted on the token
triples of all training documents against noise from the unigram distribution:
a pass counts the triples of classes, which are dealt by hash into ``1 + n / SHARD``
shards; in each of ``EPOCHS`` rounds every shard is passed through from the same
parameters, and the parameters are averaged by the shards' counts, ``FAN`` at a
time in tasks and the last ``FAN`` on the driver.  Shards depend on the counts
alone, not on the files, and hold about ``SHARD`` tokens each in a corpus of any
size.  A triple of count c stands ``sqrt(c)`` times, rounded up, in its shard and
weighs c in all.  Since the score
is a sum of a part of c1 and a part of c2, one product of two class-by-class
matrices gives the normaliser of every context, so every token's probability is
exactly normalised by table look-ups.  A word of an ending class then shares the
class's probability in proportion to its training count plus one (one unit is
left to unseen words).

Scoring pass: words among the ``HEAD`` most frequent have their counts at hand
(a bounded table); the others leave (word, row, n) and get theirs by a join with
the counts, summed back by row.  Nothing that grows is broadcast.

Defined cases: null and empty texts are the end token alone; repeated rows are
scored each; with no training rows all counts are 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash64, materialise, mix64, read, segment_sum, slices, tidy, words_of

TOP, ENDINGS, LETTERS = 1_000, 256, 2
HEAD = 50_000
SHARD, FAN = 1 << 21, 64
BUFFER = 1 << 22
DIM, NOISE, POOL, EPOCHS, BATCH, STEPS, RATE = 24, 10, 256, 3, 4096, 32, 0.15
END = ""  # no word is empty


class Classes:
    """Class of each word: 0 the end token, 1..len(top) own words, then endings."""

    def __init__(self, top: list[str]):
        self.own = {w: i + 1 for i, w in enumerate(top)} | {END: 0}
        self.first = len(top) + 1
        self.size = self.first + ENDINGS

    def of(self, words: pa.Array | list[str]) -> np.ndarray:
        """Own words are looked up together, and of all others each distinct ending is hashed once."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
        own = pc.index_in(words, pa.array(self.own, words.type))
        ends = pc.utf8_slice_codeunits(words, -LETTERS, None).dictionary_encode()
        named = hash64(ends.dictionary.to_pylist(), seed=5) % np.uint64(ENDINGS) if len(words) else np.zeros(0, np.uint64)
        code = named.astype(np.int64)[ends.indices.to_numpy()] + self.first
        number = np.fromiter(self.own.values(), np.int64, len(self.own))
        return np.where(own.is_valid().to_numpy(zero_copy_only=False), number[pc.fill_null(own, 0).to_numpy()], code)


class LogBilinear:
    NAMES = ("context", "target", "position", "bias")

    def __init__(self, share: np.ndarray, seed: int = 3):
        """share: unigram probability of each class (positive)."""
        rng = np.random.default_rng(seed)
        v = len(share)
        self.share = share
        self.context = rng.normal(0, 0.1, (v, DIM)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (v, DIM)).astype(np.float32)
        self.position = np.ones((2, DIM), np.float32)
        self.bias = np.log(share).astype(np.float32)
        self.speed = {n: np.full_like(getattr(self, n), 1e-3) for n in self.NAMES}

    def fit(self, triples: np.ndarray, weight: np.ndarray | None = None, seed: int = 5, epochs: int | None = None) -> None:
        """triples: (c2, c1, w) rows; weight: how often each stands (once). A pass takes
        ``STEPS`` steps at least, of ``BATCH`` rows at most; a row counts by its weight
        against the mean weight of all, whichever rows share its batch."""
        rng = np.random.default_rng(seed)
        weight = np.ones(len(triples), np.float32) if weight is None else weight.astype(np.float32)
        size = min(BATCH, max(1, len(triples) // STEPS))
        usual = weight.mean(dtype=np.float64) if len(weight) else 1.0
        cum = np.cumsum(self.share)
        log_noise = np.log(NOISE * self.share).astype(np.float32)

        def step(name: str, rows, grad: np.ndarray) -> None:
            value, s = getattr(self, name), self.speed[name]
            s[rows] += grad * grad
            value[rows] -= RATE * grad / np.sqrt(s[rows])

        def summed(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            return rows[start], np.add.reduceat(grad[order], start, axis=0)

        for _ in range(EPOCHS if epochs is None else epochs):
            order = rng.permutation(len(triples))
            for at in range(0, len(triples), size):
                c2, c1, w = triples[order[at : at + size]].T
                part = weight[order[at : at + size]] / np.float32(usual * len(w))
                noise = np.minimum(np.searchsorted(cum, rng.random(POOL) * cum[-1]), len(cum) - 1)  # shared by the batch
                r1, r2 = self.context[c1], self.context[c2]
                hidden = self.position[0] * r1 + self.position[1] * r2
                good = (hidden * self.target[w]).sum(axis=1) + self.bias[w] - log_noise[w]
                g_good = (1 / (1 + np.exp(-np.clip(good, -30, 30))) - 1).astype(np.float32) * part
                bad = hidden @ -self.target[noise].T
                bad -= self.bias[noise] - log_noise[noise]
                np.minimum(bad, 30, out=bad)
                np.exp(bad, out=bad)
                bad += 1
                np.divide(np.float32(NOISE / len(noise)), bad, out=bad)
                g_hidden = g_good[:, None] * self.target[w] + part[:, None] * (bad @ self.target[noise])
                rows = np.concatenate([w, noise])
                used, g = summed(rows, np.concatenate([np.c_[g_good[:, None] * hidden, g_good], np.c_[bad.T @ (part[:, None] * hidden), part @ bad]]))
                g_context = np.concatenate([g_hidden * self.position[0], g_hidden * self.position[1]])
                step("position", slice(None), np.stack([(g_hidden * r1).sum(axis=0), (g_hidden * r2).sum(axis=0)]))
                step("target", used, g[:, :-1])
                step("bias", used, g[:, -1])
                step("context", *summed(np.concatenate([c1, c2]), g_context))

    def state(self) -> np.ndarray:
        """All that is learnt, and the sums of squared gradients, as one vector."""
        return np.concatenate([x.ravel() for n in self.NAMES for x in (getattr(self, n), self.speed[n])])

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            for x in (getattr(self, n), self.speed[n]):
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural-log tables a[c1, w], b[c2, w] and the normaliser z[c1, c2]."""
        a = (self.context * self.position[0]) @ self.target.T
        b = (self.context * self.position[1]) @ self.target.T + self.bias
        top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = np.log(np.maximum(np.exp(a - top_a) @ np.exp(b - top_b).T, 1e-37)) + top_a + top_b.T
        return a, b, z


def triples(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts c2, c1 of each token; before a document stands the end token."""
    start = np.zeros(len(classes), bool)
    start[offsets[:-1]] = True
    c1 = np.concatenate(([0], classes[:-1])) if len(classes) else classes
    c1 = np.where(start, 0, c1)
    c2 = np.concatenate(([0], c1[:-1])) if len(classes) else classes
    return np.where(start, 0, c2), c1, classes


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, codes, offsets), the end token after every text."""
    words, codes, offsets = words_of(texts, lower=True)
    words = pa.concat_arrays([words, pa.array([END], words.type)])
    codes = np.insert(codes, offsets[1:], len(words) - 1)
    return words, codes, offsets + np.arange(len(offsets))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.RecordBatch:
            coded = pa.concat_arrays([w for w, _ in kept]).dictionary_encode()
            total = np.bincount(coded.indices.to_numpy(), np.concatenate([c for _, c in kept]), len(coded.dictionary))  # exact below 2^53
            kept.clear()
            return pa.RecordBatch.from_arrays([pc.cast(coded.dictionary, pa.string()), pa.array(total.astype(np.int64))], ["word", "c"])

        kept: list[tuple[pa.Array, np.ndarray]] = []
        held = 0
        for b in slices(batches, "text", 4 << 20):
            words, codes, _ = tokens(b.column("text"))
            kept.append((words, np.bincount(codes, minlength=len(words))))
            held += len(words)
            if held > 500_000:
                yield summed()
                held = 0
        if kept:
            yield summed()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code)
    code = code[order]
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[start], np.add.reduceat(count[order], start)


def triple_counts(docs: DataFrame, text: str, classes: Classes, shards: int) -> DataFrame:
    """(shard, code, count), written: the distinct class triples of all rows as
    packed numbers, in one row a shard. A task sends a shard one array for every
    ``BUFFER`` triples. All arrays together have no more entries than there are
    tokens and codes are dealt by hash, so with ``1 + n / SHARD`` shards one gathers
    about ``SHARD`` entries of 16 bytes, however large the corpus."""
    v = classes.size
    names = ["shard", "code", "count"]

    def packed(shard: np.ndarray, code: list[np.ndarray], c: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (code, c))], names)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            code, c = merged([x for x, _ in kept], [x for _, x in kept])
            kept.clear()
            shard = (mix64(code) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            used, start = np.unique(shard[order], return_index=True)
            return packed(used, np.split(code[order], start[1:]), np.split(c[order], start[1:]))

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for b in slices(batches, "text", 4 << 20):
            words, codes, offsets = tokens(b.column("text"))
            c2, c1, w = triples(classes.of(words)[codes], offsets)
            kept.append(np.unique((c2 * v + c1) * v + w, return_counts=True))
            held += len(kept[-1][0])
            if held >= BUFFER:
                yield flush()
                held = 0
        if kept:
            yield flush()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        code, c = merged(*[[np.frombuffer(x.as_buffer(), np.int64) for x in rows.column(n)] for n in names[1:]])
        return pa.Table.from_batches([packed(np.array([key[0].as_py()]), [code], [c])])

    schema = "shard long, code binary, count binary"
    return materialise(docs.select(F.col(text).alias("text")).mapInArrow(count, schema).groupBy("shard").applyInArrow(pack, schema))


def mean_state(rows: pa.Table) -> tuple[int, np.ndarray]:
    """Tokens, and the mean by tokens, of rows (shard, n, state)."""
    rows = rows.sort_by("shard")
    n = rows.column("n").to_numpy()
    total: np.ndarray | float = 0.0
    for k, state in zip(n / n.sum(), rows.column("state"), strict=True):
        total = total + k * np.frombuffer(state.as_buffer(), np.float32)
    return int(n.sum()), total


def fit_all(net: LogBilinear, shards: DataFrame, n: int) -> None:
    """Fit to all triples in ``n`` shards: rounds over every shard, then the mean by counts."""
    v = len(net.share)

    @tidy
    def one_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = net.state()
        for b in batches:
            for shard, code, count in zip(*b.columns, strict=True):
                code, c = (np.frombuffer(x.as_buffer(), np.int64) for x in (code, count))
                times = np.ceil(np.sqrt(c)).astype(np.int64)
                at = np.repeat(np.arange(len(c), dtype=np.int32), times)
                rows = np.stack([code // (v * v), code // v % v, code % v], axis=1).astype(np.int16)[at]
                net.restore(start)
                net.fit(rows, (c / times)[at], seed=shard.as_py() * EPOCHS + turn, epochs=1)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([net.state().tobytes()], pa.binary())], ["shard", "n", "state"])
                pa.default_memory_pool().release_unused()

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        tokens_, state = mean_state(rows)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([tokens_], pa.int64()), pa.array([state.astype(np.float32).tobytes()], pa.binary())], ["shard", "n", "state"])

    schema = "shard long, n long, state binary"
    for turn in range(EPOCHS):
        got, left = shards.mapInArrow(one_round, schema), n
        while left > FAN:
            left = -(-left // FAN)
            got = got.groupBy(F.expr(f"shard div {FAN}").alias("mean")).applyInArrow(mean, schema)
        net.restore(mean_state(got.toArrow())[1])


class Model:
    """What the scoring pass needs; all of bounded size."""

    def __init__(self, head: dict[str, int], top: list[str], n: int, v: int, mass: dict[int, tuple[int, int]], net: LogBilinear | None = None):
        self.head, self.classes, self.n, self.v, self.net = head, Classes(top), n, v, net
        #: log10 of each ending class's denominator.
        self.below = np.zeros(self.classes.size)
        for k in range(self.classes.first, self.classes.size):
            count, kinds = mass.get(k, (0, 0))
            self.below[k] = np.log10(count + kinds + 1)


def learn(docs: DataFrame, usable: Column, key: str, text: str) -> tuple[Model, DataFrame]:
    """The model, and the table of all training counts."""
    training = docs.where(usable)
    counts = materialise(word_counts(training, text))
    n, v, docs_seen = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("c")))).first()
    n, v, docs_seen = n or 0, v or 0, docs_seen or 0
    most = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head = dict(zip(most.column("word").to_pylist(), most.column("c").to_pylist(), strict=True))
    top = list(head)[:TOP]
    classes = Classes(top)

    @tidy
    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = classes.of(b.column("word"))
            c = b.column("c").to_numpy(zero_copy_only=False)
            used = np.unique(k)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.bincount(k, c, classes.size)[used].astype(np.int64)), pa.array(np.bincount(k, minlength=classes.size)[used])], ["k", "c", "n"])

    rows = counts.mapInArrow(by_class, "k long, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    mass = {r["k"]: (r["c"], r["n"]) for r in rows}
    model = Model(head | {END: docs_seen}, top, n, v, mass)

    share = np.array([mass.get(k, (0, 0))[0] + 1.0 for k in range(classes.size)])
    model.net = LogBilinear(share / share.sum())

    if n:
        shards = 1 + n // SHARD
        fit_all(model.net, triple_counts(training, text, classes, shards), shards)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str, text: str, flag: Column) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b_, z = model.net.tables()
        row = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
        head, at_hand = pa.array(model.head, pa.large_string()), np.array([*model.head.values(), -1], np.int64)
        ln10 = np.log(10.0)
        for b in slices(batches, "text", 2 << 20):
            words, codes, offsets = tokens(b.column("text"))
            c = at_hand[pc.fill_null(pc.index_in(words, head), len(head)).to_numpy()]
            k = model.classes.of(words)
            inside = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0.0)[codes]
            rare = (k >= model.classes.first)[codes]
            c2, c1, w = triples(k[codes], offsets)
            net = (a[c1, w].astype(np.float64) + b_[c2, w] - z[c1, c2]) / ln10
            own = net + np.where(rare, inside - model.below[w], 0.0)
            out = c[codes] < 0
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            pair, times = np.unique(doc[out] * len(words) + codes[out], return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(offsets)) * len(words))
            tail = pa.StructArray.from_arrays([pc.cast(words.take(pa.array(pair % len(words))), pa.string()), pa.array(times.astype(np.int64))], ["word", "n"])
            size = np.diff(offsets)
            sums = [segment_sum(x, offsets) for x in ((c[codes] > 0).astype(np.int64), inside, own)]
            columns = [b.column("key"), b.column("held"), pa.array(np.arange(row, row + b.num_rows)), pa.array(size), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["key", "held", "row", "size", "known", "inside", "own", "tail"])

    narrow = docs.select(docs[key].alias("key"), flag.alias("held"), docs[text].alias("text"))
    made = materialise(narrow.mapInArrow(run, f"key {kind}, held boolean, row long, size long, known long, inside double, own double, tail array<struct<word:string,n:long>>"))
    tail = made.select("row", F.inline("tail")).join(counts, "word", "left")
    found = tail.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rest"))
    rest = F.coalesce("rest", F.lit(0.0))
    return made.select("key", "held", "row", "size", "known", "inside", "own").join(found, "row", "left").select(
        F.col("key").alias(key), F.col("held").alias("held_out"), F.col("size").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("inside") + rest - F.col("size") * float(np.log10(model.n + model.v + 1))).alias("base_score"), (F.col("own") + rest).alias("score"),
    )


def lm_scores(docs: DataFrame, usable: Column, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    model, counts = learn(docs, usable, key, text)
    return score(docs, model, counts, key, text, held)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 7) == 2
    return lm_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held, held)
