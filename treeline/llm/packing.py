"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Tokenising: white space only separates tokens of the vocabulary, so a batch's
distinct words are encoded once, many in one call, and each document's ids are gathered from them.
The vocabulary folds case, and a tail of ASCII punctuation after a letter or
digit is a pre-token of its own, so such words share the parts' encodings.
Documents longer than a sequence are cut into full pieces and a rest.

Packing: pieces are dealt by hash into groups of about ``GROUP`` pieces, and each
group is packed by the sum-of-squares rule: with ``N[g]`` open sequences that
have ``g`` free places, a piece of length s goes where the sum of all ``N[g]``
squared becomes smallest: into a sequence with gap g (which then has g - s), or
into a new one.  Within a group longer pieces come first.  The number of groups
follows the number of pieces, so no task grows with the input.

Defined cases: null text is the empty text, whose only id is the end id; equal
rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, listed, materialise, read, slices, tidy, words_of

LENGTH = 2048
END_ID = 0
GROUP = 8_000
#: Parts of words, and words as they stand, whose ids a worker remembers while it works on a partition (about 200 bytes each); half at most stay for the next.
CACHE, WORDS = 60_000, 120_000
#: Bytes of text that are encoded together: their distinct words are the most of a worker's memory.
BATCH = 1 << 20
#: A letter or digit ends the word before a tail of this punctuation.
LETTERS = frozenset(re.findall("[A-Za-z0-9À-ÖØ-öø-ÿ]", "".join(map(chr, range(256)))))
PUNCTUATION = "".join(re.findall(r"[!-/:-@\[-`{-~]", "".join(map(chr, range(128)))))
#: Letters that are small, composed, and one symbol or two of the model's bytes.
PLAIN = "".join(re.findall("[a-zß-öø-ÿ]", "".join(map(chr, range(256)))))
#: What stands between words that are encoded together, and how many these are.
MARK, JOINED = "~", 1_000


class WordEncoder:
    """Ids of whole texts from the ids of their distinct words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.seen, self.whole = Remembered(CACHE), Remembered(WORDS)
        self.mark = self._ids([MARK])[0]
        piece = lambda s: "".join(p for p, _ in self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(s)))
        self.bytes = str.maketrans({c: piece(c) for c in PLAIN if not c.isascii()})
        #: The model's own symbols stand for a word of these letters, which neither the normaliser nor the pre-tokeniser changes.
        self.plain = re.compile(f"[{PLAIN}]+" if all(piece(c + d) == (c + d).translate(self.bytes) for c in PLAIN for d in PLAIN) else "(?!)").fullmatch

    def rest(self) -> None:
        """Between partitions only the newer halves stay: Spark keeps workers, and their memory, for as long as the job runs."""
        self.seen.forget()
        self.whole.forget()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words. Most are encoded as the words of one text, with ``MARK`` after
        each, whose one id no word without that character has."""
        plain, tokenize = self.plain, self.model.model.tokenize
        other = []
        for w in words:
            if plain(w):
                self.seen[w] = array("I", [x.id for x in tokenize(w if w.isascii() else w.translate(self.bytes))]).tobytes()
            else:
                other.append(w)
        words = other
        alone = [w for w in words if MARK in w or "<|" in w or len(self.mark) != 4]
        self.seen.update(zip(alone, self._ids(alone), strict=True))
        rest = [w for w in words if MARK not in w and "<|" not in w] if len(self.mark) == 4 else []
        for k in range(0, len(rest), JOINED):
            part = rest[k : k + JOINED]
            ids = self._ids([f" {MARK} ".join([*part, ""])])[0]
            at = (np.flatnonzero(np.frombuffer(ids, np.uint32) == np.frombuffer(self.mark, np.uint32)) * 4).tolist()
            self.seen.update(zip(part, [ids[a:b] for a, b in zip([0, *(x + 4 for x in at)], at, strict=False)], strict=True))

    def _split(self, words: list[str]) -> list[bytes]:
        """The ids of new words as they stand in texts, from those of their parts."""
        heads, tails = [], []
        for w in words:
            tail = ""
            if "<|" not in w:
                if w.isascii():
                    w = w.lower()
                head = w.rstrip(PUNCTUATION)
                if len(head) < len(w) and head and head[-1] in LETTERS:
                    w, tail = head, w[len(head) :]
            heads.append(w)
            tails.append(tail)
        self._learn(self.seen.new_of({*heads, *tails}))
        get = self.seen.__getitem__
        return [get(h) + get(t) if t else get(h) for h, t in zip(heads, tails, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets, an end id after every text."""
        words, codes, offsets = words_of(texts, lower=False)
        words = listed(words)
        each, missing = self.whole.take(words)
        new = [words[i] for i in missing]
        for i, w, e in zip(missing, new, self._split(new), strict=True):
            each[i] = self.whole[w] = e
        each.append(array("I", [END_ID]).tobytes())
        size = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        first = np.cumsum(size) - size
        table = np.frombuffer(b"".join(each), dtype=np.uint32)
        codes = np.insert(codes, offsets[1:], len(words))  # the end of each text
        length = size[codes]
        ends = np.cumsum(length)
        at = np.ones(ends[-1] if len(ends) else 0, np.int64)  # a step on, but to the next word's first id
        some = codes if size.all() else codes[length > 0]  # words of other white space have no ids
        at[np.cumsum(size[some])[:-1]] = first[some[1:]] - (first + size)[some[:-1]] + 1
        at[:1] = first[some[:1]]
        ids = table[np.cumsum(at, out=at)]
        stops = offsets[1:] + np.arange(1, len(offsets))
        return ids, np.concatenate(([0], ends[stops - 1])) if len(stops) else np.zeros(1, np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False, batch: int = BATCH) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's pieces."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in slices(batches, "text", batch):
            ids, offsets = coder.encode(b.column("text"))
            total = np.diff(offsets)
            count = (total + length - 1) // length
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(length, total[row] - piece * length)
            begin = offsets[row] + piece * length
            packed = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(packed[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
            columns = [b.column("key").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * length, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array([ids[a : a + n] for a, n in zip(begin, size, strict=True)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)
        coder.rest()

    narrow = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return narrow.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, items taken in the order given."""
    open_count = np.zeros(length + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s < length:
            after = open_count[: length - s + 1] * 2 + 1  # cost of one more with gap g - s
            after[0] = 0  # a full sequence is closed
            cost = after[:-1] - (open_count[s:length] * 2 - 1)  # gap g = s ... length - 1
            cost[open_count[s:length] == 0] = 1 << 60
            at = int(cost.argmin()) if len(cost) else 0
            best = int(cost[at]) if len(cost) else 1 << 60
            fresh = int(after[length - s])
            gap = length if fresh < best else s + at
        else:
            gap = length
        if gap == length:
            place, made = made, made + 1
        else:
            place = bins[gap].pop()
            open_count[gap] -= 1
        sequence[i], offset[i] = place, length - gap
        if gap > s:
            bins[gap - s].append(place)
            open_count[gap - s] += 1
    return sequence, offset


def pack(rows: DataFrame, key: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a (materialised) table of pieces."""
    groups = max(1, -(-rows.count() // group))
    out = rows.withColumn("_group", F.pmod(F.xxhash64(key, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", key, "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = sum_of_squares(g["length"].to_numpy(), length)
        g["sequence_id"], g["offset"] = (g["_group"].to_numpy() << 32) + sequence, offset
        return g.drop(columns="_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return out.groupBy("_group").applyInPandas(run, schema)


def best_fit_packing(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False, batch: int = BATCH) -> DataFrame:
    return pack(materialise(pieces(docs, path, key, text, length, with_ids, batch)), key, length)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
