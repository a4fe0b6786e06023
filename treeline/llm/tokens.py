"""Token counts by rank-synchronous array merging.

The vocabulary is a sentencepiece BPE model.  No piece of such a vocabulary has
a space mark after another character, so a text falls into pre-tokens (space
marks, then other characters) that never merge with each other; the same holds
at line feeds, which no piece contains.  Both facts are checked when a model is
loaded.  A batch's distinct pre-tokens are merged together as ragged arrays
(``merging.merge``) and their counts are summed per document.

Defined cases: null text is the empty text with 0 tokens; equal rows give equal
counts; an empty table gives an empty result; only the columns asked for are
carried.  Very long texts are read whole; pre-tokens of any length are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import Remembered, read, segment_sum, slices, tidy
from .merging import PairTable, merge

MARK = "▁"
LIMIT = 4096
#: Distinct pre-tokens that a worker remembers.
CACHE = 200_000


class PieceCounter:
    """Counts tokens as the model's library does, without it in the hot path."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        ranks = {p: rank for rank, (_, p) in enumerate(sorted((-model.get_score(i), p) for p, i in pieces.items())) if len(p) > 1}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("pre-tokens of this vocabulary can merge with each other")
        self.table = PairTable.of_pieces(pieces, ranks)
        self.single = {p: i for p, i in pieces.items() if len(p) == 1}
        self.feed = 1 if "\n" in self.single else len(b"\n")
        self.seen = Remembered(CACHE)

    def _learn(self, words: list[str]) -> None:
        """Count new pre-tokens (given as marked text without line feeds)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        chars, where = np.unique(points, return_inverse=True)
        known = np.array([self.single.get(chr(c), -1) for c in chars], dtype=np.int64)
        width = np.array([1 if s >= 0 else len(chr(c).encode("utf-8", "surrogatepass")) for c, s in zip(chars, known, strict=True)], dtype=np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        offsets = np.concatenate(([0], np.cumsum(size)))
        out, ends = merge(self.table, known[where], offsets)
        extra = segment_sum((width - 1)[where], offsets)  # unknown characters fall back to bytes
        for w, n in zip(words, (np.diff(ends) + extra).tolist(), strict=True):
            self.seen[w] = n

    def _counts(self, words: list[str]) -> list[int]:
        new = self.seen.new_of(set(words))
        if new:
            self._learn(new)
        return [self.seen[w] for w in words]

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
        spaced = pc.or_(pc.match_substring_regex(texts, f"  |{MARK}"), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        plain = np.flatnonzero(~spaced)
        if len(plain):
            out[plain] = self._plain(texts.take(pa.array(plain)))
        rest = np.flatnonzero(spaced)
        marked = [MARK + texts[i].as_py().replace(" ", MARK) for i in rest]
        parts = [re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", m) for m in marked]
        counts = self._counts([p for x in parts for p in x])
        ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
        out[rest] = segment_sum(np.array(counts, dtype=np.int64), ends) + [m.count("\n") * self.feed for m in marked]
        out[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        return out

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Texts without runs of spaces or literal marks: elements between single spaces, where a
        line feed starts an element that has no space mark."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        fed = np.array([w.startswith("\n") for w in words], dtype=bool)
        each = np.array(self._counts([w[1:] if f else MARK + w for w, f in zip(words, fed, strict=True)]), dtype=np.int64) + fed * self.feed
        offsets = parts.offsets.to_numpy()
        return segment_sum(each[coded.indices.to_numpy()], offsets - offsets[0])


def token_counts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every document."""
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path)
        for b in slices(batches, "text"):
            n = counter.count(b.column("text"))
            size = pc.fill_null(pc.cast(pc.binary_length(b.column("text")), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column("key"), size, pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
