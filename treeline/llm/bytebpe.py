"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap; each chunk is pre-tokenised on its own,
so chunks are independent units of work.  A chunk that starts inside a pre-token
has wrong boundaries at first, and one that is cut at its end may have wrong ones
in its last characters (``GUARD``).  The pattern never looks behind, so from a
boundary that the left chunk has before its guard and the right chunk has too,
both go on alike: chunks are stitched at the first such boundary.  Where an
overlap holds none (a pre-token longer than the overlap), matching goes on from
the left chunk's last safe boundary until it meets one of the right chunk's.

Texts of over ``SPAN`` characters are cut the same way once more: their spans become
rows that Spark deals out over all tasks, each span gives its boundaries, and those
are stitched by text, so that no task pre-tokenises a whole long text.
Distinct pieces are then merged by ``merging.merge``; decoding concatenates the
ids' bytes.

Defined cases: null text is the empty text with no ids; equal rows give equal
results; an empty table gives an empty result; texts are whole whatever their
length.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, materialise, read, slices, tidy
from .merging import PairTable, merge

CHUNK, OVERLAP = 2_048, 256
SPAN = 1 << 18
#: Boundaries in a cut chunk's last characters aren't trusted: no alternative of
#: the pattern decides on more than three characters after a boundary.
GUARD = 8
CACHE = 200_000


class ByteCodec:
    """Encodes with a rank file as tiktoken's ``encode_ordinary``."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.table = PairTable.of_pieces(ranks, {t: r for t, r in ranks.items() if len(t) > 1})
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.seen = Remembered(CACHE)

    # ---- pre-tokens

    def chunk_ends(self, text: str, start: int, stop: int) -> list[int]:
        """Boundaries (match ends) of one chunk, from ``start`` on its own."""
        return [m.end() for m in self.pattern.finditer(text, start, stop)]

    def boundaries(self, text: str, start: int = 0, stop: int | None = None) -> list[int]:
        """Match ends of the pattern over a text, or a part of it on its own, by chunks."""
        stop = len(text) if stop is None else stop
        cuts = [(s, min(stop, s + CHUNK + OVERLAP)) for s in range(start, max(stop, start + 1), CHUNK)]
        return self.stitched(text, stop, cuts, [self.chunk_ends(text, s, e) for s, e in cuts])

    def stitched(self, text: str, end: int, cuts: list[tuple[int, int]], chunks: list[list[int]]) -> list[int]:
        """One list of boundaries up to ``end`` from those of overlapping cuts."""
        ends = list(chunks[0])
        for (start, _), (_, stop), right in zip(cuts[1:], cuts, chunks[1:], strict=False):
            if stop == end:  # the left chunk already reached the end
                break
            del ends[bisect_left(ends, stop - GUARD + 1) :]
            common = set(right[: bisect_left(right, stop + 1)])
            first = next((i for i in range(bisect_left(ends, start + 1), len(ends)) if ends[i] in common), None)
            if first is not None:
                at = ends[first]
                del ends[first + 1 :]
            else:
                at, common = ends[-1] if ends else cuts[0][0], set(right)
                while at < end and (at <= start or at not in common):
                    at = self.pattern.match(text, at, end).end()
                    ends.append(at)
            ends.extend(right[bisect_left(right, at + 1) :])
        return ends

    def pieces(self, text: str, ends: list[int] | None = None) -> list[str]:
        ends = self.boundaries(text) if ends is None else ends
        return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if text else []

    # ---- ids

    def _learn(self, new: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        parts: list[tuple[str, bytes]] = []
        for p, b in zip(new, raw, strict=True):
            if b in self.ranks:
                self.seen[p] = self.ranks[b].to_bytes(4, "little")
            else:
                parts.append((p, b))
        if parts:
            offsets = np.concatenate(([0], np.cumsum([len(b) for _, b in parts])))
            flat = self.byte[np.frombuffer(b"".join(b for _, b in parts), dtype=np.uint8)]
            ids, ends = merge(self.table, flat, offsets)
            packed = ids.astype("<u4").tobytes()
            for (p, _), a, z in zip(parts, (ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist(), strict=True):
                self.seen[p] = packed[a:z]

    def encode_batch(self, texts: list[str], ends: list[list[int]] | None = None) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; ``ends`` are its boundaries, if known."""
        cut = [self.pieces(t, e) for t, e in zip(texts, ends or [None] * len(texts), strict=True)]
        new = self.seen.new_of(set().union(*cut))
        if new:
            self._learn(new)
        get = self.seen.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and the ids themselves if asked for."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(rank_path, pattern)
        for b in slices(batches, "text"):
            texts = [x or "" for x in b.column("text").to_pylist()]
            ends = None
            if "spans" in b.schema.names:
                spans = [[np.frombuffer(x, dtype="<i8").tolist() for x in row] for row in b.column("spans").to_pylist()]
                ends = [codec.stitched(t, len(t), _cuts(len(t)), found) for t, found in zip(texts, spans, strict=True)]
            ids = codec.encode_batch(texts, ends)
            columns = [b.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)

    @tidy
    def span_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(rank_path, pattern)
        for b in slices(batches, "text"):
            ends = [np.array(codec.boundaries(t), dtype="<i8") + s for t, s in zip(b.column("text").to_pylist(), b.column("start").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("start"), pa.array([e.tobytes() for e in ends], pa.binary())], ["row", "start", "ends"])

    narrow = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    is_long = F.coalesce(F.length("text") > SPAN + OVERLAP, F.lit(False))
    out = narrow.where(~is_long).mapInArrow(run, schema)
    long = materialise(narrow.where(is_long).withColumn("row", F.monotonically_increasing_id()))
    if long.isEmpty():
        return out
    start = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(SPAN))).alias("start")
    spans = long.select("row", "text", start).select("row", "start", F.substring("text", F.col("start") + 1, F.lit(SPAN + OVERLAP)).alias("text"))
    dealt = spans.repartition(docs.sparkSession.sparkContext.defaultParallelism, "row", "start")
    found = dealt.mapInArrow(span_ends, "row long, start int, ends binary").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "ends"))).alias("a"))
    whole = long.join(found.select("row", F.transform("a", lambda x: x["ends"]).alias("spans")), "row").select("key", "text", "spans")
    return out.unionByName(whole.mapInArrow(run, schema))


def _cuts(size: int) -> list[tuple[int, int]]:
    return [(s, min(size, s + SPAN + OVERLAP)) for s in range(0, size, SPAN)]


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
