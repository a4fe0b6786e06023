"""Fill-in-middle over an index of distinct texts.

Documents are grouped by the SHA-256 of their text and each group's contents are
compared: a group holds the set of its texts, and a digest with two of them stops
the job rather than mixing them up.  The ends of a text's lines are found once per
distinct text and kept as an Elias-Fano list (low bits side by side, high bits in
unary), about a byte a line.  The index is joined back to the documents' ids by
digest, every document selects its two seeded line ends from the list, and the
output is put together by string functions.

Texts cross one shuffle, those of a task's equal documents once; lists and cuts
are shuffled without them.  A text of more than ``HOT`` documents stands in one copy per ``HOT`` of them, its documents dealt
over the copies, so that no task holds a large group; those copies are at most a
``HOT``-th of the texts.

Defined cases: a null text counts as empty and is plain; an empty text is plain
with n = 0; rows that repeat an id are cut alike if their texts are equal; a null
id is seeded as the empty string; texts with a sentinel are plain; other columns
are kept (as they are, under their names, but for those this operator adds, which
it replaces); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, small

#: Documents of one text to a copy of its index entry.
HOT = 128
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


# ------------------------------------------------------------------ Elias-Fano


class EliasFano:
    """A rising list of integers as bytes: a width, the low bits, the high bits.

    The k-th value's high part is the number of zeros before the k-th one of the
    high bits; its low part stands at bit k * width of the low bits.
    """

    ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        n = len(values)
        if not n:
            return b""
        width = max(int(values[-1]) // n, 1).bit_length() - 1
        low = (values[:, None] >> np.arange(width - 1, -1, -1)) & 1
        high = np.zeros((int(values[-1]) >> width) + n, np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        return bytes([width]) + np.packbits(low.astype(np.uint8)).tobytes() + np.packbits(high).tobytes()

    @classmethod
    def select(cls, packed: bytes, n: int, k: int) -> int:
        """The k-th value, k from 1; 0 for k = 0."""
        if not k:
            return 0
        width, at = packed[0], 1 + (n * packed[0] + 7) // 8
        high = np.frombuffer(packed, np.uint8, offset=at)
        upto = np.cumsum(cls.ONES[high])
        byte = int(np.searchsorted(upto, k))
        before = int(upto[byte - 1]) if byte else 0
        one = 8 * byte + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1]))[k - 1 - before])
        start = (k - 1) * width
        few = int.from_bytes(packed[1 + start // 8 : 1 + (start + width + 7) // 8], "big")
        low = (few >> (-(start + width) % 8)) & ((1 << width) - 1)
        return ((one - (k - 1)) << width) | low


def line_ends(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the code point positions after its lines."""
    raw = texts.cast(pa.large_string()).cast(pa.large_binary())
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = data[a:b]
        ends = np.flatnonzero(own == 10) + 1
        if b > a and own[-1] != 10:
            ends = np.append(ends, b - a)
        points = np.cumsum((own & 0xC0) != 0x80)  # code points up to each byte
        out.append(points[ends - 1] if len(ends) else ends)
    return out


def _packed_ends(texts: pa.Array) -> pa.Array:
    return pa.array([EliasFano.pack(e) for e in line_ends(texts)], pa.binary())


def _listed(index: DataFrame) -> DataFrame:
    """index: (_key, text, ...) with the number of lines and their packed ends."""
    text = F.col("text")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    tail = (text != "") & ~F.endswith(text, F.lit("\n"))
    return index.withColumns({"n": breaks.cast("long") + tail.cast("long"), "ends": F.arrow_udf(_packed_ends, "binary")(text)})


def _select(ends: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([EliasFano.select(e, *x) for e, *x in zip(ends, n, k, strict=True)], dtype="int64")


# -------------------------------------------------------------------- operator


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _draw(seed: int, key: str, k: int) -> Column:
    """The k-th 8-digit group of the hex SHA-256 of seed:key."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hex_, 8 * k - 7, 8), 16, 10).cast("long")


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """(_key, text, copies): one row for each text, by digest and verified content."""
    groups = keyed.groupBy("_key").agg(F.collect_set("text").alias("texts"), F.count(F.lit(1)).alias("copies"))
    same = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts have one digest")))
    return groups.select("_key", same.alias("text"), "copies")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, hot: int = HOT, digest=_digest) -> DataFrame:
    """The documents with n, form, prefix_chars, middle_chars and output.

    rate: of a hundred texts so many are cut; spm: of a hundred cut ones so many
    begin with the suffix, the others with the prefix.
    """
    if {c.lower() for c in docs.columns} & {"_key", "_part", "_row", "_text"}:
        raise ValueError("columns named _key, _part, _row or _text can't be kept")
    plain = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c.lower() not in (*ADDED, text.lower())]
    row = docs.select(F.struct(*rest).alias("_row"), plain.alias("text"), F.col(text).isNull().alias("_null")).withColumn("_key", digest(F.col("text")))
    counts = row.groupBy("_key").count().where(F.col("count") > hot)
    large = small(materialise(counts.select(F.col("_key").alias("_hot"), F.ceil(F.col("count") / hot).cast("int").alias("_parts"))))
    part = F.pmod(F.xxhash64(F.col(f"_row.{key}")), F.col("_parts")).cast("int")
    ids = row.select("_row", "_null", "_key").join(large, F.col("_key") == F.col("_hot"), "left").select("_row", "_null", "_key", part.alias("_part"))
    index = distinct_texts(row)
    few, many = index.where(F.col("copies") <= hot).drop("copies"), _listed(index.where(F.col("copies") > hot))
    own = _chosen(ids.where("_part IS NULL").drop("_part").join(_listed(few).drop("text"), "_key"), f"_row.{key}", seed)
    spread = many.withColumn("_part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("copies") / hot) - 1).cast("int")))).drop("copies")
    shared = _chosen(ids.where("_part IS NOT NULL").join(spread, ["_key", "_part"]), f"_row.{key}", seed)
    cuts = own.join(few, "_key").unionByName(shared.drop("_part"))  # the texts of few stay where they were grouped
    return _put_together(cuts, f"_row.{key}", seed, rate, spm).select(*_restored(docs, rest, text), *ADDED)


def _restored(docs: DataFrame, rest: list[str], text: str) -> list[Column]:
    """The documents' own columns in their order, without those the operator adds."""
    own = {c: F.col("_row")[c].alias(c) for c in rest}
    own |= {c: F.when(~F.col("_null"), F.col("_text")).alias(c) for c in docs.columns if c.lower() == text.lower()}
    return [own[c] for c in docs.columns if c in own]


def _chosen(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """The two seeded ends, selected from the packed list."""
    draws = rows.withColumns({"_a": _draw(seed, key, 1) % (F.col("n") + 1), "_b": _draw(seed, key, 2) % (F.col("n") + 1)})
    selected = F.pandas_udf(_select, "long")
    return draws.withColumns({"_a": selected("ends", "n", F.least("_a", "_b")), "_b": selected("ends", "n", F.greatest("_a", "_b"))}).drop("ends")


def _put_together(ends: DataFrame, key: str, seed: int, rate: int, spm: int) -> DataFrame:
    bare = (F.col("text") == "") | (_draw(seed, key, 3) % 100 >= rate)
    for s in SENTINELS:
        bare = bare | F.contains("text", F.lit(s))
    ends = ends.withColumn("form", F.when(bare, "plain").when(_draw(seed, key, 4) % 100 < spm, "spm").otherwise("psm"))
    piece = [F.substr("text", F.lit(1), F.col("_a").cast("int")), F.substr("text", (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")), F.substr("text", (F.col("_b") + 1).cast("int"))]
    prefix, middle, suffix = piece
    p, s, m = map(F.lit, SENTINELS)
    whole = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return ends.select("*", F.col("text").alias("_text"), F.when(cut, F.col("_a")).alias("prefix_chars"), F.when(cut, F.col("_b") - F.col("_a")).alias("middle_chars"), whole.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of one of the three forms was made of.

    A cut text holds no sentinel and no sentinel overlaps another, so the first
    of each kind is the one that was put in.
    """

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        i, j = F.instr(output, two), F.instr(output, SENTINELS[2])
        return F.substr(output, F.lit(4), i - 4), F.substr(output, i + 3, j - i - 3), F.substr(output, j + 3)

    (prefix, suffix, middle), (last, first, mid) = parts("<P>", "<S>"), parts("<S>", "<P>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(first, mid, last))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restore(F.col("output"), F.col("form")), 256)}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[c.alias(k) for k, c in hashed.items()])
