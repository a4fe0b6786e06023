"""Documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as a
table in the shared folder and reads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import neardup, packing, pii, quality, toxicity
from treeline.llm.common import crc_mod, materialise, read, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _plain(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, others kept aside in one struct, where no
    operator's own columns can meet them."""
    rest = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*COLUMNS, F.struct(*rest).alias("_rest")) if rest else docs


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    rest = ["_rest.*"] if "_rest" in found.columns else []
    return found.select(*COLUMNS, *rest).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base rules and the adaptive thresholds.

    Null, empty and short texts fail and go; repeated rows are judged alike; null
    ``lang`` and ``source`` are groups of their own; other columns pass through
    whatever their names; an empty table stays empty.
    """
    return _like(quality.quality_rules(_plain(docs)).where("kept"), docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, trained on the labelled rows outside the held-out
    fifth, scores under its threshold.

    Null and empty texts have the score of a text without words; repeated rows and
    equal texts are judged alike; without labels all stay; other columns pass
    through whatever their names; an empty table stays empty.
    """
    plain = _plain(docs)
    scored = toxicity.toxicity(plain, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return _like(scored.where(F.col("score") < 0.5), docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates (five-word shingles,
    similarity 0.8).

    Texts without words stay; of equal texts under different ids the least id
    stays; rows that repeat an id and its text stay together; where an id has several
    texts each is judged by itself, and stands before the ids with one text; rows
    without an id stay; other columns pass through whatever their names; an empty
    table stays empty.
    """
    plain, mark = _plain(docs), F.xxhash64("text")
    ids = plain.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(F.min(mark).alias("_low"), F.max(mark).alias("_high"))
    several = materialise(ids.where("_low <> _high").select("_of"))
    other = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1)) - F.lit(1 << 62)  # below all ids in use
    keyed = plain.join(small(several), F.col("doc_id") == F.col("_of"), "left").withColumn("_row_id", F.when(F.col("_of").isNotNull(), other).otherwise(F.col("doc_id"))).drop("_of")
    found = neardup.near_duplicates(keyed.select("_row_id", "text"), key="_row_id", shingle=5, percent=80)
    gone = materialise(found.where("NOT kept").select(F.col("_row_id").alias("_gone")).distinct())
    return _like(keyed.join(small(gone, 500_000), F.col("_row_id") == F.col("_gone"), "left_anti"), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets and count the characters anew.

    Null texts stay null, with a null count; texts without personal data stay as
    they are; repeated rows are treated alike; other columns pass through whatever
    their names; an empty table stays empty.
    """
    clean = pii.redact(pii.pii(_plain(docs))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _like(clean, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences.

    Null and empty texts are one piece of the end id; repeated rows are packed each;
    other columns are not read; an empty table gives no pieces.
    """
    import public_tokenizers

    # small batches: the executors' heaps are grown by the stages before
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), batch=packing.BATCH // 2)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", neardup_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: The toxicity stage is a trained network, which SQL can't express; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
