"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All stages but the last
return the columns of documents. The last returns a row of counts for each
document that the mix takes; the mixed corpus is the stage before, each
document's words repeated as its row says.

Stages judge rows, not ids: a row goes by its own doc_id and text, so rows that
share an id (or have none) are judged each by its own text, and repeated rows
stay or go together. Defined results, for every stage:

- null or empty text: judged by quality like any text; no lines, no shingles, no
  words, so the other stages keep it; the mix takes nothing of it.
- null doc_id: judged like any other, but it is nobody's near-duplicate.
- ties: of equal or near-equal lines the earliest by (doc_id, text, position)
  stays, of near-duplicates the document of the least doc_id.
- an empty table gives an empty table; without labels of both classes quality
  keeps all; an empty benchmark keeps all.
- further columns are passed on unchanged by all stages but the last, whatever
  their names; where line dedup shortens a text, n_chars is counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, linededup, mixing, neardup, quality
from lodestar.llm.common import stored, table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows of gone(doc_id, text_hash); null ids and texts compare as equal."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left_anti")
    return left.select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_of(F.col("text"), model) >= quality.THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of lines; those of which nothing is left go."""
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = linededup.dedup_lines(rows).where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*((fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    found = neardup.near_duplicates(docs, k=5, percent=80, keyed=True)
    return _without(docs, stored(found.where("not kept").select("doc_id", "text_hash"), "near-gone"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keyed=True)
    return _without(docs, stored(found.where("contaminated").select("doc_id", "text_hash"), "contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words taken of each, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The first and the third stage (a trained classifier, an LSH forest) are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
