"""A corpus from documents: low quality, near copies and repeated passages go, secrets are masked, the rest is packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of docs.

1. quality: rows that the classifier rejects (score under its threshold) go. It learns from the labels of the same tables.
2. near_duplicates: of documents linked by five-word shingles at a similarity of 0.8 or more, the least doc_id stays.
3. repeated_passages: passages of 50 or more words that an earlier document holds are cut out; n_chars follows the text.
4. secrets: spans of secrets are replaced by a mask; n_chars follows.
5. packing: every document's pieces with the sequence of at most 4096 tokens they are packed in.

Null texts stay null where a stage keeps their row; empty tables give empty results; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import near_dedup, packing, quality, secret_scan, shared, suffix_dedup


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, shared.table(spark, sf_dir, "labels"))
    (score,) = shared.fresh(docs, "score")
    return quality.scored(docs, model, column=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, k=5, percent=80)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(suffix_dedup.deduplicated(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secret_scan.masked(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeated_passages", repeated_passages_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The classifier, the similarity join, the suffix array and the packing have no SQL form; tests/llm/ compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.work_folder(spark)
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.staged(stage(spark, docs, sf_dir), folder, name)
    return docs
