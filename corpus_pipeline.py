"""Corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``:

1. quality: rows that the classifier rejects go;
2. near_duplicates: one document of each group at a similarity of 0.80 stays;
3. personal_data: spans are replaced by their kind, ``n_chars`` follows;
4. mixing: all rows, sorted across files by the schedule of their sources;
5. packing: pieces with their sequences (the columns of op1).

The quality stage learns from ``labels`` joined to all of ``documents`` by the
rule of op9, so its model does not depend on what a stage was given. Nulls,
empty texts, repeated rows and extra columns are treated as each operator says;
an empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unhold.llm import mixing, neardup, packing, pii, quality
from unhold.llm.base import stored, table


NEAR_DUPLICATE_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(quality.labelled(spark, sf_dir, table(spark, sf_dir, "documents")))
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, threshold=NEAR_DUPLICATE_PERCENT)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.ordered(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hash sketches, a learned model and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
