"""The corpus pipeline: from documents to packed training windows.

Each stage applies one operator to all that its predecessor kept; its result
is written as Parquet in the shared folder and reread by the next one.

Defined results: a document whose text is null or has no letter goes at the
first stage, and those that the model rejects; with no labelled language to
learn from, only the former. Of repeated rows and of linked documents the
second stage keeps one; a null id is a document like others. A document of
which the third stage leaves no word counts no word in the mix and is taken
like the others of its source; a source without a word is not mixed. Ties are
settled as the stages' modules say. An empty table gives an empty result. All
stages but the last keep every column of their input, so extra columns do no
harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veeduria.llm import jaccard_join, langid, mixing, packing, substring_dedup
from veeduria.llm.queries import vocabulary
from veeduria.session import scratch_table_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard_join.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in an earlier document."""
    return substring_dedup.dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_windows", packed_windows),
]

#: The stages learn a model and cut passages; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_table_dir(spark, f"pipeline_{name}_{uuid.uuid4().hex[:12]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
