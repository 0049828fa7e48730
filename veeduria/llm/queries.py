"""One query per operator over the given tables, and SQL where it applies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veeduria.llm import (fingerprints, html_text, jaccard_join, langid, license_scan, merkle, mixing, packing,
                          periodic_runs, quality, secret_crf, substring_dedup, token_orc)
from veeduria.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_crf.scan(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html_text": op2_html_text,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_orc": op4_token_orc,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_langid": op7_langid,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_merkle": op11_merkle,
    "op12_secret_crf": op12_secret_crf,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_jaccard_join": jaccard_join.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_mixing": mixing.SQL,
    "op11_merkle": merkle.SQL,
}
