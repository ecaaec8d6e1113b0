"""Registered queries of the text operators and, where SQL can say the same, their SQL.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import common, sql

PIECE_MODEL, WORD_MODEL, BYTE_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.quality_rules import quality_rules

    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.license_scan import scan

    return scan(common.table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.toxicity import toxicity

    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.token_counts import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.near_dedup import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(common.table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.pii import personal_data

    return personal_data(common.table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.packing import best_fit_packing

    return best_fit_packing(common.table(spark, sf_dir, "documents"), vocabulary(WORD_MODEL))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.piece_codec import round_trip

    return round_trip(common.table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.quality_knn import quality_classifier

    return quality_classifier(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.byte_bpe import digests

    return digests(common.table(spark, sf_dir, "documents"), vocabulary(BYTE_MODEL))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.hard_negatives import hard_negatives

    return hard_negatives(common.table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sightline.llm.token_align import token_alignment

    return token_alignment(common.table(spark, sf_dir, "documents"), vocabulary(BYTE_MODEL), vocabulary(PIECE_MODEL))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scans": op2_license_scans,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_fingerprints": op6_fingerprints,
    "op7_personal_data": op7_personal_data,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_piece_codec": op9_piece_codec,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_byte_codec": op11_byte_codec,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}
SQL: dict[str, str] = dict(sql.SQL)
