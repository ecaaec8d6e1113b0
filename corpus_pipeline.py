"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of `documents`; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import common, near_dedup, packing, pii, quality_knn, quality_rules
from sightline.llm.queries import WORD_MODEL, vocabulary


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def stage_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    space = quality_knn.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_knn.keep_good(docs, space)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, vocabulary(WORD_MODEL))


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("quality_classifier", stage_quality_classifier),
    ("near_dedup", stage_near_dedup),
    ("personal_data", stage_personal_data),
    ("packing", stage_packing),
]
#: Stages 1, 2, 3 and 5 are models, sketches and a packing plan: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
