"""Corpus pipeline over ``documents``: quality classifier, line dedup, SimHash near-dedup, PII redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each but the last returns the
columns of ``documents``. ``run`` applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landlens.llm.knn_quality import score_quality
from landlens.llm.lines import dedup_lines
from landlens.llm.packing import harmonic_pack
from landlens.llm.pii import redact
from landlens.llm.simhash import simhash_keep_one

#: Neighbour votes, MinHash links, boosted trees and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier does not reject."""
    score, predicted = "_score", "_predicted"
    while {score, predicted} & set(docs.columns):
        score, predicted = f"_{score}", f"_{predicted}"
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_as=score, predicted_as=predicted)
    return scored.where(F.col(predicted) == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, exactly or nearly, stay in the first document only; documents left without a word go."""
    return _measured(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by their kind."""
    return _measured(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return harmonic_pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
