"""The queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ferrowick.llm import bpe, decontaminate, language, line_dedup, near_dedup, quality, substring_dedup, toxicity, url_filter, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by EVERY, against all rows."""
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % vector_search.EVERY == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), decode_too=True)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.tracked_keys(pages))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_languages(docs))


QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_decontamination, op4_top_k, op5_toxicity, op6_near_dedup, op7_substring_dedup, op8_bpe, op9_url_filter, op10_language)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op4_top_k": vector_search.ORACLE_SQL, "op7_substring_dedup": substring_dedup.ORACLE_SQL, "op9_url_filter": url_filter.ORACLE_SQL}
