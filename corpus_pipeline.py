"""The corpus pipeline: toxic documents go, common lines go, one of each group of near duplicates stays, documents that hold benchmark items go, the rest is encoded.

Defined results, beside those of each stage: further columns of documents pass through all stages but the last unchanged, whatever
their names; texts of any length are taken whole; an empty table of documents gives an empty result, an empty table of labels rejects
nothing as toxic, an empty benchmark nothing as contaminated. Each stage's output is written once and read by the next; it is
deleted when the next is written, and the last that was written when the application ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrowick.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from ferrowick.llm._session import delete, delete_at_end, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, flags are rejected.

    Null and empty texts score as the model's bias alone; rows with a null id are judged as others; repeated rows are each judged; a score equal
    to the threshold is toxic; without labels nothing is rejected."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of too many documents stay in their first only; documents left without text go.

    Null, empty and blank texts stay as they are; rows with a null id aren't counted and keep their lines; rows that repeat an id are
    one document; a line in exactly as many documents as allowed stays. ``n_chars`` and other columns aren't counted anew."""
    return line_dedup.with_lines_dropped(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id.

    Null, empty and blank texts are no duplicates and all stay, rows with a null id too; of rows with the same id and text one stays if they have a shingle;
    rows of one id with different texts are judged each by its own text."""
    return near_dedup.without_near_duplicates(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark within its error budget are rejected.

    Null, empty and blank texts stay; rows with a null id and repeated rows are each judged; null and blank items match nothing."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, decoded) of every document left.

    A null text has nulls, an empty one no tokens; repeated rows and rows with a null id are each encoded; ``decoded`` is the text itself."""
    return bpe.encode(docs, decode_too=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: Classifier, signatures, edit distances and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents; what lies between two is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # nothing reads the stage before any more
                delete(spark, f"{folder}/{k - 1}")
    return docs

