"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

language_id   documents whose language model rejects them go
line_dedup    lines that an earlier document holds go
jaccard_join  of documents that similarity links, the one of the smallest doc_id stays
mixing        documents as often as the mix of sources takes them; a row per time
packing       a row per piece of every row, with its sequence and place
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftrow.llm.common import read, stored, work_folder
from siftrow.llm.jaccard import keep_one_of_each
from siftrow.llm.language import keep_identified
from siftrow.llm.line_dedup import dedup_lines
from siftrow.llm.mixing import mixed_documents
from siftrow.llm.queries.token_files import packed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language models, components and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
