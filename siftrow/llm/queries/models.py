"""The quality classifier and language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftrow.llm.classifier import quality_scores
from siftrow.llm.common import read
from siftrow.llm.language import identify_languages
from siftrow.llm.queries.registry import query


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scores(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_languages(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
