"""Fingerprints of documents and the main text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftrow.llm.common import read
from siftrow.llm.fingerprints import compare_with_next, rarity
from siftrow.llm.html import extract_main_text
from siftrow.llm.queries.registry import query


@query()
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_next(docs, rarity(docs))


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
