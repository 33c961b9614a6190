"""Spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftrow.llm.common import read
from siftrow.llm.queries.registry import query
from siftrow.llm.variants import spelling_variants


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
