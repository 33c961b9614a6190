"""Name to query, name to SQL, and the table readers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with a string key; only the named columns are read."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_key"), *(columns or ("text",))
    )


def paged(text):
    """Lines as pages: the tables hold no form feeds of their own."""
    return F.replace(text, F.lit("\n"), F.lit("\f"))


# SQL counterparts.
DOC_KEY = "CAST(doc_id AS VARCHAR) AS doc_key"
PAGED = "replace(text, chr(10), chr(12))"
