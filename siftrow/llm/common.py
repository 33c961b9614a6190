"""Expressions and small helpers that several operators share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediate tables, in storage that every executor shares.

    It lies in the folder of spark.checkpoint.dir, or in the warehouse where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: cuts lineage, and a lost executor costs no recomputation.

    Its shuffle files go once it is written, since only the table is read from then on. Otherwise those of all steps of a
    job stay on disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once per row, however often body uses it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. A text without wide characters takes the faster way to the same result."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The runs of characters other than blanks; none for a null text.

    The blanks are mapped to spaces first, since a split at one plain character needs no pattern.
    """
    text = F.coalesce(text, F.lit(""))
    odd = text.rlike(r"[\x09\x0B-\x0D]")
    spaced = F.when(odd, F.translate(text, BLANKS[1:], " " * 5)).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(spaced, " "), "")


def running_start(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of value over all earlier rows of the group, without a task that holds a whole group.

    bucket must cut each group into ranges of the order, in ascending buckets. Bucket totals are summed first; they are
    few. Then each bucket's rows are summed on their own. A null group is a group.
    """
    per_bucket = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select(
        F.col(group).alias("_group"),
        F.col(bucket).alias("_bucket"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
    )
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    match = summed[group].eqNullSafe(bases["_group"]) & (summed[bucket] == bases["_bucket"])
    return summed.join(bases, match).withColumn(name, F.col("_base") + F.col("_within")).drop("_group", "_bucket", "_base", "_within")
