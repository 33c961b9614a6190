"""The output table.

Rows are written once, in parallel, to ``attempt=...`` under the output folder.
Readers take only attempts the ledger has committed, so they never see half a
write, and a run that died leaves nothing visible.

Two runs that commit at the same moment may both hold a row of one document.
Readers then take that of the run which finished first. Only runs whose times
overlap are looked at, and only their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrow.operators.catalog import DEFAULT_CATALOG, Catalog
from siftrow.sources.ledger import read_runs
from siftrow.sources.paths import no_rows, read_parquet_if_there


#: Minutes after a run's end within which its commit is surely seen.
COMMIT_MINUTES = 5


def results_schema(catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> T.StructType:
    names = (key, *catalog.columns, "run_id")
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def append_results(rows: DataFrame, out: str, attempt: str) -> None:
    """Write the rows of one attempt at a run. Visible once the ledger commits it."""
    rows.drop("run_id").write.mode("overwrite").parquet(f"{out}/attempt={attempt}")


def create_empty_output(spark: SparkSession, out: str, catalog: Catalog = DEFAULT_CATALOG) -> None:
    """Make an output that holds its columns and no rows; an existing one stays."""
    empty = no_rows(spark, results_schema(catalog)).drop("run_id")
    empty.write.mode("ignore").parquet(f"{out}/attempt=empty")


def read_results(
    spark: SparkSession, out: str, ledger: str, catalog: Catalog = DEFAULT_CATALOG
) -> DataFrame:
    """Visible rows: (doc_key, the catalog's columns, run_id)."""
    names = results_schema(catalog).names
    stored = T.StructType([T.StructField(n, T.StringType()) for n in (*names[:-1], "attempt")])
    rows = read_parquet_if_there(spark, out, stored)
    runs = read_runs(spark, ledger)
    visible = rows.join(runs.select("attempt", "run_id"), "attempt")
    rivals = overlapping_runs(runs)
    if not rivals.isEmpty():
        held = rows.select("doc_key", "attempt").join(rivals, "attempt")
        first = held.groupBy("doc_key").agg(F.min(F.struct("finished_at", "attempt"))["attempt"].alias("first"), F.count("*").alias("n"))
        second = held.join(first.where(F.col("n") > 1), "doc_key").where(F.col("attempt") != F.col("first"))
        visible = visible.join(second.select("doc_key", "attempt"), ["doc_key", "attempt"], "left_anti")
    return visible.select(*(f"`{n}`" for n in names))


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """(attempt, finished_at) of the runs that were not alone: a row per run goes in, no more.

    A commit is seen a little after the time it notes, so runs within
    ``COMMIT_MINUTES`` of each other count.
    """
    until = F.col("finished_at") + F.make_interval(mins=F.lit(COMMIT_MINUTES))
    in_order = Window.orderBy("started_at", "attempt")
    before = F.max(until).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("started_at").over(in_order)
    timed = runs.where(F.col("started_at").isNotNull()).select("attempt", "finished_at", "succeeded", before.alias("before"), after.alias("after"), "started_at", until.alias("until"))
    rivals = timed.where((F.col("succeeded") > 0) & ((F.col("started_at") < F.col("before")) | (F.col("after") < F.col("until"))))
    return rivals.select("attempt", "finished_at")


def count_output_rows(spark: SparkSession, out: str, ledger: str, catalog: Catalog = DEFAULT_CATALOG) -> int:
    """Visible data rows, 0 when there is no output yet."""
    return read_results(spark, out, ledger, catalog).count()


def export_csv(rows: DataFrame, path: str, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> None:
    """Results in key order as CSV with the catalog's header."""
    ordered = rows.orderBy(key).select(*(f"`{c}`" for c in catalog.columns))
    # Cells go out as they are: Spark would otherwise trim blanks at their ends.
    kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    ordered.write.mode("overwrite").options(header="true", escape='"', **kept).csv(path)
