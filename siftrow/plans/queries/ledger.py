"""Run control queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrow.operators.catalog import DEFAULT_CATALOG
from siftrow.operators.ledger import (
    document_outcome,
    failures_report,
    fold_ledger,
    outcome,
    pending_documents,
    run_summary,
)
from siftrow.operators.requests import batch_array, fan_out
from siftrow.plans.queries.registry import DOC_KEY, documents, query, table
from siftrow.plans.run import stage_problem
from siftrow.sources.ledger import (
    LEDGER_VERSION,
    RUNS_SCHEMA,
    commit_run,
    compact_ledger,
    iso_utc,
    read_ledger,
    read_snapshot,
    snapshot,
    write_events,
    write_snapshot,
)
from siftrow.sources.paths import scratch_folder


def label_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a ledger: good quality is done, the rest failed."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("doc_key"),
        F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"),
        F.when(F.col("quality") == 0, "poor quality").alias("reason"),
    )


@query(
    f"""
SELECT {DOC_KEY}, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
"""
)
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_documents(documents(spark, sf_dir, "lang"), label_ledger(spark, sf_dir))


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger, one document per user and day: errors fail, purchases finish."""
    ts = F.col("ts")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("error", "purchase"))
        .select(
            F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format(ts, "yyyy-MM-dd")).alias("doc_key"),
            F.when(F.col("event_type") == "purchase", "done").otherwise("failed").alias("status"),
            F.when(F.col("event_type") == "error", F.col("props")).alias("reason"),
            # The table's clock is UTC, also in a session of another time zone.
            F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()).alias("at"),
            F.lit(LEDGER_VERSION).alias("version"),
        )
    )


# Snapshot rows hold this many users of one day, however many users there are.
USERS_PER_ROW = 50

FOLD_SQL = """
SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS doc_key,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN NOT bool_or(event_type = 'purchase') THEN arg_max(props, ts) FILTER (WHERE event_type = 'error') END AS reason
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1
"""


@query(FOLD_SQL)
def folded_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_ledger(event_ledger(spark, sf_dir)).select("doc_key", "status", "reason")


@query(f"SELECT doc_key, reason FROM ({FOLD_SQL}) WHERE status = 'failed'")
def outstanding_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures_report(event_ledger(spark, sf_dir))


@query(
    f"""
WITH span AS (SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS started_at,
    strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS updated_at FROM events WHERE event_type IN ('error', 'purchase')),
rows AS (SELECT
    coalesce(string_agg(doc_key, ',' ORDER BY doc_key) FILTER (WHERE status = 'done'), '') AS processed,
    coalesce(string_agg(doc_key || '=' || reason, ',' ORDER BY doc_key) FILTER (WHERE status = 'failed'), '') AS failed
  FROM ({FOLD_SQL})
  GROUP BY split_part(doc_key, '/', 2), CAST(split_part(doc_key, '/', 1) AS BIGINT) // {USERS_PER_ROW})
SELECT 1 AS version, started_at, updated_at, processed, failed FROM rows CROSS JOIN span
"""
)
def ledger_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot with one row per day and some users, its list and map shown as text."""
    user = F.floor(F.split_part("doc_key", F.lit("/"), F.lit(1)).cast("bigint") / USERS_PER_ROW)
    shard = F.struct(F.split_part("doc_key", F.lit("/"), F.lit(2)), user)
    rows = snapshot(event_ledger(spark, sf_dir), shard)
    entries = F.transform(F.array_sort(F.map_entries("failed")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "version",
        "started_at",
        "updated_at",
        F.array_join("processed", ",").alias("processed"),
        F.array_join(entries, ",").alias("failed"),
    )


@query(FOLD_SQL)
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger to JSON snapshot on storage, read back and folded again."""
    path = scratch_folder(spark)
    write_snapshot(event_ledger(spark, sf_dir), path, docs_per_row=1_000)
    return fold_ledger(read_snapshot(spark, path)).select("doc_key", "status", "reason")


def troubled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source cannot be read, those of another are blank."""
    docs = documents(spark, sf_dir, "text", "source")
    text = F.when(F.col("source") == "src5", F.lit(" \t\n")).when(F.col("source") != "src3", F.col("text"))
    return docs.withColumn("text", text)


_TROUBLED_SQL = f"""
SELECT {DOC_KEY}, source, CASE WHEN source = 'src5' THEN ' ' WHEN source <> 'src3' THEN text END AS text FROM documents
"""


@query(
    f"""
SELECT doc_key, CASE WHEN stage IS NULL THEN 'done' ELSE 'failed' END AS status, stage,
  CASE stage WHEN 'read' THEN 'could not open: no readable text' WHEN 'blank' THEN 'no extractable text'
    WHEN 'extract' THEN 'failed in bibliographic' END AS reason
FROM (SELECT doc_key, CASE WHEN text IS NULL THEN 'read' WHEN trim(text) = '' THEN 'blank'
    WHEN source = 'src7' THEN 'extract' END AS stage FROM ({_TROUBLED_SQL}))
"""
)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage fails for some documents; source 7 fails in batches 2 and 9."""
    docs = troubled_documents(spark, sf_dir)
    failing = F.col("source") == "src7"
    answers = F.transform(
        batch_array(DEFAULT_CATALOG),
        lambda b: F.struct(
            b["batch"].alias("batch"),
            b["batch_ordinal"].alias("batch_ordinal"),
            F.when(failing & b["batch"].isin("bibliographic", "modeling"), F.concat(F.lit("failed in "), b["batch"])).alias("error"),
        ),
    )
    problem = stage_problem(F.col("text"))
    staged = docs.select("doc_key", problem["stage"].alias("stage"), problem["error"].alias("error"), answers.alias("answers"))
    return document_outcome(staged)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang")
    events = (
        label_ledger(spark, sf_dir)
        .select("doc_key", "status")
        # Documents that failed once and have since left the folder.
        .unionByName(
            table(spark, sf_dir, "benchmark").select(
                F.concat(F.lit("gone-"), "item_id").alias("doc_key"), F.lit("failed").alias("status")
            )
        )
    )
    tried = fan_out(pending_documents(docs, events)).drop("instruction")
    failing = (F.col("lang") == "de") & (F.col("batch") == "review")
    rows = tried.select(
        "doc_key", "batch", "batch_ordinal", F.lit("extract").alias("stage"), F.when(failing, "no").alias("error")
    )
    return run_summary(docs, events, outcome(rows))


@query(
    """
WITH done AS (SELECT doc_id FROM labels WHERE quality = 1),
tried AS (SELECT doc_id, lang = 'de' AS bad FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done)),
c AS (SELECT (SELECT count(*) FROM documents) AS total,
  (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM done)) AS skipped,
  (SELECT count(*) FROM tried WHERE NOT bad) AS succeeded,
  (SELECT count(*) FROM tried WHERE bad) AS failed,
  (SELECT count(*) FROM (
     SELECT CAST(doc_id AS VARCHAR) AS k FROM tried WHERE bad
     UNION SELECT 'gone-' || item_id FROM benchmark
     UNION SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0
       AND doc_id NOT IN (SELECT doc_id FROM tried WHERE NOT bad))) AS failed_outstanding)
SELECT *, CASE WHEN failed_outstanding > 0 THEN 2 ELSE 0 END AS verdict FROM c
"""
)
def summary_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)




@query(
    """
SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS doc_key,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN NOT bool_or(event_type = 'purchase') THEN arg_max(props, ts) FILTER (WHERE event_type = 'error') END AS reason,
  strftime(max(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS done_at,
  CAST(1 AS BIGINT) AS events
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1
"""
)
def compacted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events committed as several runs, folded on storage twice, with a run after the first: one event each is left."""
    ledger = scratch_folder(spark)
    events = event_ledger(spark, sf_dir).withColumn("stage", F.lit(None).cast("string"))
    for part in range(4):
        attempt = f"part-{part}"
        write_events(events.where(F.pmod(F.xxhash64("reason", "at"), F.lit(4)) == part), ledger, attempt)
        commit_part(spark, ledger, attempt)
        if part == 2:
            compact_ledger(spark, ledger)
    compact_ledger(spark, ledger)
    left = read_ledger(spark, ledger)
    state = fold_ledger(left).join(left.groupBy("doc_key").agg(F.count("*").alias("events")), "doc_key")
    done_at = F.when(F.col("status") == "done", iso_utc(F.col("at")))
    return state.select("doc_key", "status", "reason", done_at.alias("done_at"), "events")


def commit_part(spark: SparkSession, ledger: str, run_id: str) -> None:
    """Commit an attempt that was written by hand, under its own name as run id."""
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(run_id).alias("attempt"), F.lit(LEDGER_VERSION).alias("version"))
    fields = T.StructType.fromDDL(RUNS_SCHEMA).fields
    unset = (F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in row.columns)
    commit_run(row.select("*", *unset), ledger)
