"""The ledger on storage, and its JSON snapshot.

Layout under the ledger folder::

    started/*/part-*.parquet           one row per attempt at a run
    events/attempt=.../part-*.parquet  what came of each document
    runs/*/part-*.parquet              one row per finished run, with its attempt
    compactions/*/part-*.parquet       one row per compaction: its attempt, and the attempts whose events it replaces

An attempt writes its events with as many tasks as it likes into a folder of its
own, then commits by adding one row, that is one file, to ``runs``. Readers take
only events of committed attempts, so they see a run whole or not at all, and no
folder is ever written twice. An attempt that is in ``started`` and not in
``runs`` died on the way; its staged answers can be used again.

``compact_ledger`` folds all events into one per document, under an attempt of
its own, and commits by one row that names the attempts it stands for. Readers
then take that attempt in their place. ``vacuum`` later removes what no reader
takes any more.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrow.errors import GuardError
from siftrow.operators.ledger import DONE, FAILED, LEDGER_SCHEMA, fold_ledger, run_verdict
from siftrow.sources.paths import add_rows, read_added, read_parquet_if_there, remove

# Fixed value: the only ledger version there is.
LEDGER_VERSION = 1

RUNS_SCHEMA = (
    "run_id string, version int, total bigint, skipped bigint, succeeded bigint, failed bigint, "
    "failed_outstanding bigint, verdict int, started_at timestamp, finished_at timestamp, attempt string"
)

EVENT_SCHEMA = "doc_key string, status string, stage string, reason string, at timestamp, version int"
COMPACTIONS_SCHEMA = "attempt string, covers array<string>, at timestamp"
STARTED_SCHEMA = "attempt string, run_id string, started_at timestamp"

SNAPSHOT_SCHEMA = (
    "version int, started_at string, updated_at string, processed array<string>, failed map<string,string>"
)

# Documents in one line of a snapshot, about. It sets how many lines there are, not what they hold.
DOCS_PER_SNAPSHOT_ROW = 10_000
# Fixed value: how a snapshot writes an instant.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def read_runs(spark: SparkSession, ledger: str) -> DataFrame:
    """Committed runs, after the version guard."""
    runs = read_added(spark, f"{ledger}/runs", RUNS_SCHEMA)
    require_version(runs, ledger)
    return runs


def require_version(versioned: DataFrame, name: str) -> None:
    """Guard: every row carries the known version and can be read at all."""
    try:
        other = versioned.where(~F.col("version").eqNullSafe(F.lit(LEDGER_VERSION))).select("version").head(1)
    except Exception as exc:
        raise GuardError(f"could not read ledger {name}: {exc}") from exc
    if other:
        raise GuardError(f"ledger {name} has version {other[0][0]!r}, expected {LEDGER_VERSION}")


def live_attempts(spark: SparkSession, ledger: str) -> DataFrame:
    """(attempt, run_id) whose events make up the ledger: committed and not replaced. A compaction has no run_id."""
    compactions = read_added(spark, f"{ledger}/compactions", COMPACTIONS_SCHEMA)
    every = read_runs(spark, ledger).select("attempt", "run_id").unionByName(
        compactions.select("attempt", F.lit(None).cast("string").alias("run_id"))
    )
    return every.join(compactions.select(F.explode("covers").alias("attempt")).distinct(), "attempt", "left_anti")


def read_ledger(spark: SparkSession, ledger: str, runs: DataFrame | None = None) -> DataFrame:
    """Events of all committed runs, or of ``runs``; no rows when there is no ledger yet.

    After a compaction earlier runs are there as one event per document, that of its last word.
    """
    taken = live_attempts(spark, ledger) if runs is None else runs.select("attempt", "run_id")
    stored = T.StructType.fromDDL(EVENT_SCHEMA).add("run_id", T.StringType()).add("attempt", T.StringType())
    events = read_parquet_if_there(spark, f"{ledger}/events", stored)
    names = T.StructType.fromDDL(LEDGER_SCHEMA).names
    by_attempt = taken.select("attempt", F.col("run_id").alias("_run"))
    return events.join(by_attempt, "attempt").withColumn("run_id", F.coalesce("_run", "run_id")).select(*names)


def last_words(events: DataFrame, key: str = "doc_key") -> DataFrame:
    """One event per document, of which the fold makes the same state as of all.

    Done stays: the latest of them. Otherwise the latest failure, of two at the
    same instant the one of the greater reason.
    """
    word = F.struct("at", "reason", "stage", "run_id", "version")
    done = F.col("status") == DONE
    folded = events.groupBy(key).agg(F.max(F.when(done, word)).alias("done"), F.max(F.when(~done, word)).alias("failed"))
    last = F.coalesce("done", "failed")
    return folded.select(
        key,
        F.when(F.col("done").isNotNull(), DONE).otherwise(FAILED).alias("status"),
        *(last[c].alias(c) for c in ("stage", "reason", "at", "version", "run_id")),
    )


def compact_ledger(spark: SparkSession, ledger: str) -> int:
    """Fold the history into one event per document; number of attempts replaced.

    Runs may go on meanwhile: what they commit is not among the attempts that
    are replaced. A crash before the last row leaves the ledger as it was.
    """
    now, attempt = datetime.now(UTC), f"compacted-{uuid.uuid4().hex}"
    # Fixed first, so that the fold and the row that commits it are about the same attempts. A name per run, no more.
    covered = [r.attempt for r in live_attempts(spark, ledger).select("attempt").collect()]
    if len(covered) < 2:
        return 0
    names = spark.createDataFrame([(a,) for a in covered], "attempt string")
    run_ids = read_runs(spark, ledger).select("attempt", "run_id")
    last = last_words(read_ledger(spark, ledger, names.join(run_ids, "attempt", "left")))
    last.write.mode("overwrite").parquet(f"{ledger}/events/attempt={attempt}")
    row = spark.createDataFrame([(attempt, covered, now)], COMPACTIONS_SCHEMA)
    add_rows(row, f"{ledger}/compactions")
    return len(covered)


def vacuum(spark: SparkSession, out: str, ledger: str, older_than_hours: float = 168.0) -> int:
    """Remove what nothing reads any more; number of folders removed.

    These are the events of attempts that a compaction replaced, the answers and
    work tables of committed runs but for documents that failed, and all that
    dead attempts left. Only what is older than ``older_than_hours`` goes: a run
    still on its way looks like a dead one, and a reader may hold an older list.
    """
    limit = F.current_timestamp() - F.make_interval(secs=F.lit(older_than_hours * 3600.0))
    compactions = read_added(spark, f"{ledger}/compactions", COMPACTIONS_SCHEMA).where(F.col("at") < limit)
    replaced = [r.attempt for r in compactions.select(F.explode("covers").alias("attempt")).distinct().collect()]
    runs = read_runs(spark, ledger)
    finished = [r.attempt for r in runs.where(F.col("finished_at") < limit).select("attempt").collect()]
    started = read_added(spark, f"{ledger}/started", STARTED_SCHEMA).where(F.col("started_at") < limit)
    dead = [r.attempt for r in started.select("attempt").distinct().join(runs.select("attempt"), "attempt", "left_anti").collect()]
    folders = [f"{ledger}/events/attempt={a}" for a in [*replaced, *dead]]
    folders += [f"{out}/_work/attempt={a}" for a in [*finished, *dead]]
    folders += [f"{out}/_answers/attempt={a}/complete=true" for a in finished]
    folders += [f"{out}/{part}attempt={a}" for a in dead for part in ("", "_answers/")]
    return sum(remove(spark, folder) for folder in folders)


def write_events(events: DataFrame, ledger: str, attempt: str) -> None:
    """Write an attempt's events. Not visible before :func:`commit_run`."""
    names = T.StructType.fromDDL(EVENT_SCHEMA).names
    events.select(*names).write.mode("overwrite").parquet(f"{ledger}/events/attempt={attempt}")


def start_attempt(spark: SparkSession, ledger: str, attempt: str, run_id: str, at: datetime) -> None:
    """Note that an attempt begins, before it stages anything."""
    row = spark.range(1, numPartitions=1).select(
        F.lit(attempt).alias("attempt"), F.lit(run_id).alias("run_id"), F.lit(at).alias("started_at")
    )
    add_rows(row, f"{ledger}/started")


def open_attempts(spark: SparkSession, ledger: str, runs: DataFrame) -> DataFrame:
    """All attempts (attempt) that never committed, whatever was committed since."""
    started = read_added(spark, f"{ledger}/started", STARTED_SCHEMA)
    return started.select("attempt").distinct().join(runs.select("attempt"), "attempt", "left_anti")


def commit_run(run: DataFrame, ledger: str) -> None:
    """Add the one row that makes a run visible. The row is one file."""
    names = T.StructType.fromDDL(RUNS_SCHEMA).names
    add_rows(run.select(*names), f"{ledger}/runs")


def iso_utc(at: Column) -> Column:
    """An instant as ISO-8601 text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), ISO_FORMAT)


def snapshot(events: DataFrame, shard: Column | int, key: str = "doc_key") -> DataFrame:
    """The folded ledger as rows of (version, started_at, updated_at, processed, failed).

    ``processed`` is sorted. ``shard`` is an expression over the key that splits
    the documents over rows, or a number of rows: these are then ranges of the
    key, in ascending order.
    """
    state = fold_ledger(events, key)
    ranges = isinstance(shard, int)
    if ranges:
        state = state.repartitionByRange(shard, key).withColumn("_shard", F.spark_partition_id())
    else:
        state = state.withColumn("_shard", shard)
    done = F.col("status") == DONE
    failures = F.collect_list(F.when(~done, F.struct(F.col(key), F.coalesce("reason", F.lit("")).alias("reason"))))
    rows = state.groupBy("_shard").agg(
        F.sort_array(F.collect_list(F.when(done, F.col(key)))).alias("processed"),
        F.map_from_entries(F.sort_array(failures)).alias("failed"),
    )
    rows = rows.orderBy("_shard") if ranges else rows
    return rows.select(
        F.lit(LEDGER_VERSION).alias("version"),
        iso_utc(events.select(F.min("at")).scalar()).alias("started_at"),
        iso_utc(events.select(F.max("at")).scalar()).alias("updated_at"),
        "processed",
        "failed",
    )


def write_snapshot(events: DataFrame, path: str, docs_per_row: int = DOCS_PER_SNAPSHOT_ROW) -> None:
    """Write the snapshot as JSON, one object per line.

    The lines are ranges of the key in ascending order, each of about
    ``docs_per_row`` documents, so ``processed`` is sorted over all of them.
    """
    keys = events.select("doc_key").distinct().count()
    if keys == 0:
        whole = _empty_snapshot(events.sparkSession)
    else:
        whole = snapshot(events, -(-keys // docs_per_row))
    whole.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def _empty_snapshot(spark: SparkSession) -> DataFrame:
    now = iso_utc(F.current_timestamp())
    return spark.range(1).select(
        F.lit(LEDGER_VERSION).alias("version"),
        now.alias("started_at"),
        now.alias("updated_at"),
        F.array().cast("array<string>").alias("processed"),
        F.create_map().cast("map<string,string>").alias("failed"),
    )


def read_snapshot(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Ledger events from a JSON snapshot. Broken JSON or another version is an error.

    ``multi_line`` reads files that hold one object over many lines.
    """
    rows = (
        spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)
    )
    require_version(rows, path)
    try:
        # Every column has to be read whole, so that a file cut off after its version is refused too.
        rows.agg(*(F.max(F.length(F.to_json(F.struct(c)))) for c in rows.columns)).collect()
    except Exception as exc:
        raise GuardError(f"could not read ledger {path}: {exc}") from exc
    return snapshot_events(rows)


def import_snapshot(spark: SparkSession, path: str, ledger: str, multi_line: bool = False) -> None:
    """Commit a snapshot to a ledger, so that a job begun elsewhere goes on here.

    Each document takes its last word in the snapshot. What the ledger already
    holds stays and the later word counts, as everywhere. The run id is new at
    each import; a second import of one file changes no state.
    """
    read_runs(spark, ledger)
    state = fold_ledger(read_snapshot(spark, path, multi_line))
    now, attempt = datetime.now(UTC), f"snapshot-{uuid.uuid4().hex}"
    stage = F.lit(None).cast("string").alias("stage")
    start_attempt(spark, ledger, attempt, attempt, now)
    write_events(state.select("doc_key", "status", stage, "reason", "at", F.lit(LEDGER_VERSION).alias("version")), ledger, attempt)
    written = spark.read.schema(EVENT_SCHEMA).parquet(f"{ledger}/events/attempt={attempt}")
    failed = F.count_if(F.col("status") == FAILED)
    counts = written.agg(
        F.count("*").alias("total"),
        F.lit(0).cast("bigint").alias("skipped"),
        F.count_if(F.col("status") == DONE).alias("succeeded"),
        failed.alias("failed"),
        failed.alias("failed_outstanding"),
        run_verdict(failed),
    )
    commit_run(
        counts.select(
            F.lit(attempt).alias("run_id"),
            F.lit(LEDGER_VERSION).alias("version"),
            "*",
            F.lit(now).alias("started_at"),
            F.current_timestamp().alias("finished_at"),
            F.lit(attempt).alias("attempt"),
        ),
        ledger,
    )


def snapshot_events(rows: DataFrame) -> DataFrame:
    """Snapshot rows to ledger events, one per document and list."""
    base = rows.withColumn("at", F.to_timestamp("updated_at"))

    def events(entries: Column, status: str) -> DataFrame:
        exploded = base.select("version", "at", F.explode(entries).alias("e"))
        failed = status == FAILED
        return exploded.select(
            (F.col("e.key") if failed else F.col("e")).alias("doc_key"),
            F.lit(status).alias("status"),
            F.lit(None).cast("string").alias("stage"),
            (F.col("e.value") if failed else F.lit(None).cast("string")).alias("reason"),
            F.lit("snapshot").alias("run_id"),
            "at",
            "version",
        )

    return events(F.col("processed"), DONE).unionByName(events(F.map_entries("failed"), FAILED))
