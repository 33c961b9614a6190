"""Run control: what is pending, what came of it, how the run went.

The ledger is an append-only table of events. Its current state is a fold, and
folds here are plain aggregations that combine before the shuffle, so a
document with very many events costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrow.operators.answers import first_problem, whole_answers, whole_document
from siftrow.operators.catalog import DEFAULT_CATALOG, Catalog

DONE = "done"
FAILED = "failed"

# Exit codes of a run; 1 is a raised GuardError.
ALL_FINE = 0
SOME_FAILED = 2

LEDGER_SCHEMA = (
    "doc_key string, status string, stage string, reason string, run_id string, at timestamp, version int"
)


def fold_ledger(events: DataFrame, key: str = "doc_key") -> DataFrame:
    """Current state per document: (key, status, reason, at).

    Done is sticky and clears the reason. Otherwise the latest failure counts;
    of two at the same instant, the greater reason.
    """
    latest = F.max(F.when(F.col("status") == FAILED, F.struct("at", "reason")))
    return (
        events.groupBy(key)
        .agg(
            F.max(F.col("status") == DONE).alias("done"),
            F.max(F.when(F.col("status") == DONE, F.col("at"))).alias("done_at"),
            latest.alias("latest"),
        )
        .select(
            key,
            F.when(F.col("done"), DONE).otherwise(FAILED).alias("status"),
            F.when(~F.col("done"), F.col("latest.reason")).alias("reason"),
            F.when(F.col("done"), F.col("done_at")).otherwise(F.col("latest.at")).alias("at"),
        )
    )


def done_keys(events: DataFrame, key: str = "doc_key") -> DataFrame:
    """Keys of the documents that need no further work, each once."""
    return events.where(F.col("status") == DONE).select(key).distinct()


def pending_documents(docs: DataFrame, events: DataFrame, key: str = "doc_key") -> DataFrame:
    """Documents not yet done. Failed ones stay pending and are tried again.

    Run it on names before any content is read. No join hint: Spark broadcasts
    the finished keys while they are small and shuffles keys when they are not.
    """
    return docs.join(done_keys(events, key), key, "left_anti")


def outcome(responses: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """One outcome per tried document: (key, status, stage, reason).

    ``responses`` holds a row per batch, or a single row with a ``stage`` of
    ``read`` or ``blank`` and no batch for a document that never got that far.
    Batches run side by side, so the first failing one is found by its ordinal.
    """
    order = F.coalesce(F.col("batch_ordinal"), F.lit(0))
    first = F.min(F.when(F.col("error").isNotNull(), F.struct(order.alias("order"), "stage", "error")))
    folded = responses.groupBy(key).agg(first.alias("first"), whole_document(catalog).alias("complete"))
    done = F.col("complete")
    return folded.select(
        key,
        F.when(done, DONE).otherwise(FAILED).alias("status"),
        F.when(~done, F.coalesce(F.col("first.stage"), F.lit("extract"))).alias("stage"),
        F.when(~done, F.coalesce(F.col("first.error"), F.lit("not every batch was answered"))).alias("reason"),
    )


def document_outcome(documents: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """The same from nested answers, a row per document: (key, status, stage, reason), without a shuffle.

    ``documents`` holds (key, stage, error, answers); a document that never got
    to a call has its ``stage`` and ``error``, all others null there.
    """
    done = F.col("error").isNull() & whole_answers(F.col("answers"), catalog)
    reason = F.coalesce("error", first_problem(F.col("answers")), F.lit("not every batch was answered"))
    return documents.select(
        key,
        F.when(done, DONE).otherwise(FAILED).alias("status"),
        # A text that was cut is told from its stage, also where all went well.
        F.coalesce("stage", F.when(~done, "extract")).alias("stage"),
        F.when(~done, reason).alias("reason"),
    )


def failures_report(events: DataFrame, key: str = "doc_key") -> DataFrame:
    """Outstanding failures (key, reason) in key order."""
    return fold_ledger(events, key).where(F.col("status") == FAILED).select(key, "reason").orderBy(key)


def run_verdict(failed_outstanding: Column) -> Column:
    """0 when nothing is outstanding, 2 otherwise."""
    return F.when(failed_outstanding > 0, SOME_FAILED).otherwise(ALL_FINE).alias("verdict")


def run_summary(docs: DataFrame, events: DataFrame, outcomes: DataFrame, key: str = "doc_key") -> DataFrame:
    """One row: total, skipped, succeeded, failed, failed_outstanding, verdict.

    ``events`` is the ledger before the run. ``failed`` counts this run;
    ``failed_outstanding`` counts every document whose last word is a failure,
    also one that has since left the folder, and decides the verdict.
    """
    # Three tagged key sets folded in one aggregation instead of joined.
    tagged = (
        docs.select(key, F.lit("doc").alias("origin"), F.lit(None).cast("string").alias("status"))
        .unionByName(events.select(key, F.lit("ledger").alias("origin"), "status"))
        .unionByName(outcomes.select(key, F.lit("run").alias("origin"), "status"))
    )
    def any_of(condition: Column) -> Column:
        return F.coalesce(F.max(condition), F.lit(False))

    state = tagged.groupBy(key).agg(
        any_of(F.col("origin") == "doc").alias("listed"),
        any_of((F.col("origin") == "ledger") & (F.col("status") == DONE)).alias("was_done"),
        any_of((F.col("origin") == "run") & (F.col("status") == DONE)).alias("now_done"),
        any_of((F.col("origin") == "run") & (F.col("status") == FAILED)).alias("now_failed"),
        any_of(F.col("status") == FAILED).alias("ever_failed"),
    )
    outstanding = F.col("ever_failed") & ~F.col("was_done") & ~F.col("now_done")
    counts = state.agg(
        F.count_if("listed").alias("total"),
        F.count_if(F.col("listed") & F.col("was_done")).alias("skipped"),
        F.count_if("now_done").alias("succeeded"),
        F.count_if("now_failed").alias("failed"),
        F.count_if(outstanding).alias("failed_outstanding"),
    )
    return counts.select("*", run_verdict(F.col("failed_outstanding")))
