"""New documents, and those due for another attempt, by Structured Streaming.

The file source remembers which files it has handed out; each micro-batch goes
through the same job as a batch run. The keyed state of the stream is the
ledger: a key that was finished in any batch, of this stream or another on the
same ledger, is not worked on again. The texts of documents that failed are kept
beside the output, in ``_again``, and handed out by later triggers once they are
due, so a failure is retried like in a repeated batch run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.operators.ledger import DONE, FAILED
from siftrow.plans.run import run
from siftrow.sources.ledger import EVENT_SCHEMA, read_ledger, read_runs
from siftrow.sources.paths import read_parquet_if_there

AGAIN_SCHEMA = "doc_key string, text string, reason string, kept_at timestamp"
#: Seconds until a failed document is due again; doubled with each failure.
RETRY_AFTER = 600.0
#: A document that failed so often is left to a batch run.
MAX_TRIES = 8


def one_per_key(batch: DataFrame) -> DataFrame:
    """Of the rows with one key, one that can be read, of these the one of the smallest text.

    Doubles are found on keys alone. Where there are none, no text moves; else
    only theirs are gathered, and these one by one.
    """
    twice = batch.groupBy("doc_key").count().where("count > 1").select("doc_key")
    if twice.isEmpty():
        return batch
    reason = F.col("reason") if "reason" in batch.columns else F.lit(None)
    order = F.struct((F.col("text").isNull() | reason.isNotNull()).alias("unread"), F.col("text"))
    # doc_key may be null: such rows are one key, as in an aggregation.
    double = batch.join(twice.withColumnRenamed("doc_key", "_twice"), F.col("doc_key").eqNullSafe(F.col("_twice")), "left_semi")
    single = batch.join(twice.withColumnRenamed("doc_key", "_twice"), F.col("doc_key").eqNullSafe(F.col("_twice")), "left_anti")
    settled = double.groupBy("doc_key").agg(F.min_by(F.struct(*batch.columns), order).alias("_one")).select("_one.*")
    return single.unionByName(settled)


def due_documents(
    spark: SparkSession,
    out: str,
    ledger: str,
    retry_after: float = RETRY_AFTER,
    max_tries: int = MAX_TRIES,
    now: datetime | None = None,
) -> DataFrame:
    """(doc_key, text, reason) of failed documents whose next attempt is due ``now``.

    How often and when a document failed is in the ledger; the wait doubles with
    each failure. After ``compact_ledger`` its failures count as one.
    """
    kept = read_parquet_if_there(spark, f"{out}/_again", AGAIN_SCHEMA)
    state = read_ledger(spark, ledger).groupBy("doc_key").agg(
        F.max(F.col("status") == DONE).alias("done"),
        F.count_if(F.col("status") == FAILED).alias("tries"),
        F.max("at").alias("last"),
    )
    wait = F.lit(retry_after) * F.pow(F.lit(2.0), F.col("tries") - 1)
    # One instant, however often the result is evaluated.
    at = F.lit(now or datetime.now(UTC))
    over = F.unix_micros(at) - F.unix_micros("last") >= wait * 1e6
    due = state.where(~F.col("done") & (F.col("tries") < max_tries) & over).select("doc_key")
    # The last text kept for a key, found on keys and times.
    newest = kept.groupBy("doc_key").agg(F.max("kept_at").alias("kept_at")).join(due, "doc_key", "left_semi")
    return kept.join(newest, ["doc_key", "kept_at"], "left_semi").drop("kept_at")


def keep_failed(spark: SparkSession, docs: DataFrame, out: str, ledger: str, run_id: str) -> None:
    """Keep the texts of the documents that failed in a committed run, in a folder of that run's own."""
    done = read_runs(spark, ledger).where(F.col("run_id") == run_id).select("attempt", "started_at").head()
    if done is None:
        return
    events = read_parquet_if_there(spark, f"{ledger}/events/attempt={done.attempt}", EVENT_SCHEMA)
    failed = events.where(F.col("status") == FAILED).select("doc_key")
    reason = F.col("reason") if "reason" in docs.columns else F.lit(None).cast("string")
    again = docs.join(failed, "doc_key", "left_semi").select("doc_key", "text", reason.alias("reason"), F.lit(done.started_at).alias("kept_at"))
    again.write.mode("overwrite").parquet(f"{out}/_again/run={run_id}")


def incremental_run(
    spark: SparkSession,
    stream: DataFrame,
    extractor: Callable[[Mapping], str],
    out: str,
    ledger: str,
    checkpoint: str,
    *,
    retry_after: float = RETRY_AFTER,
    max_tries: int = MAX_TRIES,
    **options,
) -> int:
    """Process everything that is new in ``stream`` or due again, and stop; number of batches run.

    ``stream`` is a streaming DataFrame with (doc_key, text[, reason]). The run
    id is the id that the checkpoint keeps for its stream, with the batch id: a
    batch that is repeated after a crash either finds its run committed or
    redoes it under the same id, so rows are never doubled, and another stream
    or a new checkpoint on the same ledger never meets the ids of this one. Of
    files with one key in a batch a readable one is taken (``one_per_key``); a
    key that another batch has finished is skipped.

    Documents that failed before are part of the first batch after they are due:
    ``retry_after`` seconds after a first failure, twice as long after each
    further one, ``max_tries`` times in all. Where nothing new arrived they are
    a batch of their own. Batches take ``options`` as :func:`run` does.
    """
    done: list[int] = []

    def work(session: SparkSession, docs: DataFrame | None, run_id: str) -> bool:
        again = due_documents(session, out, ledger, retry_after, max_tries)
        if docs is not None:
            # A new copy of a document takes the place of the one that was kept.
            columns = [c for c in ("doc_key", "text", "reason") if c in docs.columns]
            again = again.join(docs.select("doc_key"), "doc_key", "left_anti")
            again = docs.select(*columns).unionByName(again, allowMissingColumns=True)
        elif again.isEmpty():
            return False
        # The texts that are due stay as they were, whatever this run adds to them.
        run(session, again, extractor, out, ledger, run_id=run_id, **options)
        keep_failed(session, again, out, ledger, run_id)
        return True

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not batch.isEmpty():
            done.append(batch_id)
        work(session, one_per_key(batch), f"{stream_id}-{batch_id:09d}")

    query = (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not done and work(spark, None, f"again-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"):
        return 1
    return len(set(done))
