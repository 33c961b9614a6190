"""The whole job: documents in, one row per document out, resumable.

Each stage that costs calls is written once and read back, so nothing runs
twice and a lost executor repeats only its own tasks:

1. guards: header, ledger version, unique document keys;
2. names only: which documents are pending, which answers are there already;
3. one pass over the texts: clean, trim, one trip to Python per document, strict
   parse, written to ``<out>/_answers/attempt=...``, a row per document;
4. results of whole documents to ``<out>/attempt=...``, a projection of these rows;
5. events to the ledger, another one, and last the row that commits the run.

A crash before the last step leaves nothing visible. The next run reuses every
good answer of earlier attempts, also of documents that failed in committed
runs, as long as the text and what the batch asks for are still the same.

Runs over one output may overlap. Each looks at the ledger again before it
commits and leaves out what another has finished since; see ``read_results``
for what is left of the race.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrow.errors import GuardError
from siftrow.functions.text import is_blank, truncate_middle
from siftrow.operators.answers import ANSWER_TYPE, flatten_row, merge_answers, parse_answers, whole_answers
from siftrow.operators.catalog import DEFAULT_CATALOG, Catalog, batch_fingerprints, require_header
from siftrow.operators.extract import MAX_ATTEMPTS, TRANSIENT, exponential_wait, extract_documents
from siftrow.operators.ledger import (
    FAILED,
    document_outcome,
    done_keys,
    fold_ledger,
    pending_documents,
    run_verdict,
)
from siftrow.operators.requests import SYSTEM_TEXT, batch_array, request_text
from siftrow.sources.documents import read_documents, read_header, scan_documents
from siftrow.sources.ledger import (
    EVENT_SCHEMA,
    LEDGER_VERSION,
    commit_run,
    open_attempts,
    read_ledger,
    read_runs,
    start_attempt,
    write_events,
)
from siftrow.sources.paths import read_parquet_if_there
from siftrow.sources.results import append_results

# A row per document. ``asked`` in its answers and ``text_md5`` tell whether an answer still fits.
STAGED_SCHEMA = (
    f"doc_key string, stage string, error string, text_md5 string, answers array<{ANSWER_TYPE}>, complete boolean"
)

# Where a document stopped, in order.
READ, BLANK, EXTRACT = "read", "blank", "extract"
# The stage of a document whose text was cut to the limit, finished or not.
EXTRACT_CUT = "extract: text cut"


def stage_problem(text: Column, reason: Column | None = None) -> Column:
    """Struct (stage, error) for a text that cannot be extracted from, else null."""
    unread = F.lit(None).cast("string") if reason is None else reason
    return F.when(
        text.isNull() | unread.isNotNull(),
        F.struct(
            F.lit(READ).alias("stage"),
            F.coalesce(unread, F.lit("could not open: no readable text")).alias("error"),
        ),
    ).when(
        is_blank(text),
        F.struct(F.lit(BLANK).alias("stage"), F.lit("no extractable text").alias("error")),
    )


def plan_requests(
    docs: DataFrame, catalog: Catalog = DEFAULT_CATALOG, limit: int | None = None
) -> DataFrame:
    """One request row per document and missing batch, in a single pass.

    Texts go whole unless a ``limit`` is given, beyond which their middle is left out.

    ``docs`` holds (doc_key, text) and may hold ``reason`` (why it could not be
    read) and ``have`` (batches that need no call). A document that cannot be
    extracted from gives one row with its ``stage`` and ``error`` and no batch.
    """
    reason = F.col("reason") if "reason" in docs.columns else None
    have = F.coalesce("have", F.array().cast("array<string>")) if "have" in docs.columns else None
    batches = batch_array(catalog)
    if have is not None:
        batches = F.filter(batches, lambda b: ~F.array_contains(F.col("have"), b["batch"]))
        batches = F.when(F.size(F.col("have")) == 0, batch_array(catalog)).otherwise(batches)
    nothing = F.array(F.lit(None).cast("struct<batch:string,batch_ordinal:int,instruction:string>"))
    base = docs.select(
        "doc_key",
        *([have.alias("have")] if have is not None else []),
        stage_problem(F.col("text"), reason).alias("problem"),
        (F.col("text") if limit is None else truncate_middle(F.col("text"), limit)).alias("text"),
    )
    fanned = base.select(
        "doc_key",
        "problem",
        "text",
        F.explode(F.when(F.col("problem").isNull(), batches).otherwise(nothing)).alias("b"),
    )
    return fanned.select(
        "doc_key",
        "b.batch",
        "b.batch_ordinal",
        F.coalesce("problem.stage", F.lit(EXTRACT)).alias("stage"),
        "problem.error",
        F.when(F.col("problem").isNull(), request_text(F.col("b.instruction"), F.col("text"))).alias("request"),
    )


def run(
    spark: SparkSession,
    docs: DataFrame,
    extractor: Callable[[Mapping], str],
    out: str,
    ledger: str,
    *,
    catalog: Catalog = DEFAULT_CATALOG,
    header: list[str] | None = None,
    run_id: str | None = None,
    limit: int | None = None,
    system: str | None = SYSTEM_TEXT,
    max_attempts: int = MAX_ATTEMPTS,
    wait: Callable[[int], float] = exponential_wait,
    transient: tuple[type[BaseException], ...] = TRANSIENT,
    per_task: bool = False,
    tasks: int | None = None,
    threads: int = 1,
    rounds: int = 1,
    requests_per_minute: int | None = None,
    listing: DataFrame | None = None,
    covered: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Run the job and return its one-row summary (see ``RUNS_SCHEMA``).

    ``docs`` holds (doc_key, text[, reason]). ``listing`` names all documents
    (doc_key) where ``docs`` holds only those still to be read; a document that
    it does not name is left alone. ``covered`` says that there is none, as with
    ``read_documents(only=...)`` of that listing, which saves a join. The
    extractor finds ``system`` in each request. Texts are whole unless ``limit``
    is given; the event of a document that it cut says so in its stage.

    ``tasks`` bounds how many tasks make calls, each ``threads`` at a time, and
    moves no text: parts of ``docs`` are put together, none is split.
    ``requests_per_minute`` needs it and is shared between the tasks. A task's
    answers are kept when it ends; ``rounds`` takes the documents in so many
    jobs, one after the other, so that long tasks end sooner. ``buckets`` says
    that ``docs`` is a table in so many buckets by doc_key
    (``store_documents``): then no text moves however long the list of pending
    names is. A run id that is already committed is not run again, which makes a
    repeated streaming batch harmless.
    """
    if header is not None:
        require_header(header, catalog)
    if requests_per_minute is not None and not tasks:
        raise GuardError("requests_per_minute needs a number of tasks to share it")
    pause = 60.0 * tasks / requests_per_minute if requests_per_minute else 0.0
    if str(spark.conf.get("spark.speculation", "false")).lower() == "true":
        warnings.warn("spark.speculation is on: a speculative task repeats paid calls", stacklevel=2)

    run_id = run_id or f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    started_at = datetime.now(UTC)
    runs = read_runs(spark, ledger)
    committed = runs.where(F.col("run_id") == run_id)
    if committed.head(1):
        return committed
    events = read_ledger(spark, ledger)

    attempt = f"{started_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
    if listing is not None and not covered:
        _require_unique(docs)
    start_attempt(spark, ledger, attempt, run_id, started_at)
    keys = (docs if listing is None else listing).select("doc_key")
    earlier = _earlier_answers(spark, out, ledger, runs, attempt)
    work = _Work(spark, keys, events, earlier, f"{out}/_work/attempt={attempt}", buckets)
    total, pending = work.count()
    todo = docs if pending == total and not work.has_kept and (listing is None or covered) else work.narrow(docs)
    asked = plan_documents(todo, catalog, limit, system)
    fresh = f"{out}/_answers/attempt={attempt}"
    for turn in range(rounds):
        part = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("doc_key"), F.lit(rounds)) == turn)
        called = extract_documents(
            part.coalesce(tasks) if tasks else part,
            extractor,
            catalog,
            max_attempts=max_attempts,
            wait=wait,
            transient=transient,
            per_task=per_task,
            seconds_between_calls=pause,
            system=system,
            threads=threads,
        )
        # Each task's answers are kept as soon as it ends; the folder is this attempt's alone.
        kept_by_task = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
        staged = stage_documents(called, catalog).write.mode("append").options(**kept_by_task)
        staged.partitionBy("complete").parquet(fresh)

    answered = spark.read.schema(STAGED_SCHEMA).parquet(fresh)
    # Documents that another run has finished since this one looked are left to it.
    newer = read_runs(spark, ledger).join(runs.select("attempt"), "attempt", "left_anti")
    overtaken = None if newer.isEmpty() else done_keys(read_ledger(spark, ledger, newer))
    tried = answered.select("doc_key")
    if overtaken is not None:
        answered = answered.join(overtaken, "doc_key", "left_anti")

    append_results(flatten_row(merge_answers(answered.where("complete"), catalog), catalog), out, attempt)

    outcomes = document_outcome(answered, catalog)
    if listing is not None:
        # A pending document that nobody read vanished between listing and reading.
        gone = work.pending().join(tried, "doc_key", "left_anti")
        outcomes = outcomes.unionByName(_gone(gone if overtaken is None else gone.join(overtaken, "doc_key", "left_anti")))
    finished = outcomes.select(
        "*", F.lit(started_at).alias("at"), F.lit(LEDGER_VERSION).alias("version")
    )
    write_events(finished, ledger, attempt)

    written = spark.read.schema(EVENT_SCHEMA).parquet(f"{ledger}/events/attempt={attempt}")
    before = events if overtaken is None else read_ledger(spark, ledger)
    summary = _summary(before, written, total).select(
        F.lit(run_id).alias("run_id"),
        F.lit(LEDGER_VERSION).alias("version"),
        "*",
        F.lit(started_at).alias("started_at"),
        F.current_timestamp().alias("finished_at"),
        F.lit(attempt).alias("attempt"),
    )
    commit_run(summary, ledger)
    work.drop()
    return read_runs(spark, ledger).where(F.col("run_id") == run_id)


def run_folder(
    spark: SparkSession,
    folder: str,
    extractor: Callable[[Mapping], str],
    out: str,
    ledger: str,
    *,
    suffix: str = ".txt",
    template: str | None = None,
    template_format: str = "csv",
    catalog: Catalog = DEFAULT_CATALOG,
    **options,
) -> DataFrame:
    """A folder of text files in, output rows out; see :func:`run`.

    The header of ``template`` is checked first. Finished documents are told
    from their names, so their files are not opened again.
    """
    header = None if template is None else read_header(spark, template, template_format)
    if header is not None:
        require_header(header, catalog)
    listing = scan_documents(spark, folder, suffix, ordered=False)
    pending = pending_documents(listing, read_ledger(spark, ledger))
    docs = read_documents(spark, folder, suffix, only=pending)
    return run(spark, docs, extractor, out, ledger, catalog=catalog, header=header, listing=listing, covered=True, **options)


def _summary(events: DataFrame, written: DataFrame, total: int) -> DataFrame:
    """Counts of a run from its events and the earlier ledger."""
    now = written.agg(F.count_if(F.col("status") != FAILED), F.count_if(F.col("status") == FAILED)).head()
    both = events.select("doc_key", "status", "reason", "at").unionByName(
        written.select("doc_key", "status", "reason", "at")
    )
    outstanding = fold_ledger(both).agg(F.count_if(F.col("status") == FAILED).alias("failed_outstanding"))
    return outstanding.select(
        F.lit(total).cast("bigint").alias("total"),
        F.lit(total - now[0] - now[1]).cast("bigint").alias("skipped"),
        F.lit(now[0]).cast("bigint").alias("succeeded"),
        F.lit(now[1]).cast("bigint").alias("failed"),
        "failed_outstanding",
        run_verdict(F.col("failed_outstanding")),
    )


def plan_documents(
    docs: DataFrame, catalog: Catalog = DEFAULT_CATALOG, limit: int | None = None, system: str | None = SYSTEM_TEXT
) -> DataFrame:
    """What goes to the extractor, a row per document, by a projection.

    ``docs`` holds (doc_key, text) and may hold ``reason`` (why it could not be
    read) and ``kept`` (good answers of earlier attempts). Adds ``stage`` and
    ``error`` where a document cannot be extracted from, ``cut`` where ``limit``
    shortened its text, and ``reuse``, ``have``: the kept answers that still fit
    the text and what their batch asks for.
    """
    reason = F.col("reason") if "reason" in docs.columns else None
    problem = stage_problem(F.col("text"), reason)
    kept = F.col("kept") if "kept" in docs.columns else F.lit(None).cast(KEPT_TYPE)
    text = F.col("text") if limit is None else truncate_middle(F.col("text"), limit)
    prints = batch_fingerprints(catalog, system)
    asked = F.create_map(*(F.lit(x) for item in prints.items() for x in item))
    base = docs.select(
        "doc_key",
        problem["stage"].alias("stage"),
        problem["error"].alias("error"),
        (F.lit(False) if limit is None else F.length("text") > limit).alias("cut"),
        F.when(problem.isNull(), text).alias("text"),
        kept.alias("kept"),
    ).withColumn("text_md5", F.md5("text"))
    fits = F.filter(
        F.coalesce("kept", F.array().cast(KEPT_TYPE)),
        lambda k: (k["text_md5"] == F.col("text_md5")) & (k["answer"]["asked"] == F.try_element_at(asked, k["answer"]["batch"])),
    )
    reuse = F.transform(fits, lambda k: k["answer"])
    return base.withColumn("reuse", reuse).withColumn("have", F.transform("reuse", lambda a: a["batch"])).drop("kept")


def stage_documents(called: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """The rows that are written (``STAGED_SCHEMA``): answers parsed, reused ones beside them."""
    parsed = called.withColumn("answers", F.concat(parse_answers(F.col("answers"), catalog), F.col("reuse")))
    complete = F.col("error").isNull() & whole_answers(F.col("answers"), catalog)
    stage = F.coalesce("stage", F.when(F.col("cut"), EXTRACT_CUT))
    names = T.StructType.fromDDL(STAGED_SCHEMA).names
    return parsed.withColumn("complete", complete).withColumn("stage", stage).select(*names)


def store_documents(docs: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """``docs`` as a table in buckets by doc_key, sorted there, for ``run(..., buckets=buckets)``.

    Texts are shuffled once, here; no later run over the table moves them.
    """
    writer = docs.repartition(buckets, "doc_key").write.bucketBy(buckets, "doc_key").sortBy("doc_key").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return docs.sparkSession.table(table)


def _gone(keys: DataFrame) -> DataFrame:
    return keys.select(
        "doc_key",
        F.lit(FAILED).alias("status"),
        F.lit(READ).alias("stage"),
        F.lit("could not open: the document is gone").alias("reason"),
    )


# An answer of an earlier attempt, with the digest of the text it was given.
KEPT_TYPE = f"array<struct<text_md5:string,answer:{ANSWER_TYPE}>>"


def _earlier_answers(spark: SparkSession, out: str, ledger: str, runs: DataFrame, attempt: str) -> DataFrame | None:
    """Good answers (doc_key, attempt, text_md5, answer) of attempts that died, and of
    documents that failed in committed ones.

    Attempt and completeness are partition columns, so what finished documents
    left is not read.
    """
    dead = open_attempts(spark, ledger, runs).where(F.col("attempt") != attempt)
    if runs.isEmpty() and dead.isEmpty():
        return None
    schema = T.StructType.fromDDL(STAGED_SCHEMA).add("attempt", T.StringType())
    found = read_parquet_if_there(spark, f"{out}/_answers", schema)
    failed = found.where(~F.col("complete")).join(runs.select("attempt"), "attempt", "left_semi")
    usable = found.join(dead, "attempt", "left_semi").unionByName(failed)
    good = F.filter("answers", lambda a: a["error"].isNull())
    return usable.select("doc_key", "attempt", "text_md5", F.explode(good).alias("answer"))


def _require_unique(docs: DataFrame) -> None:
    twice = docs.groupBy("doc_key").count().where("count > 1").head(1)
    if twice:
        raise GuardError(f"document key is not unique: {twice[0].doc_key!r}; see first_per_key")


class _Work:
    """Which documents a run touches, worked out on names alone.

    Writes one row per listed document to ``path``: (doc_key, copies, done,
    kept). ``kept`` holds the good answers that ``earlier`` attempts left for a
    pending document, the newest of each batch. With ``buckets`` it is a table
    in so many buckets by doc_key.
    """

    def __init__(
        self, spark: SparkSession, keys: DataFrame, events: DataFrame, earlier: DataFrame | None, path: str, buckets: int | None
    ) -> None:
        self._spark, self._name = spark, None
        listed = keys.groupBy("doc_key").agg(F.count("*").alias("copies"))
        done = done_keys(events).withColumn("done", F.lit(True))
        table = listed.join(done, "doc_key", "left").withColumn("done", F.coalesce("done", F.lit(False)))
        if earlier is None:
            table = table.withColumn("kept", F.lit(None).cast(KEPT_TYPE))
        else:
            newest = earlier.groupBy("doc_key", F.col("answer.batch").alias("batch")).agg(
                F.max_by(F.struct("text_md5", "answer"), "attempt").alias("one")
            )
            # One entry per batch of the catalog at most.
            table = table.join(newest.groupBy("doc_key").agg(F.collect_list("one").alias("kept")), "doc_key", "left")
        # A finished document's answers are of no use.
        table = table.withColumn("kept", F.when(~F.col("done"), F.col("kept"))).select("doc_key", "copies", "done", "kept")
        if buckets:
            self._name = f"siftrow_work_{uuid.uuid4().hex}"
            writer = table.repartition(buckets, "doc_key").write.bucketBy(buckets, "doc_key").sortBy("doc_key")
            writer.format("parquet").option("path", path).saveAsTable(self._name)
            self._table = spark.table(self._name)
        else:
            table.write.mode("overwrite").parquet(path)
            self._table = spark.read.schema(f"doc_key string, copies bigint, done boolean, kept {KEPT_TYPE}").parquet(path)

    def count(self) -> tuple[int, int]:
        """(listed, pending) documents; a key that occurs twice is an error."""
        row = self._table.agg(
            F.count("*").alias("total"),
            F.count_if(~F.col("done")).alias("pending"),
            F.count_if(F.col("kept").isNotNull()).alias("keeping"),
            F.max(F.when(F.col("copies") > 1, F.col("doc_key"))).alias("twice"),
        ).head()
        if row.twice is not None:
            raise GuardError(f"document key is not unique: {row.twice!r}; see first_per_key")
        self.has_kept = row.keeping > 0
        return row.total, row.pending

    def pending(self) -> DataFrame:
        return self._table.where(~F.col("done")).select("doc_key")

    def narrow(self, docs: DataFrame) -> DataFrame:
        """The pending documents with ``kept``, by an inner join to their names.

        Spark broadcasts the names if their size allows. Where it does not, a
        table in as many buckets meets them without a shuffle; other texts move.
        """
        return docs.join(self._table.where(~F.col("done")).select("doc_key", "kept"), "doc_key")

    def drop(self) -> None:
        """The table's name goes; its files belong to the attempt."""
        if self._name:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")


def first_per_key(docs: DataFrame, order: str = "path", key: str = "doc_key") -> DataFrame:
    """Keep the first document of each key, by ``order``, which must be unique per key.

    For collections from several folders, where the same file name means the
    same document. The winners are found on names alone and joined back on
    both columns, so a name with very many copies still spreads over tasks.
    """
    first = docs.select(key, order).groupBy(key).agg(F.min(order).alias(order))
    return docs.join(first, [key, order], "left_semi")
