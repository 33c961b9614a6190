"""What the plans must look like at any scale."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftrow.plans.queries import QUERIES
from tests.conftest import plan_of

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")

# Queries that are a scan and a projection: nothing may be shuffled.
NO_SHUFFLE = (
    "split_into_pages count_pages blank_segments trimmed_text sanitized_cells capped_cells decoded_text fanned_out "
    "rendered_requests extracted_by_rules long_answers extracted_with_function retried_calls strictly_parsed "
    "checked_labels split_values checked_years checked_identifiers checked_authors checked_vocabulary checked_briefs "
    "checked_methodology checked_study_types sections_of_cells complete_documents merged_whole_documents outcomes"
).split()
# One aggregation on the document key: one shuffle, combined before it.
ONE_SHUFFLE = "merged_batches flattened_rows folded_ledger".split()
STORED = {"compacted_ledger", "retried_batches", "full_run", "ledger_of_run", "resumed_run", "incremental_runs", "appended_results", "output_row_count", "snapshot_round_trip", "exported_rows", "listed_files", "lines_of_files"}


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_one_shuffle_with_partial_aggregation(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert plan.count("Exchange") == 1 and "partial_" in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORED))
def test_no_cross_join_and_no_window_over_everything(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan_of(QUERIES["checked_years"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan_of(QUERIES["pending"](spark, SMALL))


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["folded_ledger"](spark, SMALL))
    assert "PushedFilters: [In(event_type, [error,purchase])]" in plan


def test_pending_is_an_anti_join_on_names(spark):
    plan = plan_of(QUERIES["pending"](spark, SMALL))
    assert "LeftAnti" in plan and "text" not in plan


def test_hot_document_key_is_combined_before_the_shuffle(spark):
    """A third of all events belong to one document; each task sends one row for it."""
    from siftrow import fold_ledger

    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    events = spark.range(30_000).select(
        key.alias("doc_key"),
        F.lit("failed").alias("status"),
        F.col("id").cast("string").alias("reason"),
        F.timestamp_seconds("id").alias("at"),
    )
    rows = {r.doc_key: r.reason for r in fold_ledger(events).where("doc_key = 'hot'").collect()}
    assert rows == {"hot": "29997"}
    assert "partial_max" in plan_of(fold_ledger(events))


def test_a_text_goes_to_python_once(spark):
    """One row per document meets the worker: what fans out comes after it."""
    plan = plan_of(QUERIES["extracted_with_function"](spark, SMALL))
    above, below = plan.split("MapInArrow")
    assert "Generate" in above and "Generate" not in below and "text" in below


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_stay_in_place_on_a_resumed_run_over_buckets(spark, no_broadcast, tmp_path, monkeypatch):
    from siftrow import read_results, run
    from siftrow.plans import run as run_module

    plans = []

    def watched(docs, *args, **options):
        plans.append(plan_of(docs))
        return extract(docs, *args, **options)

    extract = run_module.extract_documents
    monkeypatch.setattr(run_module, "extract_documents", watched)

    def stub(row):
        if row["doc_key"] == "3" and row["batch"] == "review" and not refused:
            raise ValueError("no")
        return "{}"

    docs = spark.range(40).selectExpr("CAST(id AS STRING) AS doc_key", "concat('text ', id) AS text")
    name = f"docs_{tmp_path.name.replace('-', '_')}"
    stored = run_module.store_documents(docs, name, 4, str(tmp_path / "docs"))
    places = str(tmp_path / "out"), str(tmp_path / "ledger")
    try:
        for refused in (False, True):
            run(spark, stored, stub, *places, tasks=2, buckets=4)
            run(spark, docs, stub, *(p + "-plain" for p in places), tasks=2)
    finally:
        spark.sql(f"DROP TABLE {name}")
    first, plain, second, moved = plans
    assert "Exchange" not in first and "Exchange" not in plain, "a bound on tasks moves nothing"
    assert "SortMergeJoin" in second and "Exchange" not in second
    assert "Exchange" in moved, "without buckets the texts meet the names by a shuffle"
    assert read_results(spark, *places).count() == 40


def test_results_and_events_of_a_run_are_projections_of_its_answers(spark, tmp_path):
    from siftrow.operators.answers import flatten_row, merge_answers
    from siftrow.operators.ledger import document_outcome
    from siftrow.plans.run import STAGED_SCHEMA

    spark.createDataFrame([], STAGED_SCHEMA).write.parquet(str(tmp_path / "a"))
    staged = spark.read.schema(STAGED_SCHEMA).parquet(str(tmp_path / "a"))
    assert "Exchange" not in plan_of(flatten_row(merge_answers(staged.where("complete"))))
    assert "Exchange" not in plan_of(document_outcome(staged))
