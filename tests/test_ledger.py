import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftrow import (
    GuardError,
    compact_ledger,
    failures_report,
    fold_ledger,
    outcome,
    pending_documents,
    read_ledger,
    read_snapshot,
    run_summary,
    vacuum,
    write_snapshot,
)
from siftrow.operators.catalog import Catalog, Entry
from siftrow.operators.ledger import LEDGER_SCHEMA
from siftrow.plans.queries.ledger import commit_part
from siftrow.sources.ledger import RUNS_SCHEMA, commit_run, snapshot, write_events

CATALOG = Catalog((Entry("A", "a", "one"), Entry("B", "b", "two")))


def at(day):
    return datetime(2024, 1, day)


def events_of(spark, *rows):
    full = [(k, s, None, r, "run", at(d), 1) for k, s, r, d in rows]
    return spark.createDataFrame(full, LEDGER_SCHEMA)


EVENTS = (
    ("done then failed", "done", None, 1),
    ("done then failed", "failed", "late", 2),
    ("failed then done", "failed", "early", 1),
    ("failed then done", "done", None, 2),
    ("failed twice", "failed", "first", 1),
    ("failed twice", "failed", "second", 2),
    ("done", "done", None, 3),
)


def test_fold(spark):
    got = {r.doc_key: (r.status, r.reason) for r in fold_ledger(events_of(spark, *EVENTS)).collect()}
    assert got == {
        "done then failed": ("done", None),
        "failed then done": ("done", None),
        "failed twice": ("failed", "second"),
        "done": ("done", None),
    }


def test_failures_report_is_ordered(spark):
    events = events_of(spark, ("z", "failed", "r1", 1), ("a", "failed", "r2", 1), ("m", "done", None, 1))
    assert [tuple(r) for r in failures_report(events).collect()] == [("a", "r2"), ("z", "r1")]


def test_pending_keeps_failed_and_new(spark, docs_of):
    docs = docs_of(("done", "x"), ("failed twice", "x"), ("new", "x"), ("done then failed", "x"))
    got = {r.doc_key for r in pending_documents(docs, events_of(spark, *EVENTS)).collect()}
    assert got == {"failed twice", "new"}


def test_outcome_takes_the_first_failing_batch(spark):
    rows = [
        ("fine", "one", 1, "extract", None), ("fine", "two", 2, "extract", None),
        ("both", "two", 2, "extract", "second"), ("both", "one", 1, "extract", "first"),
        ("short", "one", 1, "extract", None),
        ("blank", None, None, "blank", "no extractable text"),
    ]
    df = spark.createDataFrame(rows, "doc_key string, batch string, batch_ordinal int, stage string, error string")
    got = {r.doc_key: (r.status, r.stage, r.reason) for r in outcome(df, CATALOG).collect()}
    assert got == {
        "fine": ("done", None, None),
        "both": ("failed", "extract", "first"),
        "short": ("failed", "extract", "not every batch was answered"),
        "blank": ("failed", "blank", "no extractable text"),
    }


def test_summary_counts_outstanding_failures(spark, docs_of):
    docs = docs_of(("a", ""), ("b", ""), ("c", ""), ("d", ""))
    before = events_of(spark, ("a", "done", None, 1), ("gone", "failed", "old", 1), ("b", "failed", "old", 1))
    now = spark.createDataFrame([("b", "done"), ("c", "failed"), ("d", "done")], "doc_key string, status string")
    row = run_summary(docs, before, now).head().asDict()
    assert row == {"total": 4, "skipped": 1, "succeeded": 2, "failed": 1, "failed_outstanding": 2, "verdict": 2}


def test_summary_of_nothing(spark, docs_of):
    none = docs_of(("a", "")).where("false")
    row = run_summary(none, events_of(spark).where("false"), none.select("doc_key", F.lit("done").alias("status"))).head()
    assert tuple(row) == (0, 0, 0, 0, 0, 0)


def write_run(spark, ledger, run_id, rows, version=1):
    write_events(events_of(spark, *rows), ledger, run_id)
    run = spark.createDataFrame([(run_id, version, 1, 0, 1, 0, 0, 0, at(1), at(1), run_id)], RUNS_SCHEMA)
    commit_run(run, ledger)


def test_ledger_absent_is_empty(spark, tmp_path):
    assert read_ledger(spark, str(tmp_path / "none")).count() == 0


def test_only_committed_runs_are_visible(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    write_run(spark, ledger, "r1", [("a", "done", None, 1)])
    write_events(events_of(spark, ("b", "done", None, 1)), ledger, "r2")
    assert [(r.doc_key, r.run_id) for r in read_ledger(spark, ledger).collect()] == [("a", "r1")]


def test_wrong_version_and_broken_files_are_refused(spark, tmp_path):
    ledger = str(tmp_path / "versioned")
    write_run(spark, ledger, "r1", [("a", "done", None, 1)], version=999)
    with pytest.raises(GuardError, match="999"):
        read_ledger(spark, ledger)
    broken = tmp_path / "broken" / "runs"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("{not parquet")
    with pytest.raises(GuardError, match="could not read"):
        read_ledger(spark, str(tmp_path / "broken"))


def test_snapshot_round_trip_small(spark, tmp_path):
    path = str(tmp_path / "snap")
    events = events_of(spark, *EVENTS)
    write_snapshot(events, path)
    lines = spark.read.text(path).collect()
    (line,) = lines
    doc = json.loads(line[0])
    assert doc["version"] == 1
    assert doc["processed"] == ["done", "done then failed", "failed then done"]
    assert doc["failed"] == {"failed twice": "second"}
    assert (doc["started_at"], doc["updated_at"]) == ("2024-01-01T00:00:00.000000+00:00", "2024-01-03T00:00:00.000000+00:00")
    again = {(r.doc_key, r.status, r.reason) for r in fold_ledger(read_snapshot(spark, path)).collect()}
    assert again == {(r.doc_key, r.status, r.reason) for r in fold_ledger(events).collect()}


def test_snapshot_splits_into_bounded_rows(spark, tmp_path):
    path = str(tmp_path / "snap")
    events = events_of(spark, *((f"doc {i:03d}", "done" if i % 3 else "failed", None if i % 3 else "r", 1) for i in range(200)))
    write_snapshot(events, path, docs_per_row=20)
    docs = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert len(docs) > 5
    assert max(len(d["processed"]) + len(d["failed"]) for d in docs) < 60
    assert sum(len(d["processed"]) + len(d["failed"]) for d in docs) == 200
    lines = [p for d in docs for p in d["processed"]]
    assert lines == sorted(lines)


def test_empty_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    write_snapshot(events_of(spark).where("false"), path)
    assert read_snapshot(spark, path).count() == 0
    assert json.loads(spark.read.text(path).head()[0])["processed"] == []


def test_import_of_an_indented_snapshot(spark, tmp_path):
    path = tmp_path / "run.checkpoint.json"
    path.write_text(json.dumps({"version": 1, "started_at": "2024-01-01T00:00:00+00:00", "updated_at": "2024-01-02T00:00:00+00:00", "processed": ["a.pdf"], "failed": {"b.pdf": "boom"}}, indent=2))
    rows = {(r.doc_key, r.status, r.reason, r.at) for r in read_snapshot(spark, str(path), multi_line=True).collect()}
    assert rows == {("a.pdf", "done", None, at(2)), ("b.pdf", "failed", "boom", at(2))}


@pytest.mark.parametrize("text", ["[1, {]", '{"version": 1, "processed": [', '{"version": 1, "processed": ["a"], "failed": {"b": ', '{"version": 27, "processed": [], "failed": {}}', '{"processed": []}'])
def test_bad_snapshots_are_refused(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(GuardError):
        read_snapshot(spark, str(path), multi_line=True)


def test_snapshot_needs_no_second_pass_per_key(spark):
    rows = snapshot(events_of(spark, *EVENTS), F.length("doc_key") % 2).collect()
    assert sum(len(r.processed) for r in rows) == 3


def committed(spark, ledger, attempt, rows):
    write_events(events_of(spark, *rows).withColumn("stage", F.lit("extract")), ledger, attempt)
    commit_part(spark, ledger, attempt)


def state_of(events):
    return sorted((r.doc_key, r.status, r.reason, r.at) for r in fold_ledger(events).collect())


def test_compaction_keeps_the_state_and_shrinks_the_history(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert compact_ledger(spark, ledger) == 0
    for i in range(3):
        committed(spark, ledger, f"run-{i}", EVENTS)
    before = state_of(read_ledger(spark, ledger))
    assert compact_ledger(spark, ledger) == 3
    left = read_ledger(spark, ledger)
    assert state_of(left) == before and left.count() == len(before)
    # A word of a later run counts, and a second compaction stands for the first one too.
    committed(spark, ledger, "later", [("fresh", "failed", "no", 9)])
    assert compact_ledger(spark, ledger) == 2
    assert [r for r in state_of(read_ledger(spark, ledger)) if r[0] != "fresh"] == before
    assert read_ledger(spark, ledger).where("doc_key = 'fresh'").head().run_id == "later"
    # The files of all that was replaced go; the state stays.
    assert vacuum(spark, str(tmp_path / "out"), ledger, older_than_hours=24) == 0
    assert vacuum(spark, str(tmp_path / "out"), ledger, older_than_hours=-1) == 5
    assert sorted(state_of(read_ledger(spark, ledger)))[: len(before)] and len(list((tmp_path / "ledger" / "events").glob("attempt=*"))) == 1
