import json
import os
import time
import uuid

import pytest

from siftrow import (
    DEFAULT_CATALOG,
    SYSTEM_TEXT,
    Catalog,
    Entry,
    GuardError,
    compact_ledger,
    count_output_rows,
    import_snapshot,
    incremental_run,
    read_ledger,
    read_results,
    run,
    run_folder,
    vacuum,
)
from siftrow.operators.ledger import fold_ledger
from siftrow.plans import run as run_module
from siftrow.sources import documents as documents_module
from siftrow.sources.documents import read_listed

SMALL = Catalog((Entry("Title", "title", "first"), Entry("Year", "year", "second"), Entry("Brief", "brief", "synthesis")))


def echo(row):
    fields = {"first": "title", "second": "year", "synthesis": "brief"}
    return json.dumps({fields[row["batch"]]: row["request"].split("---\n", 1)[1].removesuffix("\n---")})


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "ledger")


def counts(summary):
    row = summary.head()
    return (row.total, row.skipped, row.succeeded, row.failed, row.failed_outstanding, row.verdict)


def titles(spark, places):
    return {r.doc_key: r.Title for r in read_results(spark, *places, SMALL).collect()}


def test_end_to_end_default_catalog(spark, docs_of, places):
    def stub(row):
        batch = next(b for b in DEFAULT_CATALOG.batches if b.name == row["batch"])
        return json.dumps({f: f"{row['doc_key']} {f}" for f in batch.fields})

    docs = docs_of(("harbour.pdf", "Bells"), ("quay.pdf", "Gulls"), ("pier.pdf", "Ropes"))
    summary = run(spark, docs, stub, *places, header=list(DEFAULT_CATALOG.columns))
    assert counts(summary) == (3, 0, 3, 0, 0, 0)
    rows = read_results(spark, *places).collect()
    assert len(rows) == 3
    for row in rows:
        for e in DEFAULT_CATALOG.entries:
            assert row[e.column] == f"{row.doc_key} {e.field}"


def test_second_run_skips_everything(spark, docs_of, places):
    docs = docs_of(("a", "x"), ("b", "y"))
    run(spark, docs, echo, *places, catalog=SMALL)

    def never(row):
        raise AssertionError("called again")

    assert counts(run(spark, docs, never, *places, catalog=SMALL)) == (2, 2, 0, 0, 0, 0)
    assert titles(spark, places) == {"a": "x", "b": "y"}


def test_one_failure_is_isolated_and_retried(spark, docs_of, places):
    def failing(row):
        if row["doc_key"] == "b" and row["batch"] == "second":
            raise ValueError("boom")
        return echo(row)

    docs = docs_of(("a", "x"), ("b", "y"), ("c", "z"))
    assert counts(run(spark, docs, failing, *places, catalog=SMALL)) == (3, 0, 2, 1, 1, 2)
    state = {r.doc_key: (r.status, r.reason) for r in fold_ledger(read_ledger(spark, places[1])).collect()}
    assert state["b"] == ("failed", "extraction failed: boom") and set(titles(spark, places)) == {"a", "c"}
    assert counts(run(spark, docs, echo, *places, catalog=SMALL)) == (3, 2, 1, 0, 0, 0)
    assert titles(spark, places) == {"a": "x", "b": "y", "c": "z"}


def test_every_stage_leaves_its_reason(spark, places):
    rows = [("ok", "text", None), ("unread", None, None), ("damaged", None, "could not open: damaged"), ("blank", " \f\n", None), ("lax", "lax", None)]
    docs = spark.createDataFrame(rows, "doc_key string, text string, reason string")

    def stub(row):
        return '{"title": 7}' if "lax" in row["request"] and row["batch"] == "first" else echo(row)

    assert counts(run(spark, docs, stub, *places, catalog=SMALL)) == (5, 0, 1, 4, 4, 2)
    got = {r.doc_key: (r.stage, r.reason) for r in read_ledger(spark, places[1]).collect()}
    assert got == {
        "ok": (None, None),
        "unread": ("read", "could not open: no readable text"),
        "damaged": ("read", "could not open: damaged"),
        "blank": ("blank", "no extractable text"),
        "lax": ("extract", "values that are not text: title"),
    }


def test_nothing_to_do(spark, docs_of, places):
    assert counts(run(spark, docs_of(("a", "x")).where("false"), echo, *places, catalog=SMALL)) == (0, 0, 0, 0, 0, 0)
    assert count_output_rows(spark, *places, SMALL) == 0


def test_all_fail(spark, docs_of, places):
    def broken(row):
        raise RuntimeError("down")

    assert counts(run(spark, docs_of(("a", "x"), ("b", "y")), broken, *places, catalog=SMALL)) == (2, 0, 0, 2, 2, 2)
    assert titles(spark, places) == {}


def test_failure_of_a_departed_document_stays_outstanding(spark, docs_of, places):
    def failing(row):
        if row["doc_key"] == "gone":
            raise ValueError("boom")
        return echo(row)

    run(spark, docs_of(("gone", "x"), ("a", "y")), failing, *places, catalog=SMALL)
    assert counts(run(spark, docs_of(("a", "y")), echo, *places, catalog=SMALL)) == (1, 1, 0, 0, 1, 2)


@pytest.mark.parametrize("step", ["append_results", "write_events", "commit_run"])
def test_crash_before_commit_shows_nothing_and_repeats_no_call(spark, docs_of, places, monkeypatch, step):
    calls = spark.sparkContext.accumulator(0)
    fixed = False

    def counting(row):
        calls.add(1)
        if row["doc_key"] == "bad" and row["batch"] == "second" and not fixed:
            raise ValueError("boom")
        return echo(row)

    def crash(*_args, **_kwargs):
        raise RuntimeError("power cut")

    run(spark, docs_of(("old", "o")), counting, *places, catalog=SMALL)
    docs = docs_of(("old", "o"), ("a", "x"), ("bad", "y"), ("c", "z"))
    with monkeypatch.context() as patched:
        patched.setattr(run_module, step, crash)
        with pytest.raises(RuntimeError):
            run(spark, docs, counting, *places, catalog=SMALL)
    assert calls.value == 3 + 9
    assert titles(spark, places) == {"old": "o"}

    fixed = True
    assert counts(run(spark, docs, counting, *places, catalog=SMALL)) == (4, 1, 3, 0, 0, 0)
    assert calls.value == 3 + 9 + 1, "only the failed call is made again"
    assert set(titles(spark, places)) == {"old", "a", "bad", "c"}
    assert read_results(spark, *places, SMALL).count() == 4


def test_one_failed_batch_of_a_committed_run_costs_one_call(spark, docs_of, places, tmp_path):
    def stub(row):
        if row["batch"] == "review" and row["doc_key"] == "b" and not fixed:
            raise ValueError("boom")
        (log / f"{row['doc_key']}-{row['batch']}-{uuid.uuid4().hex}").touch()
        return "{}"

    docs, log, fixed = docs_of(("a", "x"), ("b", "y")), tmp_path / "calls", False
    log.mkdir()
    assert counts(run(spark, docs, stub, *places)) == (2, 0, 1, 1, 1, 2)
    assert len(calls_of(log)) == 21
    fixed = True
    assert counts(run(spark, docs, stub, *places)) == (2, 1, 1, 0, 0, 0)
    assert len(calls_of(log)) == 22 and "b-review" in calls_of(log)
    assert read_results(spark, *places).count() == 2


def test_answers_to_another_text_or_system_text_are_stale(spark, docs_of, places, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def stub(row):
        if row["batch"] == "second" and not fixed:
            raise ValueError("boom")
        (log / f"{row['doc_key']}-{row['batch']}-{uuid.uuid4().hex}").touch()
        return echo(row)

    fixed = False
    run(spark, docs_of(("a", "x"), ("b", "y"), ("c", "z")), stub, *places, catalog=SMALL)
    assert len(calls_of(log)) == 6
    fixed = True
    run(spark, docs_of(("a", "x"), ("b", "changed")), stub, *places, catalog=SMALL)
    # One call for the failed batch of the same text, three for the changed one.
    assert len(calls_of(log)) == 10 and titles(spark, places) == {"a": "x", "b": "changed"}
    run(spark, docs_of(("c", "z")), stub, *places, catalog=SMALL, system="Answer otherwise.")
    assert len(calls_of(log)) == 13


def test_runs_side_by_side_leave_no_document_twice(spark, docs_of, places, monkeypatch):
    """Both look at the ledger before either commits."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both, write = Barrier(2, timeout=120), run_module.write_events

    def late(*args):
        both.wait()
        write(*args)

    shared = [("a", "x"), ("b", "y")]
    with monkeypatch.context() as patched, ThreadPoolExecutor(2) as pool:
        patched.setattr(run_module, "write_events", late)
        jobs = [pool.submit(run, spark, docs_of(*shared, (own, "own")), echo, *places, catalog=SMALL) for own in ("c", "d")]
        for job in jobs:
            job.result()
    assert sorted(r.doc_key for r in read_results(spark, *places, SMALL).collect()) == ["a", "b", "c", "d"]
    assert count_output_rows(spark, *places, SMALL) == 4
    assert counts(run(spark, docs_of(*shared), echo, *places, catalog=SMALL)) == (2, 2, 0, 0, 0, 0)


def test_a_run_leaves_out_what_another_finished_meanwhile(spark, docs_of, places, monkeypatch):
    extract = run_module.extract_documents
    outer = []

    def overtaken(*args, **options):
        if not outer:
            outer.append(True)
            run(spark, docs_of(("a", "x")), echo, *places, catalog=SMALL, run_id="fast")
        return extract(*args, **options)

    monkeypatch.setattr(run_module, "extract_documents", overtaken)
    slow = run(spark, docs_of(("a", "x"), ("b", "y")), echo, *places, catalog=SMALL, run_id="slow")
    assert counts(slow) == (2, 1, 1, 0, 0, 0)
    assert {r.doc_key: r.run_id for r in read_results(spark, *places, SMALL).collect()} == {"a": "fast", "b": "slow"}
    assert read_ledger(spark, places[1]).where("doc_key = 'a'").count() == 1


def test_rounds_and_threads_make_each_call_once(spark, tmp_path, places):
    log = tmp_path / "calls"
    log.mkdir()
    docs = spark.range(0, 12, 1, 3).selectExpr("CAST(id AS STRING) AS doc_key", "concat('t', id) AS text")
    assert counts(run(spark, docs, logged(log), *places, catalog=SMALL, rounds=3, threads=4, tasks=2)) == (12, 0, 12, 0, 0, 0)
    assert calls_of(log) == sorted(f"{i}-{b}" for i in range(12) for b in ("first", "second", "synthesis"))
    assert titles(spark, places) == {str(i): f"t{i}" for i in range(12)}


def test_rounds_that_ended_keep_their_answers(spark, tmp_path, places):
    log = tmp_path / "calls"
    log.mkdir()
    docs = spark.range(0, 8, 1, 1).selectExpr("CAST(id AS STRING) AS doc_key", "concat('t', id) AS text")
    turns = {r.doc_key: r.turn for r in docs.selectExpr("doc_key", "pmod(xxhash64(doc_key), 4) AS turn").collect()}
    last = max(turns, key=turns.get)
    with pytest.raises(Exception, match="(?i)python worker"):
        run(spark, docs, logged(log, lethal=last), *places, catalog=SMALL, rounds=4)
    assert len(calls_of(log)) >= 3 * sum(t < turns[last] for t in turns.values()) > 0
    run(spark, docs, logged(log), *places, catalog=SMALL)
    again = [c for c in set(calls_of(log)) if calls_of(log).count(c) > 1]
    assert all(turns[c.split("-")[0]] == turns[last] for c in again)


def test_a_cut_text_is_told_in_its_event(spark, docs_of, places):
    run(spark, docs_of(("long", "w" * 50), ("short", "w")), echo, *places, catalog=SMALL, limit=10)
    got = {r.doc_key: (r.status, r.stage) for r in read_ledger(spark, places[1]).collect()}
    assert got == {"long": ("done", "extract: text cut"), "short": ("done", None)}


def test_vacuum_keeps_what_a_later_run_needs(spark, docs_of, places, tmp_path, monkeypatch):
    def stub(row):
        if row["doc_key"] == "b" and row["batch"] == "second" and not fixed:
            raise ValueError("boom")
        (log / f"{row['doc_key']}-{row['batch']}-{uuid.uuid4().hex}").touch()
        return echo(row)

    docs, log, fixed = docs_of(("a", "x"), ("b", "y")), tmp_path / "calls", False
    log.mkdir()
    run(spark, docs, stub, *places, catalog=SMALL)
    with monkeypatch.context() as m:
        m.setattr(run_module, "commit_run", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(spark, docs_of(("dead", "x")), stub, *places, catalog=SMALL)
    compact_ledger(spark, places[1])
    # Of the committed run its work table and the answers of what it finished, and all of the dead one.
    assert vacuum(spark, *places, older_than_hours=-1) >= 5
    fixed, before = True, len(calls_of(log))
    assert counts(run(spark, docs, stub, *places, catalog=SMALL)) == (2, 1, 1, 0, 0, 0)
    assert len(calls_of(log)) == before + 1 and titles(spark, places) == {"a": "x", "b": "y"}


def test_answers_of_several_dead_attempts_are_reused_once(spark, docs_of, places, monkeypatch):
    """Also under one and the same run id, as when a streaming batch is repeated."""
    calls = spark.sparkContext.accumulator(0)

    def counting(row):
        calls.add(1)
        return echo(row)

    def crash(*_args, **_kwargs):
        raise RuntimeError("power cut")

    with monkeypatch.context() as patched:
        patched.setattr(run_module, "commit_run", crash)
        for docs in (docs_of(("a", "x")), docs_of(("a", "x"), ("b", "y")), docs_of(("a", "x"), ("b", "y"))):
            with pytest.raises(RuntimeError):
                run(spark, docs, counting, *places, catalog=SMALL, run_id="batch-0")
    assert calls.value == 6
    assert counts(run(spark, docs_of(("a", "x"), ("b", "y")), counting, *places, catalog=SMALL, run_id="batch-0")) == (2, 0, 2, 0, 0, 0)
    assert calls.value == 6 and titles(spark, places) == {"a": "x", "b": "y"}


def test_stale_answers_do_not_fit_another_catalog(spark, docs_of, places, monkeypatch):
    def crash(*_args, **_kwargs):
        raise RuntimeError("power cut")

    with monkeypatch.context() as patched:
        patched.setattr(run_module, "commit_run", crash)
        with pytest.raises(RuntimeError):
            run(spark, docs_of(("a", "x")), echo, *places, catalog=SMALL)
    renamed = Catalog((Entry("Title", "name", "first"), SMALL.entries[1], SMALL.entries[2]))

    def other(row):
        assert row["batch"] == "first", "the other batches still fit"
        return '{"name": "new"}'

    assert counts(run(spark, docs_of(("a", "x")), other, *places, catalog=renamed)) == (1, 0, 1, 0, 0, 0)
    row = read_results(spark, *places, renamed).head()
    assert (row.Title, row.Year) == ("new", "x")


def test_committed_run_id_is_not_run_again(spark, docs_of, places):
    run(spark, docs_of(("a", "x")), echo, *places, catalog=SMALL, run_id="r")
    again = run(spark, docs_of(("a", "x"), ("b", "y")), echo, *places, catalog=SMALL, run_id="r")
    assert counts(again) == (1, 0, 1, 0, 0, 0)
    assert titles(spark, places) == {"a": "x"}


def test_guards_come_before_any_call(spark, docs_of, places):
    docs = docs_of(("a", "x"))
    with pytest.raises(GuardError, match="header"):
        run(spark, docs, echo, *places, catalog=SMALL, header=["Title", "Brief", "Year"])
    with pytest.raises(GuardError, match="not unique"):
        run(spark, docs_of(("a", "x"), ("a", "y")), echo, *places, catalog=SMALL)
    with pytest.raises(GuardError, match="tasks"):
        run(spark, docs, echo, *places, catalog=SMALL, requests_per_minute=10)
    assert read_ledger(spark, places[1]).count() == 0


def test_paced_and_spread(spark, docs_of, places):
    docs = docs_of(*((f"d{i}", f"t{i}") for i in range(6)))
    summary = run(spark, docs, echo, *places, catalog=SMALL, tasks=3, requests_per_minute=60_000)
    assert counts(summary) == (6, 0, 6, 0, 0, 0)


def test_documents_that_vanish_are_failures(spark, docs_of, places):
    """Listed by name, gone when read."""
    listing = docs_of(("0", ""), ("1", ""), ("2", ""))
    docs = docs_of(("0", "t"), ("1", "t"))
    assert counts(run(spark, docs, echo, *places, catalog=SMALL, listing=listing)) == (3, 0, 2, 1, 1, 2)
    lost = read_ledger(spark, places[1]).where("doc_key = '2'").head()
    assert (lost.stage, lost.reason) == ("read", "could not open: the document is gone")


def test_folder_run_opens_only_pending_files(spark, tmp_path, places, monkeypatch):
    listed = []

    def read(listing, *args):
        listed.append(sorted(r.doc_key for r in listing.collect()))
        return read_listed(listing, *args)

    monkeypatch.setattr(documents_module, "read_listed", read)
    folder = tmp_path / "papers [1] %20"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    (folder / "b.txt").write_bytes(b"\xff")
    template = tmp_path / "template.csv"
    template.write_text("Title,Year,Brief\n")
    options = {"catalog": SMALL, "template": str(template)}
    assert counts(run_folder(spark, str(folder), echo, *places, **options)) == (2, 0, 1, 1, 1, 2)
    assert {r.doc_key: r.reason for r in read_ledger(spark, places[1]).collect()} == {"a.txt": None, "b.txt": "could not open: no readable text"}
    (folder / "b.txt").write_text("y")
    (folder / "c.txt").write_text("z")
    (folder / "a.txt").write_text("changed, but done")
    assert counts(run_folder(spark, str(folder), echo, *places, **options)) == (3, 1, 2, 0, 0, 0)
    assert titles(spark, places) == {"a.txt": "x", "b.txt": "y", "c.txt": "z"}
    assert listed == [["a.txt", "b.txt"], ["b.txt", "c.txt"]]
    assert counts(run_folder(spark, str(folder), echo, *places, **options)) == (3, 3, 0, 0, 0, 0)


def test_folder_run_guards(spark, tmp_path, places):
    (tmp_path / "empty").mkdir()
    assert counts(run_folder(spark, str(tmp_path / "empty"), echo, *places, catalog=SMALL)) == (0, 0, 0, 0, 0, 0)
    with pytest.raises(GuardError, match="template"):
        run_folder(spark, str(tmp_path / "empty"), echo, *places, catalog=SMALL, template=str(tmp_path / "no.csv"))
    with pytest.raises(GuardError, match="does not exist"):
        run_folder(spark, str(tmp_path / "missing"), echo, *places, catalog=SMALL)


def test_incremental_equals_batch(spark, tmp_path, places):
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")

    def arrive(*pairs):
        spark.createDataFrame(list(pairs), "doc_key string, text string").write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema("doc_key string, text string").parquet(source)

    arrive(("a", "x"), ("b", "y"))
    assert incremental_run(spark, stream(), echo, *places, marks, catalog=SMALL) == 1
    assert incremental_run(spark, stream(), echo, *places, marks, catalog=SMALL) == 0
    arrive(("c", "z"))
    assert incremental_run(spark, stream(), echo, *places, marks, catalog=SMALL) == 1
    by_batch = (str(tmp_path / "out2"), str(tmp_path / "ledger2"))
    run(spark, spark.read.parquet(source), echo, *by_batch, catalog=SMALL)
    assert titles(spark, places) == titles(spark, by_batch) == {"a": "x", "b": "y", "c": "z"}


def test_streams_that_share_a_ledger_lose_nothing(spark, tmp_path, places):
    schema = "doc_key string, text string"

    def feed(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")

    for name, rows in (("one", [("a", "x"), ("b", "y")]), ("two", [("c", "x"), ("d", "y"), ("d", "z")])):
        assert incremental_run(spark, feed(name, *rows), echo, *places, f"{tmp_path}/marks-{name}", catalog=SMALL) == 1
    # A fresh checkpoint hands out old files again; only the new document is worked on.
    assert incremental_run(spark, feed("one", ("e", "x")), echo, *places, f"{tmp_path}/marks-new", catalog=SMALL) == 1
    assert {r.doc_key for r in read_results(spark, *places).collect()} == set("abcde")


def test_failed_documents_of_a_stream_are_handed_out_again_when_due(spark, tmp_path, places):
    schema, source, marks = "doc_key string, text string, tags map<string,string>", str(tmp_path / "in"), str(tmp_path / "marks")
    log = tmp_path / "calls"
    log.mkdir()

    def feed(*rows):
        if rows:
            spark.createDataFrame([(k, t, {"t": "u"}) for k, t in rows], schema).coalesce(1).write.mode("append").parquet(source)
        return spark.readStream.schema(schema).parquet(source)

    def stub(row):
        if row["doc_key"] == "bad" and row["batch"] == "second" and not fixed:
            raise ValueError("boom")
        (log / f"{row['doc_key']}-{row['batch']}-{uuid.uuid4().hex}").touch()
        return echo(row)

    def trigger(*rows, **options):
        return incremental_run(spark, feed(*rows), stub, *places, marks, catalog=SMALL, **options)

    fixed = False
    # A copy that cannot be read gives way to one that can, whichever comes first.
    assert trigger(("a", None), ("a", "x"), ("bad", "y"), ("gone", None)) == 1
    assert titles(spark, places) == {"a": "x"} and len(calls_of(log)) == 5
    assert trigger() == 0, "not due yet"
    # A key that was finished is not worked on again; one that failed is, with its other answers kept.
    assert trigger(("a", "x"), ("c", "z"), retry_after=0.0) == 1
    assert titles(spark, places) == {"a": "x", "c": "z"} and len(calls_of(log)) == 8
    fixed = True
    assert trigger(retry_after=0.0, max_tries=2) == 0, "tried twice"
    assert trigger(retry_after=0.0) == 1, "nothing new, but two documents are due"
    assert titles(spark, places) == {"a": "x", "bad": "y", "c": "z"}
    assert calls_of(log).count("bad-second") == 1 and len(calls_of(log)) == 9
    # A new copy takes the place of what was kept.
    assert trigger(("gone", "back"), retry_after=0.0) == 1
    assert titles(spark, places)["gone"] == "back"


def logged(folder, lethal=None):
    """An extractor that leaves one file per call; one document ends its worker, after the others are through."""

    def extractor(row):
        if row["doc_key"] == lethal:
            time.sleep(4)
            os._exit(1)
        (folder / f"{row['doc_key']}-{row['batch']}-{uuid.uuid4().hex}").touch()
        return echo(row)

    return extractor


def calls_of(folder):
    return sorted(f.name.rsplit("-", 1)[0] for f in folder.iterdir())


def test_tasks_that_ended_keep_their_answers_when_a_worker_dies(spark, tmp_path, places):
    docs = spark.range(0, 8, 1, 8).selectExpr("CAST(id AS STRING) AS doc_key", "concat('t', id) AS text")
    log = tmp_path / "calls"
    log.mkdir()
    with pytest.raises(Exception, match="(?i)python worker"):
        run(spark, docs, logged(log, lethal="7"), *places, catalog=SMALL)
    assert len(calls_of(log)) == 21
    assert counts(run(spark, docs, logged(log), *places, catalog=SMALL)) == (8, 0, 8, 0, 0, 0)
    assert calls_of(log) == sorted(f"{i}-{b}" for i in range(8) for b in ("first", "second", "synthesis"))


def test_answers_of_a_dead_attempt_outlive_a_run_over_other_documents(spark, docs_of, places, tmp_path, monkeypatch):
    log = tmp_path / "calls"
    log.mkdir()
    x, y = docs_of(("a", "x"), ("b", "x")), docs_of(("c", "y"))
    with monkeypatch.context() as m:
        m.setattr(run_module, "append_results", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(spark, x, logged(log), *places, catalog=SMALL)
    run(spark, y, logged(log), *places, catalog=SMALL)
    run(spark, x, logged(log), *places, catalog=SMALL)
    assert len(calls_of(log)) == len(set(calls_of(log))) == 9
    assert titles(spark, places) == {"a": "x", "b": "x", "c": "y"}


def test_documents_outside_the_listing_are_left_alone(spark, docs_of, places):
    docs = docs_of(("a", "x"), ("q", "y"))
    assert counts(run(spark, docs, echo, *places, catalog=SMALL, listing=docs_of(("a", "")))) == (1, 0, 1, 0, 0, 0)
    assert titles(spark, places) == {"a": "x"}
    with pytest.raises(GuardError, match="not unique"):
        run(spark, docs_of(("b", "x"), ("b", "y")), echo, *places, catalog=SMALL, listing=docs_of(("b", "")))


def test_texts_and_cells_go_whole_and_with_the_system_text(spark, docs_of, places):
    def told(row):
        assert row["system"] == SYSTEM_TEXT
        return echo(row)

    text = "w" * 250_000
    run(spark, docs_of(("a", text)), told, *places, catalog=SMALL)
    assert titles(spark, places) == {"a": text}


def test_run_resumes_from_an_imported_snapshot(spark, docs_of, places, tmp_path):
    path = tmp_path / "old.json"
    path.write_text(json.dumps({"version": 1, "started_at": "2024-03-01T00:00:00+00:00", "updated_at": "2024-03-02T00:00:00+00:00",
                                "processed": ["a"], "failed": {"b": "no text"}}))
    for _ in range(2):
        import_snapshot(spark, str(path), places[1])
    docs = docs_of(("a", "x"), ("b", "y"))
    assert counts(run(spark, docs, echo, *places, catalog=SMALL)) == (2, 1, 1, 0, 0, 0)
    assert titles(spark, places) == {"b": "y"}
