import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftrow import Catalog, Entry, GuardError, Rule, TransientError, extract_by_rules, extract_with, to_answers
from siftrow.operators import extract
from siftrow.operators.catalog import DEFAULT_CATALOG
from siftrow.operators.extract import exponential_wait, pacer, rules_of
from tests.conftest import plan_of

CATALOG = Catalog((Entry("T", "title", "x"), Entry("Y", "year", "x"), Entry("L", "links", "y"), Entry("N", "none", "y")))
RULES = (
    Rule("title", "text", r"Title: (.*)"),
    Rule("year", "text", r"\b([0-9]{4})\b"),
    Rule("links", "text", r"<(\w+)>", every=True),
)


def requests(spark, *keys):
    return spark.createDataFrame([(k, "b", 1, f"req {k}") for k in keys], "doc_key string, batch string, batch_ordinal int, request string")


def test_rules_and_answers(docs_of):
    docs = docs_of(("a", "Title: On Heat\nin 2023 <x> and <y>"), ("b", "nothing"))
    wide = extract_by_rules(docs, RULES, CATALOG)
    rows = {r.doc_key: r for r in wide.collect()}
    assert (rows["a"].title, rows["a"].year, rows["a"].links, rows["a"].none) == ("On Heat", "2023", "x | y", "NA")
    assert set(rows["b"][1:]) == {"NA"}
    long = {(r.doc_key, r.batch, r.field): r.value for r in to_answers(wide, CATALOG).collect()}
    assert len(long) == 8 and long["a", "y", "links"] == "x | y"
    assert "Exchange" not in plan_of(to_answers(wide, CATALOG))


def test_rules_from_table(spark, docs_of):
    table = spark.createDataFrame([("title", "text", "T=(.)", 1, False)], "field string, source string, pattern string, group int, every boolean")
    row = extract_by_rules(docs_of(("a", "T=q")), rules_of(table), CATALOG).head()
    assert row.title == "q"


def test_rules_for_unknown_field_are_refused(docs_of):
    with pytest.raises(GuardError, match="nope"):
        extract_by_rules(docs_of(("a", "x")), [Rule("nope", "text", "(x)")], CATALOG)


def test_one_failure_does_not_stop_the_rest(spark):
    def extractor(row):
        if row["doc_key"] == "b":
            raise ValueError("boom")
        return json.dumps({"k": row["request"]})

    got = {r.doc_key: r for r in extract_with(requests(spark, "a", "b", "c"), extractor).collect()}
    assert got["a"].response == '{"k": "req a"}' and got["c"].error is None
    assert (got["b"].response, got["b"].error, got["b"].attempts) == (None, "extraction failed: boom", 1)


@pytest.mark.parametrize("kind", [TransientError, TimeoutError, ConnectionError])
def test_transient_errors_are_tried_five_times(spark, kind):
    def extractor(row):
        raise kind("slow down")

    (row,) = extract_with(requests(spark, "a"), extractor, wait=lambda _: 0).collect()
    assert (row.attempts, row.error) == (5, "unavailable after 5 attempts: slow down")


def test_transient_then_fine(spark):
    def make():
        seen = {}

        def extractor(row):
            seen[row["doc_key"]] = seen.get(row["doc_key"], 0) + 1
            if seen[row["doc_key"]] < 3:
                raise TransientError("busy")
            return "{}"

        return extractor

    rows = extract_with(requests(spark, "a", "b"), make, per_task=True, wait=lambda _: 0, max_attempts=3).collect()
    assert [(r.response, r.error, r.attempts) for r in rows] == [("{}", None, 3)] * 2


def test_waits_double_within_bounds():
    assert [exponential_wait(n) for n in range(1, 8)] == [2, 2, 4, 8, 16, 30, 30]


def test_rows_with_an_error_are_not_called(spark):
    def extractor(row):
        raise AssertionError("must not be called")

    df = requests(spark, "a").withColumn("error", F.lit("blank"))
    (row,) = extract_with(df, extractor).collect()
    assert (row.error, row.attempts, row.response) == ("blank", 0, None)


def test_attempts_must_be_positive(spark):
    with pytest.raises(GuardError):
        extract_with(requests(spark, "a"), lambda r: "", max_attempts=0)


def test_pace_counts_every_attempt_and_the_time_of_the_call():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    ready = pacer(2.0, lambda: now[0], sleep)
    ready()
    now[0] += 0.5
    ready()
    now[0] += 5
    ready()
    ready()
    assert slept == [1.5, 2.0]


def test_two_rules_for_one_field_are_refused(docs_of):
    rules = [Rule("title", "text", "a(.)"), Rule("title", "text", "b(.)")]
    with pytest.raises(GuardError, match="several rules"):
        extract_by_rules(docs_of(("d", "ab")), rules)


def test_a_task_holds_the_answers_of_few_documents(monkeypatch):
    texts = ["aa", None, "b" * 50, "", "cc", "dd", "ee"]
    batch = pa.RecordBatch.from_pydict({"doc_key": [str(i) for i in range(7)], "text": pa.array(texts, pa.string())})
    monkeypatch.setattr(extract, "DOCUMENTS_AT_A_TIME", 3)
    monkeypatch.setattr(extract, "TEXT_BYTES_AT_A_TIME", 10)
    parts = [p.column("doc_key").to_pylist() for p in extract.few_documents(batch, "text")]
    assert parts == [["0", "1"], ["2"], ["3", "4", "5"], ["6"]]
    assert list(extract.few_documents(batch.slice(0, 0), "text")) == []


@pytest.mark.parametrize("threads", [1, 3])
def test_answers_of_many_documents_stay_with_their_own(spark, threads):
    docs = spark.range(700).coalesce(1).select(F.col("id").cast("string").alias("doc_key"), F.concat(F.lit("text "), "id").alias("text"))
    called = extract.extract_documents(docs, lambda row: f"{row['batch']} {row['text']}", threads=threads)
    rows = called.collect()
    assert len({r.doc_key for r in rows}) == len(rows) == 700
    names = [b.name for b in DEFAULT_CATALOG.batches]
    assert all([a.response for a in r.answers] == [f"{n} text {r.doc_key}" for n in names] for r in rows)
