import pytest

from siftrow import DEFAULT_CATALOG, SYSTEM_TEXT, GuardError, fan_out, render_request, request_volume
from siftrow.plans.run import plan_requests
from tests.conftest import plan_of


def test_fan_out_is_every_batch_without_a_join(docs_of):
    df = fan_out(docs_of(("a", "x"), ("b", "y")))
    got = {(r.doc_key, r.batch, r.batch_ordinal) for r in df.collect()}
    assert got == {(k, b.name, b.ordinal) for k in "ab" for b in DEFAULT_CATALOG.batches}
    assert "Join" not in plan_of(df) and "Exchange" not in plan_of(df)


def test_render_request(docs_of):
    rows = render_request(fan_out(docs_of(("a", "body")))).collect()
    first = next(r for r in rows if r.batch_ordinal == 1)
    assert first.request == DEFAULT_CATALOG.batches[0].instruction + "\n\nARTICLE TEXT\n---\nbody\n---"
    assert set(rows[0].asDict()) == {"doc_key", "batch", "batch_ordinal", "request"}


def test_request_volume(docs_of):
    docs = docs_of(("a", "12345"), ("b", "1"))
    rows = {r.batch: r for r in request_volume(docs, requests_per_minute=11).collect()}
    assert len(rows) == 12
    total = rows[None]
    assert (total.docs, total.requests, total.minutes) == (2, 22, 2.0)
    rendered = render_request(fan_out(docs)).collect()
    assert total.chars == sum(len(r.request) + len(SYSTEM_TEXT) for r in rendered)
    assert rows["review"].chars == sum(len(r.request) + len(SYSTEM_TEXT) for r in rendered if r.batch == "review")


def test_request_volume_of_nothing(docs_of):
    empty = docs_of(("a", "x")).where("false")
    total = next(r for r in request_volume(empty).collect() if r.batch is None)
    assert (total.docs, total.requests, total.chars, total.minutes) == (0, 0, 0, 0.0)


def test_request_volume_refuses_zero_rate(docs_of):
    with pytest.raises(GuardError):
        request_volume(docs_of(("a", "x")), requests_per_minute=0)


def test_plan_requests_stages(spark):
    rows = [
        ("ok", "text", None, None),
        ("gone", None, None, None),
        ("bad", "text", "could not open: damaged", None),
        ("blank", " 　\n", None, None),
        ("part", "text", None, ["review", "synthesis"]),
    ]
    docs = spark.createDataFrame(rows, "doc_key string, text string, reason string, have array<string>")
    got = {}
    for r in plan_requests(docs).collect():
        got.setdefault(r.doc_key, []).append(r)
    assert len(got["ok"]) == 11 and all(r.stage == "extract" and r.error is None for r in got["ok"])
    assert len(got["part"]) == 9 and not {"review", "synthesis"} & {r.batch for r in got["part"]}
    for key, stage, error in (
        ("gone", "read", "could not open: no readable text"),
        ("bad", "read", "could not open: damaged"),
        ("blank", "blank", "no extractable text"),
    ):
        (row,) = got[key]
        assert (row.stage, row.error, row.batch, row.request) == (stage, error, None, None)
