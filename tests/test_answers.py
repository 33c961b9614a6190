import json

import pytest
from pyspark.sql import functions as F

from siftrow import (
    DEFAULT_CATALOG,
    all_or_nothing,
    flatten_row,
    join_synthesis,
    merge_batches,
    merge_responses,
    nest,
    parse_strict,
)
from siftrow.operators.answers import merge_answers, parse_answers
from siftrow.operators.ledger import document_outcome
from tests.conftest import plan_of

NOT_OBJECT = "no parsed object: the response is not one JSON object"
CASES = [
    ('{"a":"x","b":"y"}', None, {"a": "x", "b": "y"}),
    ('{"a":"x"}', None, {"a": "x"}),
    ("{}", None, {}),
    (' {"a":"x"}\n', None, {"a": "x"}),
    ('{"a":"x}]"}', None, {"a": "x}]"}),
    ('{"a":"\\u00e9\\n"}', None, {"a": "é\n"}),
    ('{"a":"2024-01-01"}', None, {"a": "2024-01-01"}),
    ('{"a":""}', None, {"a": ""}),
    ('{"a":"x","z":"y"}', "unknown fields: z", None),
    ('{"A":"x"}', "unknown fields: A", None),
    ('{"a":1}', "values that are not text: a", None),
    ('{"a":null}', "values that are not text: a", None),
    ('{"a":true,"b":[]}', "values that are not text: a, b", None),
    ('{"a":{"b":"c"}}', "values that are not text: a", None),
    ('["a"]', NOT_OBJECT, None),
    ('"a"', NOT_OBJECT, None),
    ("null", NOT_OBJECT, None),
    ("", NOT_OBJECT, None),
    (None, NOT_OBJECT, None),
    ("{bad", NOT_OBJECT, None),
    ('{"a":"x",}', NOT_OBJECT, None),
    ("{'a':'x'}", NOT_OBJECT, None),
    ('{"a":"x","a":"y"}', NOT_OBJECT, None),
    ('{"a":"x"} trailing', NOT_OBJECT, None),
    ('{"a":"x"}{"b":"y"}', NOT_OBJECT, None),
    ('{"a":"x"},{"b":"y"}', NOT_OBJECT, None),
    ('{"a":"x"}]', NOT_OBJECT, None),
    ('{"a":"x"}] }', NOT_OBJECT, None),
    ('{"a":"x"}}', NOT_OBJECT, None),
]


def test_parse_strict_cases(spark):
    df = spark.createDataFrame([(i, r, None) for i, (r, _, _) in enumerate(CASES)], "i int, response string, error string")
    rows = parse_strict(df, allowed=F.array(F.lit("a"), F.lit("b"))).orderBy("i").collect()
    for row, (response, error, answer) in zip(rows, CASES, strict=True):
        assert (row.error, row.answer) == (error, answer), response


def test_parse_uses_the_fields_of_the_batch_and_keeps_errors(spark):
    rows = [("review", '{"title":"x"}', None), ("bibliographic", '{"title":"x"}', None), ("review", "{}", "timed out"), ("no such", "{}", None)]
    df = spark.createDataFrame(rows, "batch string, response string, error string")
    got = [(r.error, r.answer) for r in parse_strict(df).collect()]
    assert got[0] == ("unknown fields: title", None)
    assert got[1] == (None, {"title": "x"})
    assert got[2] == ("timed out", None)
    assert got[3] == ("unknown batch: no such", None)


def test_a_batch_that_is_not_known_is_an_error(spark):
    rows = [("nope", '{"x":"y"}', None), (None, '{"x":"y"}', None), ("nope", "{bad", None), ("nope", None, "timed out")]
    df = spark.createDataFrame(rows, "batch string, response string, error string")
    got = [(r.error, r.answer) for r in parse_strict(df).collect()]
    assert got == [("unknown batch: nope", None), ("unknown batch: none", None), (NOT_OBJECT, None), ("timed out", None)]


def nested(spark, *documents):
    """Rows of (key, [(batch, response, error)])."""
    ordinal = {b.name: b.ordinal for b in DEFAULT_CATALOG.batches}
    rows = [(key, [(b, ordinal.get(b), "", r, e, 1) for b, r, e in answers]) for key, answers in documents]
    one = "struct<batch:string,batch_ordinal:int,asked:string,response:string,error:string,attempts:int>"
    return spark.createDataFrame(rows, f"doc_key string, answers array<{one}>")


def test_nested_answers_are_read_like_rows(spark):
    allowed = {f for b in DEFAULT_CATALOG.batches if b.name == "classification" for f in b.fields}
    first, second = sorted(allowed)
    texts = [None if r is None else r.replace('"a"', f'"{first}"').replace('"b"', f'"{second}"') for r, _, _ in CASES]
    answers = [("classification", t, None) for t in texts] + [("nope", '{"x":"y"}', None), (None, "{}", None), ("review", "{}", "timed out")]
    (row,) = nested(spark, ("d", answers)).select(parse_answers(F.col("answers")).alias("answers")).collect()
    rows = spark.createDataFrame(answers, "batch string, response string, error string")
    flat = [(r.error, r.answer) for r in parse_strict(rows).collect()]
    assert [(a.error, a.answer) for a in row.answers] == flat
    assert [(a.batch, a.response) for a in row.answers] == [(b, r) for b, r, _ in answers]


def whole(key, without=(), failing=()):
    return (key, [(b.name, None if b.name in failing else json.dumps({f: f"{key} {f}" for f in b.fields[:1]}), "boom" if b.name in failing else None) for b in DEFAULT_CATALOG.batches if b.name not in without])


def test_nested_answers_merge_without_a_shuffle(spark):
    docs = nested(spark, whole("a"), whole("b", without=["review"]), whole("c", failing=["review", "indexes"]), ("d", []), ("e", whole("e")[1] * 2))
    parsed = docs.withColumn("answers", parse_answers(F.col("answers"))).withColumns({"stage": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    merged = flatten_row(merge_answers(parsed))
    assert "Exchange" not in plan_of(merged)
    rows = {r.doc_key: r for r in merged.collect()}
    assert rows.keys() == {"a", "e"}
    firsts = {b.fields[0] for b in DEFAULT_CATALOG.batches}
    assert all(rows["a"][e.column] == (f"a {e.field}" if e.field in firsts else "NA") for e in DEFAULT_CATALOG.entries)
    outcomes = document_outcome(parsed)
    assert "Exchange" not in plan_of(outcomes)
    got = {r.doc_key: (r.status, r.stage, r.reason) for r in outcomes.collect()}
    assert got["a"] == got["e"] == ("done", None, None)
    assert got["b"] == got["d"] == ("failed", "extract", "not every batch was answered")
    assert got["c"] == ("failed", "extract", "boom")


STRUCTURED = {
    "article_classification": "Case Study", "main_focus": "Acoustic Comfort", "title": "Bells over the Harbour", "authors": "Okafor, Ada | Lind, Per",
    "year": "1987", "country": "Norway", "variables_quantitative": "LAeq (dB) | L10 (dB)",
}
SYNTHESIS = {"research_questions": "Who hears it?", "key_goals": "Map the sound.", "methodology": "Walks. Counts.", "gmr_brief": "Ships are louder."}


def responses(spark, key, failing=(), skip=()):
    rows = []
    for b in DEFAULT_CATALOG.batches:
        if b.name in skip:
            continue
        given = {f: v for f, v in {**STRUCTURED, **SYNTHESIS}.items() if f in b.fields}
        error = "boom" if b.name in failing else None
        rows.append((key, b.name, b.ordinal, None if error else json.dumps(given), error))
    return spark.createDataFrame(rows, "doc_key string, batch string, batch_ordinal int, response string, error string")


def test_merge_flatten_aligns_cells_with_columns(spark):
    rows = flatten_row(merge_responses(parse_strict(responses(spark, "d")))).collect()
    (row,) = rows
    assert row.__fields__ == ["doc_key", *DEFAULT_CATALOG.columns]
    given = {**STRUCTURED, **SYNTHESIS}
    for e in DEFAULT_CATALOG.entries:
        assert row[e.column] == given.get(e.field, "NA"), e.column


@pytest.mark.parametrize("failing", ["classification", "review", "synthesis"])
def test_one_failed_batch_drops_the_document(spark, failing):
    mixed = responses(spark, "good").unionByName(responses(spark, "bad", failing=[failing]))
    assert [r.doc_key for r in merge_responses(parse_strict(mixed)).collect()] == ["good"]
    flags = {r.doc_key: (r.complete, r.failed_batches) for r in all_or_nothing(mixed).collect()}
    assert flags == {"good": (True, 0), "bad": (False, 1)}


def test_absent_batch_is_not_complete(spark):
    df = responses(spark, "short", skip=["indexes"])
    assert merge_responses(parse_strict(df)).count() == 0
    assert all_or_nothing(df).head().complete is False


def test_merge_batches_fills_absent_fields(spark):
    rows = [("d", "bibliographic", "title", "T"), ("d", "review", "conclusions", "C"), ("e", "bibliographic", "year", "1999")]
    df = merge_batches(spark.createDataFrame(rows, "doc_key string, batch string, field string, value string"))
    got = {r.doc_key: r for r in df.collect()}
    assert (got["d"].title, got["d"].conclusions, got["d"].year) == ("T", "C", "NA")
    assert len(df.columns) == 40
    flat = flatten_row(nest(df))
    assert {r.doc_key: r["Conclusions"] for r in flat.collect()} == {"d": "C", "e": "NA"}


def test_flatten_cleans_cells(spark):
    wide = merge_batches(spark.createDataFrame([("d", "b", "title", "a\x0bb" + "z" * 40_000)], "doc_key string, batch string, field string, value string"))
    assert flatten_row(nest(wide)).head()["Title"] == "ab" + "z" * 40_000
    assert flatten_row(nest(wide), cap=32_767).head()["Title"] == ("ab" + "z" * 40_000)[:32_767]
    assert flatten_row(nest(wide), clean=False).head()["Title"].startswith("a\x0bb")


def test_join_synthesis_needs_both(spark):
    left = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_key string, v string").select("doc_key", F.struct("v").alias("structured"))
    right = spark.createDataFrame([("b", "z")], "doc_key string, w string").select("doc_key", F.struct("w").alias("synthesis"))
    (row,) = join_synthesis(left, right).collect()
    assert (row.doc_key, row.structured.v, row.synthesis.w) == ("b", "y", "z")
