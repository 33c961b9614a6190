import random

import pytest
from pyspark.sql import functions as F

from siftrow import GuardError, assemble_pages, assemble_trimmed, split_pages
from siftrow.functions.text import TRUNCATION_MARKER
from siftrow.operators import pages as pages_module


def as_dict(df):
    return {r.doc_key: r.text for r in df.collect()}


def pages_df(spark, docs):
    rows = [(k, i, t) for k, pages in docs.items() for i, t in enumerate(pages)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_key string, page_no int, text string")


DOCS = {
    "one": ["only"],
    "empty last": ["a", "b", ""],
    "null": ["a", None, "c"],
    "two blank": ["", ""],
    "nothing": [""],
    "many": [f"page {i}" for i in range(40)],
}


def test_split_keeps_trailing_empty_pages(docs_of):
    got = split_pages(docs_of(("d", "a\f\fb\f"), ("e", ""))).orderBy("doc_key", "page_no").collect()
    assert [(r.doc_key, r.page_no, r.text) for r in got] == [
        ("d", 0, "a"), ("d", 1, ""), ("d", 2, "b"), ("d", 3, ""), ("e", 0, ""),
    ]


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_assemble_restores_order(spark, monkeypatch, chunk):
    monkeypatch.setattr(pages_module, "PAGES_PER_CHUNK", chunk)
    want = {k: "\f".join(t or "" for t in v) for k, v in DOCS.items()}
    assert as_dict(assemble_pages(pages_df(spark, DOCS))) == want


def test_split_undoes_assemble(spark):
    text = assemble_pages(pages_df(spark, DOCS))
    again = split_pages(text)
    assert as_dict(assemble_pages(again)) == as_dict(text)


def truncated(text, limit):
    half = limit // 2
    return text if len(text) <= limit else text[:half] + TRUNCATION_MARKER + text[-half:]


@pytest.mark.parametrize("chunk", [1, 4])
@pytest.mark.parametrize("limit", [2, 7, 20, 31, 400])
def test_assemble_trimmed_equals_truncating_the_whole(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(pages_module, "PAGES_PER_CHUNK", chunk)
    rng = random.Random(limit)
    docs = dict(DOCS)
    for n in range(12):
        docs[f"random {n}"] = ["é" * rng.randrange(0, 9) for _ in range(rng.randrange(1, 30))]
    docs["long pages"] = ["0123456789" * 5, "abcdefghij" * 5]
    want = {k: truncated("\f".join(t or "" for t in v), limit) for k, v in docs.items()}
    assert as_dict(assemble_trimmed(pages_df(spark, docs), limit)) == want


def test_assemble_trimmed_holds_one_huge_document(spark):
    """A document with 200,000 pages: only its two ends are gathered."""
    pages = spark.range(200_000).select(
        F.lit("huge").alias("doc_key"), F.col("id").alias("page_no"), F.col("id").cast("string").alias("text")
    )
    whole = "\f".join(str(i) for i in range(200_000))
    assert as_dict(assemble_trimmed(pages, 1_000)) == {"huge": truncated(whole, 1_000)}


def test_assemble_trimmed_refuses_tiny_limits(spark):
    with pytest.raises(GuardError):
        assemble_trimmed(pages_df(spark, DOCS), 1)
