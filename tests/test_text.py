import pytest
from pyspark.sql import functions as F

from siftrow import GuardError
from siftrow.functions.text import (
    TRUNCATION_MARKER,
    cap_cell,
    clean_cell,
    fill_na,
    is_blank,
    page_count,
    sanitize_cell,
    truncate_middle,
    value_array,
)


def evaluate(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


BLANKS = ["", " ", "\t\n", "\f\f", " ", "　", "\u0085", "\u001c", " ", "\r\n \v"]
NOT_BLANK = ["a", " x ", "​", "0", "﻿"]


def test_is_blank_matches_python_strip(spark):
    values = BLANKS + NOT_BLANK
    assert evaluate(spark, is_blank, values) == [not v.strip() for v in values]
    assert evaluate(spark, is_blank, BLANKS) == [True] * len(BLANKS)


def test_page_count(spark):
    values = ["", "one", "a\fb", "a\f", "\f", "a\f\fb", "\f\f"]
    want = [v.count("\f") + 1 if v else 0 for v in values]
    assert evaluate(spark, page_count, values) == want


@pytest.mark.parametrize("limit", [2, 3, 10, 11])
def test_truncate_middle(spark, limit):
    values = ["", "abc", "x" * limit, "x" * (limit + 1), "abcdefghijklmnopqrstuvwxyz", "😀é" * 20]
    half = limit // 2
    want = [v if len(v) <= limit else v[:half] + TRUNCATION_MARKER + v[-half:] for v in values]
    assert evaluate(spark, lambda c: truncate_middle(c, limit), values) == want


def test_truncation_default_limit_and_marker_length(spark):
    (got,) = evaluate(spark, truncate_middle, ["y" * 200_001])
    assert len(got) == 200_000 + len(TRUNCATION_MARKER) == 200_041


def test_truncation_refuses_tiny_limits():
    with pytest.raises(GuardError):
        truncate_middle(None, 1)


def test_sanitize_keeps_tab_newline_return_and_delete(spark):
    every = "".join(chr(i) for i in range(1, 0x80))
    want = "".join(c for c in every if ord(c) >= 0x20 or c in "\t\n\r")
    assert evaluate(spark, sanitize_cell, [every, "a\x0bb\x0cc\x1bd", None]) == [want, "abcd", None]


def test_cap_after_sanitize(spark):
    text = "\x0b" * 10 + "z" * 40_000
    assert evaluate(spark, clean_cell, [text]) == ["z" * 32_767]
    assert evaluate(spark, cap_cell, ["é" * 32_768, "short"]) == ["é" * 32_767, "short"]


def test_fill_na(spark):
    assert evaluate(spark, fill_na, [None, "", "x"]) == ["NA", "", "x"]


def test_value_array_splits_on_spaced_pipe_only(spark):
    got = evaluate(spark, value_array, ["a | b|c | d", "alone", "x | "])
    assert got == [["a", "b|c", "d"], ["alone"], ["x", ""]]
