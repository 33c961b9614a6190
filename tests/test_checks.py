import pytest
from pyspark.sql import functions as F

from siftrow import DEFAULT_CATALOG, Catalog, Entry
from siftrow.operators.checks import (
    ARTICLE_TYPES,
    FOCUS_TOPICS,
    by_field,
    check_authors,
    check_brief,
    check_grounding,
    check_identifier,
    check_labels,
    check_methodology,
    check_study_type,
    check_vocabulary,
    check_year,
    explode_multi,
    grounding_share,
    label_profile,
    labelled_sections,
)

CATALOG = Catalog((Entry("Year", "year", "b"), Entry("Title", "title", "b")))


def column(spark, field, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], f"doc_key string, {field} string")


def verdicts(df):
    return [r.ok for r in df.orderBy(F.col("doc_key").cast("int")).collect()]


def test_labels_and_profile(spark):
    rows = [("0", "2020", "NA"), ("1", "UNCERTAIN", ""), ("2", " ", "MULTIPLE"), ("3", None, "na")]
    df = spark.createDataFrame(rows, "doc_key string, year string, title string")
    bad = {(r.doc_key, r.field) for r in check_labels(df, CATALOG).where("not ok").collect()}
    assert bad == {("2", "year"), ("3", "year"), ("1", "title")}
    profile = {(r.field, r["class"]): (r.n, r.share) for r in label_profile(df, CATALOG).collect()}
    assert profile["year", "blank"] == (2, 0.5) and profile["title", "value"] == (1, 0.25)
    assert sum(n for n, _ in profile.values()) == 8


def test_explode_multi(spark):
    rows = explode_multi(column(spark, "v", "a | b|c | d", "one"), "v").orderBy("doc_key", "position").collect()
    assert [(r.doc_key, r.position, r.part) for r in rows] == [("0", 0, "a"), ("0", 1, "b|c"), ("0", 2, "d"), ("1", 0, "one")]


@pytest.mark.parametrize(
    ("check", "field", "cases"),
    [
        (check_year, "year", {"2023": True, "23": False, "20234": False, "2023a": False, "NA": True, "": False, "UNCERTAIN": True}),
        (
            check_identifier,
            "doi",
            {
                "https://doi.org/10.1016/j.x": True, "10.1016/j.x": False, "doi:10.1016/j.x": False,
                "ISBN 978-3-16": True, "NA": True, "http://dx.doi.org/10.1234/a": False,
            },
        ),
        (
            check_authors,
            "authors",
            {
                " | ".join("ABCDEF"): True, " | ".join("ABCDEFG"): False, " | ".join("ABCDEF") + " | et al.": True,
                "A | B | C | D | E | F et al.": True, "NA": True,
                "": False, "\t": False, "  ": False, "\u3000": False,
            },
        ),
        (
            check_brief,
            "gmr_brief",
            {
                "Do this using that, finding it.": True, " ".join(["w"] * 40) + ".": True, " ".join(["w"] * 41): False,
                "One. Two.": False, "Value 5.2 is fine": True, "NA": True,
                "": False, "\t": False, "  ": False, "\xa0": False,
            },
        ),
        (
            check_methodology,
            "methodology",
            {"One sentence.": False, "One. Two.": True, "A. B. C. D. E.": True, "A. B. C. D. E. F.": False, "no end": False, "NA": True},
        ),
    ],
)
def test_field_checks(spark, check, field, cases):
    df = check(column(spark, field, *cases))
    assert df.columns == ["doc_key", "field", "value", "ok"]
    assert dict(zip(cases, verdicts(df), strict=True)) == cases


def test_null_is_never_ok(spark):
    assert verdicts(check_year(column(spark, "year", None))) == [False]


def test_vocabulary(spark):
    cases = {
        "Field Study": True, "Review | Case Study": True, "Mixed (Field + Simulation)": True, "Other (survey of surveys)": True,
        "Essay": False, "Review | Essay": False, "review": False, "MULTIPLE": True,
    }
    df = check_vocabulary(column(spark, "article_classification", *cases), "article_classification", ARTICLE_TYPES)
    assert dict(zip(cases, verdicts(df), strict=True)) == cases
    assert (len(ARTICLE_TYPES), len(FOCUS_TOPICS)) == (8, 7)


def study(spark, **given):
    cells = [F.lit(given.get(e.field, "NA")).alias(e.field) for e in DEFAULT_CATALOG.entries]
    return spark.range(1).select(F.lit("d").alias("doc_key"), *cells)


@pytest.mark.parametrize(
    ("given", "bad"),
    [
        ({"article_classification": "Field Study"}, set()),
        ({"article_classification": "Field Study", "review_scope": "all", "conclusions": "c"}, {"review_scope", "conclusions"}),
        ({"article_classification": "Review", "review_scope": "all"}, set()),
        ({"article_classification": "Case Study | Review", "review_scope": "all"}, set()),
        ({"article_classification": "UNCERTAIN", "review_scope": "all"}, set()),
        ({"article_classification": "Simulation Study", "age": "20-30", "gender": "mixed (assumed)"}, {"age"}),
        ({"article_classification": "Mixed (Field + Simulation)", "age": "20-30"}, set()),
        ({"article_classification": "Field Study", "survey_time": "noon"}, {"survey_time"}),
        ({"article_classification": "Field Study", "survey_time": "noon", "questionnaire_extent": "9"}, set()),
    ],
)
def test_study_type_rules(spark, given, bad):
    rows = check_study_type(study(spark, **given)).collect()
    assert {r.field for r in rows if not r.ok} == bad
    assert len(rows) == 13


def test_labelled_sections(spark):
    df = labelled_sections(column(spark, "modeling_simulation", "SOFTWARE: A 4.0 | B — PURPOSE: x: y — free text — PURPOSE: again", "NA"))
    got = [(r.doc_key, r.position, r.label, r.body, r.ok) for r in df.orderBy("doc_key", "position").collect()]
    assert got == [
        ("0", 0, "SOFTWARE", "A 4.0 | B", True),
        ("0", 1, "PURPOSE", "x: y", True),
        ("0", 2, None, "free text", False),
        ("0", 3, "PURPOSE", "again", True),
    ]


def test_grounding_is_told_per_value(spark, docs_of):
    rows = [("a", "blue", "alpha | gamma | beta"), ("b", "green", "NA"), ("c", "NA", "x | q"), ("e", "no document", ""), ("f", None, "a | ")]
    df = spark.createDataFrame(rows, "doc_key string, title string, parts string")
    docs = docs_of(("a", "blue, alpha beta"), ("b", "only blue"), ("c", "x"), ("d", "unused"), ("f", "a | b"))
    checked = check_grounding(df, docs, ("title", "parts"))
    assert checked.columns == ["doc_key", "field", "position", "value", "ok"]
    got = sorted((r.doc_key, r.field, r.position, r.value, r.ok) for r in checked.where("value is not null").collect())
    assert got == [
        ("a", "parts", 0, "alpha", True), ("a", "parts", 1, "gamma", False), ("a", "parts", 2, "beta", True), ("a", "title", 0, "blue", True),
        ("b", "parts", 0, "NA", True), ("b", "title", 0, "green", False),
        ("c", "parts", 0, "x", True), ("c", "parts", 1, "q", False), ("c", "title", 0, "NA", True),
        ("e", "parts", 0, "", False), ("e", "title", 0, "no document", False),
        ("f", "parts", 0, "a", True), ("f", "parts", 1, "", False),
    ]
    (null,) = checked.where("value is null").collect()
    assert (null.doc_key, null.field, null.position, null.ok) == ("f", "title", 0, False)
    share = {r.field: (r.stated, r.grounded) for r in grounding_share(checked).collect()}
    assert share == {"title": (3, 1), "parts": (8, 4)}


def test_by_field_renames(spark):
    df = spark.createDataFrame([("d", "1999", "T")], ["doc_key", "Year", "Title"])
    assert by_field(df, CATALOG).columns == ["doc_key", "year", "title"]
