"""Output-contract queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.operators.catalog import DEFAULT_CATALOG
from siftrow.operators.checks import (
    ARTICLE_TYPES,
    FOCUS_TOPICS,
    PARTICIPANT_FIELDS,
    REVIEW_FIELDS,
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
from siftrow.plans.queries.extraction import WIDE_SQL, page_records
from siftrow.plans.queries.registry import DOC_KEY, documents, query, table

# One expression per filled field, valid in both dialects; the other fields are
# 'NA'. Together they hold good and bad values of every kind the checks know.
_LINE = "split_part(text, chr(10), 1)"
ARTICLE_FIELDS = {
    "article_classification": "CASE lang WHEN 'en' THEN 'Field Study' WHEN 'fr' THEN 'Review | Case Study' "
    "WHEN 'de' THEN 'Simulation Study' ELSE 'Essay' END",
    "main_focus": "CASE source WHEN 'src1' THEN 'Thermal Comfort | Visual Comfort' WHEN 'src2' THEN 'Other (noise)' "
    "WHEN 'src3' THEN 'MULTIPLE' WHEN 'src4' THEN '' ELSE 'Comfort | ' || source END",
    "title": _LINE,
    "authors": f"CASE source WHEN 'src5' THEN '' WHEN 'src6' THEN ' ' ELSE replace({_LINE}, ' ', ' | ') END",
    "year": "CASE WHEN lang = 'es' THEN 'UNCERTAIN' ELSE CAST(n_chars AS STRING) END",
    "doi": "CASE lang WHEN 'en' THEN 'https://doi.org/10.1234/' || CAST(doc_id AS STRING) "
    "WHEN 'fr' THEN '10.1234/' || CAST(doc_id AS STRING) WHEN 'de' THEN 'ISBN ' || CAST(doc_id AS STRING) ELSE 'NA' END",
    "age": "CASE source WHEN 'src2' THEN '20-30 (assumed)' WHEN 'src4' THEN '20-30' ELSE 'NA' END",
    "questionnaire_extent": "CASE WHEN source = 'src1' THEN CAST(n_chars AS STRING) || ' forms' ELSE 'NA' END",
    "survey_time": "CASE source WHEN 'src1' THEN '09:00' WHEN 'src2' THEN '10:00' ELSE 'NA' END",
    "modeling_simulation": "CASE lang WHEN 'es' THEN 'NA' WHEN 'de' THEN 'no label — PURPOSE: ' || text "
    f"ELSE 'SOFTWARE: ' || source || ' — PURPOSE: ' || {_LINE} || ' — PURPOSE: again' END",
    "review_scope": f"CASE WHEN lang = 'fr' OR source = 'src1' THEN {_LINE} ELSE 'NA' END",
    "methodology": "text",
    "gmr_brief": f"CASE source WHEN 'src5' THEN '' WHEN 'src6' THEN '  ' ELSE {_LINE} END",
}


def _article(field: str) -> str:
    return ARTICLE_FIELDS.get(field, "'NA'")


ARTICLES_SQL = "SELECT {}, {} FROM documents".format(
    DOC_KEY, ", ".join(f"{_article(e.field)} AS {e.field}" for e in DEFAULT_CATALOG.entries)
)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_key"),
        *(F.expr(_article(e.field)).alias(e.field) for e in DEFAULT_CATALOG.entries),
    )


def _labelled(field: str) -> str:
    return f"{field} IN ('NA', 'UNCERTAIN', 'MULTIPLE')"


def _check_sql(field: str, ok: str) -> str:
    return f"""
SELECT doc_key, '{field}' AS field, {field} AS value, {_labelled(field)} OR ({ok}) AS ok FROM ({ARTICLES_SQL})
"""


_CLASS_SQL = (
    "CASE WHEN value IS NULL OR regexp_full_match(value, '\\s*') THEN 'blank' "
    "WHEN value IN ('NA', 'UNCERTAIN', 'MULTIPLE') THEN value ELSE 'value' END"
)
_CELLS_SQL = "WITH a AS ({}) {}".format(
    ARTICLES_SQL,
    " UNION ALL ".join(
        f"SELECT doc_key, '{e.field}' AS field, {e.field} AS value FROM a" for e in DEFAULT_CATALOG.entries
    ),
)


@query(f"SELECT doc_key, field, value, {_CLASS_SQL} <> 'blank' AS ok FROM ({_CELLS_SQL})")
def checked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_labels(articles(spark, sf_dir))


@query(
    f"""
SELECT field, class, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share
FROM (SELECT field, {_CLASS_SQL} AS class FROM ({_CELLS_SQL})) GROUP BY field, class
"""
)
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_profile(articles(spark, sf_dir))


@query(
    f"""
SELECT doc_key, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position, unnest(parts) AS part
FROM (SELECT {DOC_KEY}, string_split(text, ' | ') AS parts FROM documents)
"""
)
def split_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_multi(documents(spark, sf_dir), "text")


@query(_check_sql("year", "regexp_full_match(year, '[0-9]{4}')"))
def checked_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_year(articles(spark, sf_dir))


@query(_check_sql("doi", "NOT regexp_matches(doi, '10\\.[0-9]{4,}/') OR starts_with(doi, 'https://doi.org/')"))
def checked_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_identifier(articles(spark, sf_dir))


@query(_check_sql("authors", "len([x for x in string_split(authors, ' | ') if trim(x) <> 'et al.']) <= 6 AND NOT regexp_full_match(authors, '\\s*')"))
def checked_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_authors(articles(spark, sf_dir))


def _vocabulary_sql(field: str, vocabulary: tuple[str, ...]) -> str:
    known = ", ".join(f"'{v}'" for v in vocabulary)
    return _check_sql(
        field,
        f"len([x for x in string_split({field}, ' | ') "
        f"if x NOT IN ({known}) AND NOT regexp_full_match(x, 'Other \\(.*\\)')]) = 0",
    )


@query(
    _vocabulary_sql("article_classification", ARTICLE_TYPES) + " UNION ALL " + _vocabulary_sql("main_focus", FOCUS_TOPICS)
)
def checked_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = articles(spark, sf_dir)
    return check_vocabulary(table_, "article_classification", ARTICLE_TYPES).unionByName(
        check_vocabulary(table_, "main_focus", FOCUS_TOPICS)
    )


_SENTENCES = "len(regexp_extract_all({}, '[.!?](\\s|$)'))"


@query(
    _check_sql(
        "gmr_brief",
        "len(string_split_regex(trim(gmr_brief), '\\s+')) <= 40 AND NOT regexp_full_match(gmr_brief, '\\s*') AND "
        + _SENTENCES.format("gmr_brief")
        + " <= 1",
    )
)
def checked_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_brief(articles(spark, sf_dir))


@query(_check_sql("methodology", _SENTENCES.format("methodology") + " BETWEEN 2 AND 5"))
def checked_methodology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_methodology(articles(spark, sf_dir))


def _study_type_sql() -> str:
    typed = f"NOT ({_labelled('article_classification')})"
    not_review = f"{typed} AND NOT list_contains(string_split(article_classification, ' | '), 'Review')"
    simulated = "article_classification = 'Simulation Study'"
    no_survey = "questionnaire_extent = 'NA' AND questionnaire_questions = 'NA'"
    rules = [(f, not_review, f"{f} = 'NA'") for f in REVIEW_FIELDS]
    rules += [(f, simulated, f"{f} = 'NA' OR contains({f}, '(assumed)')") for f in PARTICIPANT_FIELDS]
    rules.append(("survey_time", no_survey, "survey_time = 'NA'"))
    return f"WITH a AS ({ARTICLES_SQL}) " + " UNION ALL ".join(
        f"SELECT doc_key, '{f}' AS field, {f} AS value, NOT ({when}) OR ({ok}) AS ok FROM a" for f, when, ok in rules
    )


@query(_study_type_sql())
def checked_study_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_study_type(articles(spark, sf_dir))


@query(
    f"""
SELECT doc_key, position, CASE WHEN ok THEN regexp_extract(section, '^([^:]+): ', 1) END AS label,
  CASE WHEN ok THEN substring(section, length(regexp_extract(section, '^([^:]+): ', 0)) + 1) ELSE section END AS body, ok
FROM (SELECT doc_key, position, section, regexp_matches(section, '^[^:]+: ') AS ok FROM (
  SELECT doc_key, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position, unnest(parts) AS section
  FROM (SELECT doc_key, string_split(modeling_simulation, ' — ') AS parts FROM ({ARTICLES_SQL})
        WHERE NOT ({_labelled("modeling_simulation")}))))
"""
)
def sections_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_sections(articles(spark, sf_dir))


GROUNDED_FIELDS = ("title", "headline", "links", "opening", "host")


def _marked_for_german(field: Column) -> Column:
    return F.when(F.col("lang") == "de", F.concat(F.lit("~"), field)).otherwise(field)


def _grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records held against their pages; German titles are changed and lose their ground."""
    records = page_records(spark, sf_dir).withColumn("title", _marked_for_german(F.col("title")))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_key"), "html")
    return check_grounding(records, pages, GROUNDED_FIELDS, text="html")


_GROUNDING_SQL = """
WITH w AS (SELECT wide.*, p.html FROM ({}) wide JOIN pages p ON wide.doc_key = CAST(p.page_id AS VARCHAR)),
c AS ({}),
v AS (SELECT doc_key, html, field, cell, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position, unnest(parts) AS value
      FROM (SELECT *, string_split(cell, ' | ') AS parts FROM c))
SELECT doc_key, field, position, value,
  cell IN ('NA', 'UNCERTAIN', 'MULTIPLE') OR (contains(html, value) AND NOT regexp_full_match(value, '\\s*')) AS ok
FROM v
""".format(
    WIDE_SQL,
    " UNION ALL ".join(
        "SELECT doc_key, html, '{0}' AS field, {1} AS cell FROM w".format(
            f, "CASE WHEN lang = 'de' THEN '~' || title ELSE title END" if f == "title" else f
        )
        for f in GROUNDED_FIELDS
    ),
)


@query(_GROUNDING_SQL)
def checked_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounding(spark, sf_dir)


@query(
    f"""
SELECT field, count(*) AS stated, count(*) FILTER (WHERE ok) AS grounded, count(*) FILTER (WHERE ok) / count(*) AS share
FROM ({_GROUNDING_SQL}) WHERE value NOT IN ('NA', 'UNCERTAIN', 'MULTIPLE') GROUP BY field
"""
)
def grounding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding_share(_grounding(spark, sf_dir))
