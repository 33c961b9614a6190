"""Extraction, parse, merge and schema queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.operators.answers import (
    flatten_row,
    join_synthesis,
    merge_answers,
    merge_batches,
    nest,
    parse_answers,
    parse_strict,
    whole_answers,
)
from siftrow.operators.catalog import DEFAULT_CATALOG, Catalog, Entry, catalog_integrity, header_diff
from siftrow.operators.extract import Rule, TransientError, extract_by_rules, extract_documents, to_answers
from siftrow.operators.requests import batch_array
from siftrow.plans.queries.registry import DOC_KEY, documents, query, table
from siftrow.plans.queries.texts import REQUEST_SQL, batches_sql

# A catalog for web pages, to show that the catalog is an argument.
PAGE_CATALOG = Catalog(
    (
        Entry("Title", "title", "identity"),
        Entry("Address", "address", "identity"),
        Entry("Host (name)", "host", "identity"),
        Entry("Number", "number", "identity"),
        Entry("Publisher", "publisher", "identity"),
        Entry("Language", "lang", "content"),
        Entry("Headline", "headline", "content"),
        Entry("Links", "links", "content"),
        Entry("Opening / Lead", "opening", "content"),
        Entry("Footer", "footer", "synthesis"),
    )
)
PAGE_RULES = (
    Rule("title", "html", r"<title>(.*?)</title>"),
    Rule("address", "url", r"^(.+)$"),
    Rule("host", "url", r"^https?://([^/:?#]+)"),
    Rule("number", "url", r"/([0-9]+)"),
    Rule("lang", "html", r'<html lang="([a-z]+)"'),
    Rule("headline", "html", r"<h1>(.*?)</h1>"),
    Rule("links", "html", r'href="([^"]*)"', every=True),
    Rule("opening", "html", r"<p>(.*?)</p>"),
    Rule("footer", "html", r"<footer>(.*?)</footer>"),
)


def _rule_sql(field: str) -> str:
    rule = next((r for r in PAGE_RULES if r.field == field), None)
    if rule is None:
        return f"'NA' AS {field}"
    if rule.every:
        found = f"array_to_string(regexp_extract_all({rule.source}, '{rule.pattern}', {rule.group}), ' | ')"
    else:
        found = f"regexp_extract({rule.source}, '{rule.pattern}', {rule.group})"
    return f"coalesce(nullif({found}, ''), 'NA') AS {field}"


WIDE_SQL = "SELECT CAST(page_id AS VARCHAR) AS doc_key, {} FROM pages".format(
    ", ".join(_rule_sql(e.field) for e in PAGE_CATALOG.entries)
)
LONG_SQL = " UNION ALL ".join(
    f"SELECT doc_key, '{e.batch}' AS batch, '{e.field}' AS field, {e.field} AS value FROM wide"
    for e in PAGE_CATALOG.entries
)
ROW_SQL = "SELECT doc_key, {} FROM ({})".format(
    ", ".join(
        f"""left(regexp_replace({e.field}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), 32767) AS "{e.column}\""""
        for e in PAGE_CATALOG.entries
    ),
    WIDE_SQL,
)


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_key"), "url", "html")
    return extract_by_rules(pages, PAGE_RULES, PAGE_CATALOG)


@query(WIDE_SQL)
def extracted_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(spark, sf_dir)


@query(f"WITH wide AS ({WIDE_SQL}) {LONG_SQL}")
def long_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_answers(page_records(spark, sf_dir), PAGE_CATALOG)


@query(WIDE_SQL)
def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long answers without the ``NA`` ones, merged: absent fields come back as ``NA``."""
    stated = to_answers(page_records(spark, sf_dir), PAGE_CATALOG).where("value <> 'NA'")
    return merge_batches(stated, PAGE_CATALOG)


@query(ROW_SQL)
def flattened_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, long answers, merge, nest, flatten and clean: the whole chain."""
    answers = to_answers(page_records(spark, sf_dir), PAGE_CATALOG)
    return flatten_row(nest(merge_batches(answers, PAGE_CATALOG), PAGE_CATALOG), PAGE_CATALOG)


def digest_stub(row) -> str:
    """Stand-in for a model: a digest of the whole request, or a failure."""
    if row["batch"] == "participants" and " und " in row["request"]:
        raise ValueError("cannot answer")
    return hashlib.md5(row["request"].encode()).hexdigest()


@query(
    f"""
SELECT doc_key, batch, batch_ordinal, CASE WHEN bad THEN NULL ELSE md5(request) END AS response,
  CASE WHEN bad THEN 'extraction failed: cannot answer' END AS error, 1 AS attempts
FROM (SELECT doc_key, batch, batch_ordinal, {REQUEST_SQL.format(text="text")} AS request,
        batch = 'participants' AND contains({REQUEST_SQL.format(text="text")}, ' und ') AS bad
      FROM (SELECT {DOC_KEY}, text FROM documents) CROSS JOIN {batches_sql()})
"""
)
def extracted_with_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per document, its answers taken apart afterwards."""
    return answer_rows(extract_documents(documents(spark, sf_dir), digest_stub))


def answer_rows(nested: DataFrame) -> DataFrame:
    return nested.select("doc_key", F.inline("answers")).drop("asked")


def busy_stub():
    """Busy as many times as the text has lines beyond the first."""
    calls: dict[tuple[str, str], int] = {}

    def answer(row) -> str:
        at = (row["doc_key"], row["batch"])
        calls[at] = calls.get(at, 0) + 1
        if calls[at] < row["text"].count("\n") + 1:
            raise TransientError("busy")
        return hashlib.md5(row["text"].encode()).hexdigest()

    return answer


@query(
    f"""
SELECT doc_key, batch, batch_ordinal, CASE WHEN needed <= 5 THEN md5(text) END AS response,
  CASE WHEN needed > 5 THEN 'unavailable after 5 attempts: busy' END AS error,
  CAST(least(needed, 5) AS INTEGER) AS attempts
FROM (SELECT {DOC_KEY}, text, length(text) - length(replace(text, chr(10), '')) + 1 AS needed FROM documents)
CROSS JOIN {batches_sql()}
"""
)
def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_rows(extract_documents(documents(spark, sf_dir), busy_stub, per_task=True, wait=lambda _: 0.0))


_RESPONSE_SQL = """
CASE event_type
  WHEN 'click' THEN '{"user": "' || user_id || '", "kind": "click"}'
  WHEN 'signup' THEN '{"user": "' || user_id || '", "plan": "free"}'
  WHEN 'purchase' THEN '[' || props || ']'
  WHEN 'error' THEN substring(props, 1, length(props) - 1)
  ELSE props END
"""


# Two users' events come from a batch that no catalog knows, another's from none.
_BATCH_SQL = "CASE WHEN user_id % 10 IN (1, 2) THEN 'unheard' WHEN user_id % 10 <> 3 THEN 'props' END"
EVENT_CATALOG = Catalog(tuple(Entry(f.title(), f, "props") for f in ("user", "kind", "k")))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good objects, unknown fields, arrays, cut-off JSON and numbers, by event type; known and unknown batches."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("doc_key"),
        F.expr(_BATCH_SQL).alias("batch"),
        F.expr(_RESPONSE_SQL).alias("response"),
        F.lit(None).cast("string").alias("error"),
    )


@query(
    f"""
WITH r AS (SELECT CAST(event_id AS VARCHAR) AS doc_key, {_BATCH_SQL} AS batch, {_RESPONSE_SQL} AS response FROM events),
k AS (SELECT *, json_valid(response) AND coalesce(json_type(CASE WHEN json_valid(response) THEN response END), '') = 'OBJECT' AS obj FROM r),
f AS (SELECT *, CASE WHEN obj THEN list_sort([x for x in json_keys(response) if x NOT IN ('user', 'kind', 'k')]) END AS unknown,
        CASE WHEN obj THEN list_sort([x for x in json_keys(response) if json_type(response, '$.' || x) <> 'VARCHAR']) END AS other
      FROM k)
SELECT doc_key, CASE WHEN NOT obj THEN 'no parsed object: the response is not one JSON object'
    WHEN batch IS NULL THEN 'unknown batch: none' WHEN batch <> 'props' THEN 'unknown batch: ' || batch
    WHEN len(unknown) > 0 THEN 'unknown fields: ' || array_to_string(unknown, ', ')
    WHEN len(other) > 0 THEN 'values that are not text: ' || array_to_string(other, ', ') END AS error,
  CASE WHEN obj AND batch = 'props' AND len(unknown) = 0 AND len(other) = 0 THEN coalesce(response ->> 'user', 'NA') END AS user_name,
  CASE WHEN obj AND batch = 'props' AND len(unknown) = 0 AND len(other) = 0 THEN coalesce(response ->> 'kind', 'NA') END AS kind
FROM f
"""
)
def strictly_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_strict(_responses(spark, sf_dir), EVENT_CATALOG)

    def field(name: str):
        return F.when(F.col("answer").isNotNull(), F.coalesce(F.try_element_at("answer", F.lit(name)), F.lit("NA")))

    return parsed.select("doc_key", "error", field("user").alias("user_name"), field("kind").alias("kind"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an answer per batch: every field gets the language and its name. Those of source n fail in batch n."""
    fields = DEFAULT_CATALOG.allowed_fields

    def answer(b):
        cells = F.transform(fields(b["batch"]), lambda f: F.concat(F.lit('"'), f, F.lit('": "'), F.col("lang"), F.lit(" "), f, F.lit('"')))
        failing = F.col("source") == F.concat(F.lit("src"), b["batch_ordinal"].cast("string"))
        return F.struct(
            b["batch"].alias("batch"),
            b["batch_ordinal"].alias("batch_ordinal"),
            F.lit("").alias("asked"),
            F.concat(F.lit("{"), F.array_join(cells, ", "), F.lit("}")).alias("response"),
            F.when(failing, F.concat(F.lit("failed in "), b["batch"])).alias("error"),
            F.lit(1).alias("attempts"),
        )

    docs = documents(spark, sf_dir, "lang", "source")
    return docs.select("doc_key", F.transform(batch_array(DEFAULT_CATALOG), answer).alias("answers"))


@query(
    f"""
SELECT doc_key, bool_and(NOT bad) AS complete, count(*) FILTER (WHERE bad) AS failed_batches
FROM (SELECT doc_key, source = 'src' || batch_ordinal AS bad
      FROM (SELECT {DOC_KEY}, source FROM documents) CROSS JOIN {batches_sql()})
GROUP BY doc_key
"""
)
def complete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.size(F.filter("answers", lambda a: a["error"].isNotNull())).cast("bigint")
    return _answers(spark, sf_dir).select("doc_key", whole_answers(F.col("answers")).alias("complete"), failed.alias("failed_batches"))


_CELLS_SQL = ", ".join(
    f"""lang || ' {e.field}' AS "{e.column}\"""" for e in DEFAULT_CATALOG.entries
)


@query(
    f"""
SELECT doc_key, {_CELLS_SQL} FROM (SELECT {DOC_KEY}, lang, source FROM documents)
WHERE source NOT IN ({", ".join(f"'src{b.ordinal}'" for b in DEFAULT_CATALOG.batches)})
"""
)
def merged_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven JSON responses per document, parsed, merged and flattened to 39 columns."""
    parsed = _answers(spark, sf_dir).withColumn("answers", parse_answers(F.col("answers")))
    return flatten_row(merge_answers(parsed))


@query(
    f"""
SELECT d.doc_key, d.lang, d.source, l.quality, l.toxic
FROM (SELECT {DOC_KEY}, doc_id, lang, source FROM documents) d JOIN labels l ON d.doc_id = l.doc_id
"""
)
def joined_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    structured = documents(spark, sf_dir, F.struct("lang", "source").alias("structured"))
    synthesis = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("doc_key"), F.struct("quality", "toxic").alias("synthesis")
    )
    return join_synthesis(structured, synthesis).select("doc_key", "structured.*", "synthesis.*")


EXPECTED_LINKS = ("/de", "/the", "/in", "/was", "/los", "/is")
_EXPECTED_SQL = ", ".join(f"'{n}'" for n in EXPECTED_LINKS)


@query(
    f"""
WITH h AS (
  SELECT doc_key, CAST(generate_subscripts(names, 1) AS INTEGER) AS ordinal, unnest(names) AS name
  FROM (SELECT CAST(page_id AS VARCHAR) AS doc_key, regexp_extract_all(html, 'href="([^"]*)"', 1) AS names FROM pages)),
e AS (SELECT CAST(generate_subscripts([{_EXPECTED_SQL}], 1) AS INTEGER) AS place, unnest([{_EXPECTED_SQL}]) AS name)
SELECT doc_key, CASE WHEN place IS NULL THEN 'unexpected' ELSE 'moved' END AS kind, ordinal, name
FROM h LEFT JOIN e USING (name) WHERE place IS NULL OR place <> ordinal
UNION ALL
SELECT k.doc_key, 'missing', e.place, e.name FROM (SELECT DISTINCT doc_key FROM h) k CROSS JOIN e
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_key = k.doc_key AND h.name = e.name)
"""
)
def header_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's link list taken as a header and held against one expected list."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    headers = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("doc_key"), F.posexplode(links).alias("at", "name")
    )
    return header_diff(headers.select("doc_key", (F.col("at") + 1).alias("ordinal"), "name"), EXPECTED_LINKS)


@query(
    """
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS "column", md5(text) AS field, lang || source AS batch FROM documents)
SELECT (SELECT count(DISTINCT "column") FROM c) AS columns,
  (SELECT count(*) FROM (SELECT "column" FROM c GROUP BY "column" HAVING count(*) > 1)) AS columns_twice,
  (SELECT count(DISTINCT field) FROM c) AS fields,
  (SELECT count(*) FROM (SELECT field FROM c GROUP BY field HAVING count(*) > 1)) AS fields_twice,
  (SELECT count(*) FROM (SELECT field FROM c GROUP BY field HAVING count(DISTINCT batch) > 1)) AS shared_fields,
  (SELECT count(DISTINCT batch) FROM c) AS batches,
  (SELECT count(*) FROM c WHERE field IS NULL) AS unmapped
"""
)
def integrity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as columns, their texts as fields: exact copies show up as fields used twice."""
    docs = documents(spark, sf_dir, "text", "lang", "source")
    return catalog_integrity(
        docs.select(F.col("doc_key").alias("column"), F.md5("text").alias("field"), F.concat("lang", "source").alias("batch"))
    )
