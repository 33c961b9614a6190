"""Text, page and request queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.functions.text import (
    cap_cell,
    fill_na,
    is_blank,
    page_count,
    sanitize_cell,
    truncate_middle,
)
from siftrow.operators.catalog import DEFAULT_CATALOG
from siftrow.operators.pages import assemble_pages, assemble_trimmed, split_pages
from siftrow.operators.requests import REQUEST_FRAME, SYSTEM_TEXT, fan_out, render_request, request_volume
from siftrow.plans.queries.registry import DOC_KEY, PAGED, documents, paged, query, table
from siftrow.sources.documents import decode_text, load_text, read_documents, scan_documents
from siftrow.sources.paths import scratch_folder

# Low enough for a good share of the texts to be cut.
SHORT_LIMIT = 2_000
# Bytes of one of the text files, about.
FILE_BYTES = 8 << 20

SPLIT_SQL = f"""
SELECT doc_key, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS page_no, unnest(parts) AS text
FROM (SELECT {DOC_KEY}, string_split({PAGED}, chr(12)) AS parts FROM documents)
"""
WHOLE_SQL = f"""
SELECT doc_key, string_agg(coalesce(text, ''), chr(12) ORDER BY page_no) AS text
FROM ({SPLIT_SQL}) GROUP BY doc_key
"""


def truncated_sql(limit: int, text: str = "text") -> str:
    half = limit // 2
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE left({text}, {half}) || "
        "chr(10) || chr(10) || '[... middle of article truncated ...]' || chr(10) || chr(10) || "
        f"right({text}, {half}) END"
    )


def batches_sql() -> str:
    """The default catalog's batches as a VALUES list."""
    rows = ", ".join(
        "({}, {}, '{}')".format(f"'{b.name}'", b.ordinal, b.instruction.replace("'", "''"))
        for b in DEFAULT_CATALOG.batches
    )
    return f"(VALUES {rows}) AS b(batch, batch_ordinal, instruction)"


REQUEST_SQL = (
    "instruction || chr(10) || chr(10) || 'ARTICLE TEXT' || chr(10) || '---' || chr(10) || {text} || chr(10) || '---'"
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of the documents, whole."""
    return split_pages(documents(spark, sf_dir).withColumn("text", paged("text")))


@query(SPLIT_SQL)
def split_into_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pages(documents(spark, sf_dir).withColumn("text", paged("text")))


@query(
    f"""
SELECT {DOC_KEY}, CAST(CASE WHEN length(text) > 0
  THEN length({PAGED}) - length(replace({PAGED}, chr(12), '')) + 1 ELSE 0 END AS INTEGER) AS pages
FROM documents
"""
)
def count_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_key", page_count(paged("text")).alias("pages"))


@query(WHOLE_SQL)
def pages_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_pages(_pages(spark, sf_dir))


@query(
    """
SELECT CAST(conv_id AS VARCHAR) AS doc_key, string_agg(coalesce(text, ''), chr(12) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
"""
)
def turns_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_key"), F.col("turn").alias("page_no"), "text"
    )
    return assemble_pages(turns)


@query(f"SELECT doc_key, {truncated_sql(SHORT_LIMIT)} AS text FROM ({WHOLE_SQL})")
def pages_to_trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_trimmed(_pages(spark, sf_dir), limit=SHORT_LIMIT)


@query(
    """
SELECT page_id, position, blank, CASE WHEN blank THEN 'no extractable text' END AS reason FROM (
  SELECT page_id, position, regexp_full_match(segment, '\\s*') AS blank FROM (
    SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position, unnest(parts) AS segment
    FROM (SELECT page_id, string_split_regex(html, '<[^>]*>') AS parts FROM pages)))
"""
)
def blank_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank test over the text between all tags of all pages."""
    segments = table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.split("html", "<[^>]*>", -1)).alias("position", "segment")
    )
    blank = is_blank(F.col("segment"))
    return segments.select(
        "page_id", "position", blank.alias("blank"), F.when(blank, "no extractable text").alias("reason")
    )


@query(f"SELECT {DOC_KEY}, {truncated_sql(SHORT_LIMIT)} AS text FROM documents")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", truncate_middle(F.col("text"), SHORT_LIMIT))


_NOISY = "replace(replace(text, '. ', '.' || chr(11) || chr(27) || ' '), ', ', ',' || chr(9) || chr(127))"


def _noisy(text: str):
    """Control characters after sentences, a tab and a delete character after commas."""
    stopped = F.replace(F.col(text), F.lit(". "), F.lit(".\x0b\x1b "))
    return F.replace(stopped, F.lit(", "), F.lit(",\t\x7f"))


@query(f"SELECT {DOC_KEY}, regexp_replace({_NOISY}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS text FROM documents")
def sanitized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", sanitize_cell(_noisy("text")))


@query(
    f"SELECT {DOC_KEY}, left(regexp_replace({_NOISY}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), 32767) AS text "
    "FROM documents"
)
def capped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", cap_cell(sanitize_cell(_noisy("text"))))


@query(
    """
SELECT CAST(d.doc_id AS VARCHAR) AS doc_key, coalesce(CAST(l.quality AS VARCHAR), 'NA') AS quality,
  coalesce(CAST(l.toxic AS VARCHAR), 'NA') AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
)
def filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_key"), "quality", "toxic")
    joined = documents(spark, sf_dir, "lang").join(labels, "doc_key", "left")
    return joined.select(
        "doc_key",
        fill_na(F.col("quality").cast("string")).alias("quality"),
        fill_na(F.col("toxic").cast("string")).alias("toxic"),
    )


@query(
    f"""
SELECT doc_key, CASE WHEN lang <> 'de' THEN text END AS text,
  CASE WHEN lang = 'de' OR text IS NULL THEN 'could not open: no readable text' END AS reason
FROM (SELECT {DOC_KEY}, text, lang FROM documents)
"""
)
def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to text; German documents get a byte that is not UTF-8."""
    docs = documents(spark, sf_dir, "text", "lang")
    raw = F.when(F.col("lang") == "de", F.concat(F.lit(b"\xff"), F.encode("text", "UTF-8"))).otherwise(
        F.encode("text", "UTF-8")
    )
    return load_text(docs.select("doc_key", decode_text(raw).alias("text")))


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files on storage, of about FILE_BYTES each however many there are.

    A file is read back as one value, so none may grow with the table. Texts are
    dealt one by one, so long ones that follow each other do not meet in a file.
    """
    folder = scratch_folder(spark)
    docs = documents(spark, sf_dir).select("text")
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint") + 1)).first()[0] or 0
    docs.repartition(max(1, -(-size // FILE_BYTES))).write.text(folder)
    return folder


@query(
    """
SELECT shelf, CAST(sum(strlen(text) + 1) AS BIGINT) AS length
FROM (SELECT text, lang || '-' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) AS shelf FROM documents) GROUP BY shelf
"""
)
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with its size. The documents lie on shelves, a file on each; contents are not read."""
    folder = scratch_folder(spark)
    shelf = F.concat("lang", F.lit("-"), F.left(F.md5("doc_key"), F.lit(1)))
    docs = documents(spark, sf_dir, "text", "lang").select("text", shelf.alias("shelf"))
    docs.repartition("shelf").write.partitionBy("shelf").text(folder)
    listing = scan_documents(spark, f"{folder}/shelf=*", ".txt", ordered=False, pattern=True)
    return listing.select(F.regexp_extract("path", "/shelf=([^/]+)/", 1).alias("shelf"), "length")


@query(
    """
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line
"""
)
def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files read back as documents and taken apart into lines."""
    folder = _text_files(spark, sf_dir)
    files = read_documents(spark, folder, ".txt", only=scan_documents(spark, folder, ".txt", ordered=False))
    body = F.left(F.col("text"), F.length("text") - 1)  # without the last line end
    return files.select(F.explode(F.split(body, "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@query(
    f"""
SELECT doc_key, batch, batch_ordinal, md5(text) AS text_md5, length(text) AS chars
FROM (SELECT {DOC_KEY}, text FROM documents) CROSS JOIN {batches_sql()}
"""
)
def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_out(documents(spark, sf_dir)).select(
        "doc_key", "batch", "batch_ordinal", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars")
    )


@query(
    f"""
SELECT doc_key, batch, batch_ordinal, md5(request) AS request_md5, length(request) AS chars
FROM (SELECT doc_key, batch, batch_ordinal, {REQUEST_SQL.format(text="text")} AS request
      FROM (SELECT {DOC_KEY}, text FROM documents) CROSS JOIN {batches_sql()})
"""
)
def rendered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_request(fan_out(documents(spark, sf_dir))).select(
        "doc_key",
        "batch",
        "batch_ordinal",
        F.md5("request").alias("request_md5"),
        F.length("request").cast("bigint").alias("chars"),
    )


@query(
    f"""
WITH per_batch AS (
  SELECT batch, count(*) AS docs, CAST(sum(length({PAGED}) - length(replace({PAGED}, chr(12), '')) + 1) AS BIGINT) AS pages,
    CAST(sum(length(text) + length(instruction) + {len(REQUEST_FRAME.format(text="")) + len(SYSTEM_TEXT)}) AS BIGINT) AS chars
  FROM documents CROSS JOIN {batches_sql()} GROUP BY batch)
SELECT batch, docs, pages, docs AS requests, chars, docs / 60 AS minutes FROM per_batch
UNION ALL
SELECT NULL, max(docs), max(pages), CAST(sum(docs) AS BIGINT), CAST(sum(chars) AS BIGINT), sum(docs) / 60 FROM per_batch
"""
)
def volume_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("pages", page_count(paged("text")))
    return request_volume(docs, pages="pages")
