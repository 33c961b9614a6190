"""Planning the extraction calls: fan-out, request text, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrow.errors import GuardError
from siftrow.functions import sql
from siftrow.operators.catalog import DEFAULT_CATALOG, Catalog

# Our own wording of what every request asks for.
SYSTEM_TEXT = (
    "Fill a fixed table from one article. Take only what the article states, in its own words. "
    "Write NA for what it does not state, UNCERTAIN for what it leaves open, MULTIPLE where no "
    "single value leads. Separate several values with ' | '. Add no remarks."
)

# Fixed value: the frame around the article text.
REQUEST_FRAME = "\n\nARTICLE TEXT\n---\n{text}\n---"


def batch_array(catalog: Catalog) -> Column:
    """The catalog's batches as a constant array of structs."""
    rows = sql.listing(
        f"struct({sql.text(b.name)} AS batch, {b.ordinal} AS batch_ordinal, {sql.text(b.instruction)} AS instruction)"
        for b in catalog.batches
    )
    return F.expr(f"array({rows})")


def fan_out(docs: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Each document once per batch, all its columns kept.

    The batches are a constant, so this is a generator inside the scan stage:
    no join and no shuffle. Trim the text first, since it is repeated here.
    """
    return docs.select("*", F.inline(batch_array(catalog)))


def request_text(instruction: Column, text: Column) -> Column:
    before, after = REQUEST_FRAME.split("{text}")
    return F.concat(instruction, F.lit(before), text, F.lit(after))


def render_request(requests: DataFrame, text: str = "text") -> DataFrame:
    """Replace the instruction and text columns by the finished ``request``."""
    return requests.withColumn("request", request_text(F.col("instruction"), F.col(text))).drop(
        "instruction", text
    )


def request_volume(
    docs: DataFrame,
    catalog: Catalog = DEFAULT_CATALOG,
    text: str = "text",
    pages: str | None = None,
    requests_per_minute: int = 60,
    system: str = SYSTEM_TEXT,
) -> DataFrame:
    """Size of a run per batch and in total (``batch`` null), before it is paid for.

    Columns: batch, docs, pages, requests, chars, minutes. The ``system`` text
    goes with every request and is part of its size. The documents are
    reduced to one row before the batches come in, so the text is scanned once
    whatever the number of batches.
    """
    if requests_per_minute < 1:
        raise GuardError("requests_per_minute must be at least 1")
    page_total = F.sum(pages) if pages else F.lit(None).cast("bigint")
    totals = docs.agg(
        F.count("*").alias("docs"),
        F.coalesce(page_total, F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.length(text).cast("bigint")), F.lit(0)).alias("text_chars"),
    )
    frame = len(REQUEST_FRAME.format(text="")) + len(system)
    per_batch = totals.select("*", F.inline(batch_array(catalog))).select(
        "batch",
        "docs",
        "pages",
        F.col("docs").alias("requests"),
        (F.col("text_chars") + F.col("docs") * (F.length("instruction") + frame)).alias("chars"),
    )
    return per_batch.rollup("batch").agg(
        F.max("docs").alias("docs"),
        F.max("pages").alias("pages"),
        F.sum("requests").alias("requests"),
        F.sum("chars").alias("chars"),
        (F.sum("requests") / requests_per_minute).alias("minutes"),
    )
