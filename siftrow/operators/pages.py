"""Pages to text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrow.errors import GuardError
from siftrow.functions.text import MAX_TEXT_CHARS, PAGE_BREAK, TRUNCATION_MARKER, page_array

# Pages gathered into one piece before the pieces of a document meet.
PAGES_PER_CHUNK = 256


def split_pages(docs: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """One row per page: (key, page_no from 0, text). No shuffle."""
    return docs.select(key, F.posexplode(page_array(F.col(text))).alias("page_no", "text"))


def assemble_pages(
    pages: DataFrame, key: str = "doc_key", page_no: str = "page_no", text: str = "text"
) -> DataFrame:
    """Pages of each document in page order, joined by a form feed.

    A null page counts as empty and keeps its place. Works in two steps: pages
    to chunks of consecutive pages, chunks to text. The first step spreads one
    huge document over many tasks; the second meets one row per chunk. The
    result is one value per document, so use :func:`assemble_trimmed` where
    only the trimmed text is wanted.
    """
    chunk = F.floor(F.col(page_no) / PAGES_PER_CHUNK).alias("chunk")
    ordered = pages.select(
        key, chunk, F.col(page_no).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("piece")
    )
    chunks = ordered.groupBy(key, "chunk").agg(_joined("at").alias("piece"))
    return chunks.groupBy(key).agg(_joined("chunk").alias("text"))


def _joined(order: str):
    rows = F.array_sort(F.collect_list(F.struct(order, "piece")))
    return F.array_join(F.transform(rows, lambda r: r["piece"]), PAGE_BREAK)


def assemble_trimmed(
    pages: DataFrame,
    limit: int = MAX_TEXT_CHARS,
    key: str = "doc_key",
    page_no: str = "page_no",
    text: str = "text",
) -> DataFrame:
    """Equal to ``truncate_middle(assemble_pages(...))``, in bounded memory.

    Offsets are worked out on page lengths alone: per chunk first, then a
    running sum over chunks. Only pages that reach into the first or last
    ``limit // 2`` characters are read for their text, so however many pages a
    document has, no group holds more than about ``limit`` characters.
    """
    if limit < 2:
        raise GuardError(f"the text limit must be at least 2, not {limit}")
    half = limit // 2
    sized = pages.select(
        key,
        F.floor(F.col(page_no) / PAGES_PER_CHUNK).alias("chunk"),
        F.col(page_no).alias("at"),
        F.coalesce(F.col(text), F.lit("")).alias("piece"),
    ).withColumn("span", F.length("piece") + F.lit(1))  # the page and the break after it

    spans = sized.groupBy(key, "chunk").agg(F.sum("span").alias("span"))
    document = Window.partitionBy(key)
    before = document.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        spans.withColumn("start", F.coalesce(F.sum("span").over(before), F.lit(0)))
        .withColumn("total", F.sum("span").over(document) - 1)
        .where(
            (F.col("total") <= limit)
            | (F.col("start") < half)
            | (F.col("start") + F.col("span") > F.col("total") - half)
        )
        .drop("span")
    )

    # Within a chunk the running sum meets at most PAGES_PER_CHUNK pages.
    inside = Window.partitionBy(key, "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.join(edges, [key, "chunk"])
        .withColumn("start", F.col("start") + F.coalesce(F.sum("span").over(inside), F.lit(0)))
        # The break belongs to the page before it, except after the last page.
        .withColumn("last", F.col("start") + F.col("span") > F.col("total"))
        .withColumn("piece", F.when(F.col("last"), F.col("piece")).otherwise(F.concat("piece", F.lit(PAGE_BREAK))))
    )
    short = F.col("total") <= limit
    from_head = F.col("piece").substr(F.lit(1), F.greatest(F.lit(half) - F.col("start"), F.lit(0)).cast("int"))
    # Characters of this piece that lie in the last half of the limit.
    tail_size = F.least(
        F.length("piece"),
        F.greatest(F.col("start") + F.length("piece") - (F.col("total") - half), F.lit(0)),
    ).cast("int")
    from_tail = F.right(F.col("piece"), tail_size)
    cut = placed.select(
        key,
        "at",
        "total",
        F.when(short, F.col("piece")).otherwise(from_head).alias("head"),
        F.when(short, F.lit("")).otherwise(from_tail).alias("tail"),
    ).where((F.length("head") > 0) | (F.length("tail") > 0) | short)

    def run_together(column: str):
        rows = F.array_sort(F.collect_list(F.struct("at", column)))
        return F.array_join(F.transform(rows, lambda r: r[column]), "")

    return (
        cut.groupBy(key)
        .agg(F.first("total").alias("total"), run_together("head").alias("head"), run_together("tail").alias("tail"))
        .select(
            key,
            F.when(short, F.col("head"))
            .otherwise(F.concat("head", F.lit(TRUNCATION_MARKER), "tail"))
            .alias("text"),
        )
    )
