"""Document collections: listing, text, header rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrow.errors import GuardError

# The most bytes Spark can hold in one value.
MAX_VALUE_BYTES = (1 << 31) - 16
#: Files that one task opens, bytes in them, about, and bytes of texts that it hands on together.
FILES_PER_TASK, TASK_BYTES, BATCH_BYTES = 256, 32 << 20, 16 << 20
#: Storage that tasks open by themselves; files elsewhere are read by Spark's own reader.
OPENED_BY_TASKS = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
NO_TEXT = "could not open: no readable text"


def file_name(path: Column) -> Column:
    """Last part of a path: the default identity of a document."""
    return F.element_at(F.split(path, "/"), -1)


def _escaped(path: str) -> str:
    """A path taken literally, not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true")


def _listing(spark: SparkSession, folder: str, suffix: str, pattern: bool = False) -> DataFrame:
    reader = _reader(spark)
    top = folder.rstrip("/")
    try:
        return reader.load(f"{top if pattern else _escaped(top)}/*{_escaped(suffix)}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    # Nothing matched. A folder without documents is fine, no folder is not.
    try:
        found = reader.option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise GuardError(f"folder does not exist: {folder}") from exc
        raise
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    files = found.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}"):
        raise GuardError(f"not a folder: {folder}")
    return found.where(F.lit(False))


def scan_documents(
    spark: SparkSession, folder: str, suffix: str = ".pdf", ordered: bool = True, pattern: bool = False
) -> DataFrame:
    """Files of one folder as (doc_key, path, length, modified), by name.

    With ``pattern`` the folder may hold wildcards and stand for several.

    Only the top level counts and the suffix is case sensitive. The content is
    never read. An order that a later join or aggregation does not need is
    dropped by the optimizer. Spark leaves out files of zero bytes and names
    that start with ``_`` or ``.``.
    """
    listing = _listing(spark, folder, suffix, pattern).select(
        file_name(F.col("path")).alias("doc_key"),
        "path",
        "length",
        F.col("modificationTime").alias("modified"),
    )
    return listing.orderBy("doc_key") if ordered else listing


def read_documents(
    spark: SparkSession,
    folder: str,
    suffix: str = ".txt",
    only: DataFrame | None = None,
) -> DataFrame:
    """The files of a folder with their text: (doc_key, path, length, modified, text, reason).

    A file that is not UTF-8 text, or holds more than one Spark value can, gets
    a null text and a reason. The size test reaches the reader, so a file that
    cannot be held is not opened.

    ``only`` holds the rows of :func:`scan_documents` that are wanted. Tasks open
    these files and no others (``read_listed``); their names never meet on the
    driver. On storage that tasks cannot open, Spark's reader is handed the
    list of paths instead.
    """
    if only is not None and urlsplit(folder).scheme in OPENED_BY_TASKS:
        return read_listed(only)
    listing = _listing(spark, folder, suffix)
    if only is not None:
        listing = _wanted(spark, listing, [r.path for r in only.select("path").collect()])
    meta = (
        file_name(F.col("path")).alias("doc_key"),
        F.col("path"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
    )
    readable = listing.where(F.col("length") <= MAX_VALUE_BYTES).select(
        *meta, decode_text(F.col("content")).alias("text")
    )
    too_large = listing.where(F.col("length") > MAX_VALUE_BYTES).select(
        *meta,
        F.lit(None).cast("string").alias("text"),
        F.lit(f"could not open: more than the {MAX_VALUE_BYTES} bytes of one value").alias("reason"),
    )
    return load_text(readable).unionByName(too_large)


def read_listed(listing: DataFrame, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """Rows of a listing (doc_key, path, length, modified) with the files' text and reason, as from :func:`read_documents`.

    The names are dealt over tasks, each of which opens its own ``files_per_task``
    files, about, or ``TASK_BYTES`` in fewer, one after the other. A file that is
    gone gives no row, one that cannot be read a reason. Texts are handed on as they come, in batches
    of bounded size; a longer one stands alone.
    """
    named = listing.select("doc_key", "path", "length", "modified")
    files, size = named.agg(F.count("*"), F.sum("length")).first()
    tasks = max(1, -(-files // files_per_task), min(files, -(-(size or 0) // TASK_BYTES)))
    schema = T.StructType([*named.schema, T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[tuple[str, str], pafs.FileSystem] = {}
        for batch in batches:
            rows, texts, reasons, held = [], [], [], 0
            for i, (path, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                try:
                    text, reason = _text_at(path, length, opened)
                except FileNotFoundError:
                    continue
                rows.append(i)
                texts.append(text)
                reasons.append(reason)
                held += len(text or "")
                if held > BATCH_BYTES:
                    yield _with_texts(batch, rows, texts, reasons)
                    rows, texts, reasons, held = [], [], [], 0
            if rows:
                yield _with_texts(batch, rows, texts, reasons)

    return named.repartition(tasks).mapInArrow(fetch, schema)


def _with_texts(batch: pa.RecordBatch, rows: list[int], texts: list[str | None], reasons: list[str | None]) -> pa.RecordBatch:
    picked = batch.take(pa.array(rows, pa.int64()))
    columns = [*picked.columns, pa.array(texts, pa.string()), pa.array(reasons, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "text", "reason"])


def _text_at(path: str, length: int | None, opened: dict) -> tuple[str | None, str | None]:
    """Text and reason of one file; ``opened`` keeps the connections of a task."""
    if length is not None and length > MAX_VALUE_BYTES:
        return None, f"could not open: more than the {MAX_VALUE_BYTES} bytes of one value"
    fs, at = _place(path, opened)
    try:
        with fs.open_input_stream(at) as stream:
            return stream.read().decode("utf-8"), None
    except UnicodeDecodeError:
        return None, NO_TEXT
    except FileNotFoundError:
        raise
    except OSError as exc:
        return None, f"could not open: {type(exc).__name__}"


def _place(path: str, opened: dict) -> tuple[pafs.FileSystem, str]:
    """File system and path for an address as Spark lists it, in which nothing is quoted."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "", path
    kind = OPENED_BY_TASKS[scheme]
    host, at = "", rest
    if rest.startswith("//"):
        host, slash, at = rest[2:].partition("/")
        at = slash + at
    if kind == "file":
        return opened.setdefault((kind, ""), pafs.LocalFileSystem()), at
    if (kind, host) not in opened:
        opened[kind, host] = pafs.FileSystem.from_uri(f"{kind}://{host}{quote(at)}")[0]
    return opened[kind, host], at if kind == "hdfs" else f"{host}{at}"


def _wanted(spark: SparkSession, listing: DataFrame, paths: list[str]) -> DataFrame:
    try:
        return _reader(spark).load([_escaped(p) for p in paths]) if paths else listing.where(F.lit(False))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    # Some are gone since they were named: take those of the newer listing.
    there = {r.path for r in listing.select("path").collect()}
    return _wanted(spark, listing, [p for p in paths if p in there])


def load_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``reason``: a document without a text is a failure, not an exception."""
    return docs.withColumn("reason", F.when(F.col(text).isNull(), NO_TEXT))


def decode_text(content: Column) -> Column:
    """Bytes to text, null when they are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def read_header(spark: SparkSession, path: str, fmt: str = "csv") -> list[str]:
    """Column names a template expects; an empty cell is an empty name.

    For ``csv`` the raw first row, so repeated and empty names are seen as they
    are. For other formats the names of the schema. Only the header is read.
    """
    try:
        if fmt != "csv":
            return spark.read.format(fmt).load(path).schema.names
        rows = spark.read.option("header", "false").option("multiLine", "true").option("escape", '"').csv(path).head(1)
    except AnalysisException as exc:
        raise GuardError(f"could not open template {path}: {exc.getCondition()}") from exc
    if not rows:
        raise GuardError(f"template has no header row: {path}")
    return ["" if cell is None else cell for cell in rows[0]]
