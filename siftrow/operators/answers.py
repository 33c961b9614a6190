"""From responses to rows: strict parse, merge, all-or-nothing, flatten.

Answers come in two shapes. As rows, one per batch, they are merged by an aggregation. Nested, as an array in the row of
their document (``extract_documents``), parse, merge, all-or-nothing and first failure are projections, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrow.functions import sql
from siftrow.functions.text import CONTROL_CHARS, NOT_AVAILABLE
from siftrow.operators.catalog import DEFAULT_CATALOG, SYNTHESIS, Batch, Catalog, Entry

_OBJECTS = "array<map<string,variant>>"


def _objects(response: Column) -> Column:
    """The response read as the only content of a JSON array; null if it is not JSON.

    Inside an array the JSON reader also sees what follows the first object.
    """
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), response, F.lit("]"))), "$", _OBJECTS)


def _single(objects: Column, response: Column) -> Column:
    """The one object, as a map of variants; null unless there is exactly one.

    Text that closes the array itself could still hide behind the object, so
    where that is possible the response is read once more, inside an object.
    """
    enclosed = F.try_parse_json(F.concat(F.lit('{"r":'), response, F.lit("}"))).isNotNull()
    alone = F.when(response.rlike(r"\}\s*\]"), enclosed).otherwise(F.lit(True))
    return F.when((F.size(objects) == 1) & alone, F.try_element_at(objects, F.lit(1)))


def _not_text(fields: Column) -> Column:
    return F.map_filter(fields, lambda _, v: F.schema_of_variant(v) != "STRING")


def _problem(batch: Column | None, error: Column, fields: Column, unknown: Column, not_text: Column) -> Column:
    """Why a response is no answer; null if it is one. ``unknown`` is null for a batch that the catalog does not know."""
    strange = F.lit("unknown batch") if batch is None else F.concat(F.lit("unknown batch: "), F.coalesce(batch, F.lit("none")))
    return (
        F.when(error.isNotNull(), error)
        .when(fields.isNull(), "no parsed object: the response is not one JSON object")
        .when(unknown.isNull(), strange)
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))
        .when(
            F.size(not_text) > 0,
            F.concat(F.lit("values that are not text: "), F.array_join(F.array_sort(F.map_keys(not_text)), ", ")),
        )
    )


def _texts(fields: Column) -> Column:
    return F.transform_values(fields, lambda _, v: F.try_variant_get(v, "$", "string"))


def parse_strict(
    responses: DataFrame, catalog: Catalog = DEFAULT_CATALOG, *, allowed: Column | None = None
) -> DataFrame:
    """Add ``answer map<string,string>`` and fold parse problems into ``error``.

    A response fits when it is one JSON object, holds no field its batch does
    not know and only text values. A missing field is left out of the map and
    becomes ``NA`` on merge. A batch that the catalog does not know, or none, is
    an error. ``allowed`` overrides the fields per row.
    """
    known = catalog.allowed_fields(F.col("batch")) if allowed is None else allowed
    batch = F.col("batch").cast("string") if "batch" in responses.columns else None
    # One projection per step, so that no step is evaluated twice.
    parsed = (
        responses.withColumn("_objects", _objects(F.col("response")))
        .withColumn("_m", _single(F.col("_objects"), F.col("response")))
        .withColumn("_unknown", F.array_sort(F.array_except(F.map_keys("_m"), known)))
        .drop("_objects")
    )
    problem = _problem(batch, F.col("error"), F.col("_m"), F.col("_unknown"), _not_text(F.col("_m")))
    return (
        parsed.withColumn("error", problem)
        .withColumn("answer", F.when(F.col("error").isNull(), _texts(F.col("_m"))))
        .drop("_m", "_unknown")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: One answer of a document, parsed. ``asked`` tells what was asked for; see ``batch_fingerprints``.
ANSWER_TYPE = (
    "struct<batch:string,batch_ordinal:int,asked:string,response:string,error:string,attempts:int,"
    "answer:map<string,string>>"
)


def parse_answers(answers: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """An array of answers of one document, each read as by :func:`parse_strict`: ``array<ANSWER_TYPE>``."""

    def read(a: Column) -> Column:
        def judged(m: Column) -> Column:
            unknown = F.array_sort(F.array_except(F.map_keys(m), catalog.allowed_fields(a["batch"])))

            def finish(error: Column) -> Column:
                return F.struct(
                    a["batch"].alias("batch"),
                    a["batch_ordinal"].alias("batch_ordinal"),
                    a["asked"].alias("asked"),
                    a["response"].alias("response"),
                    error.alias("error"),
                    a["attempts"].alias("attempts"),
                    F.when(error.isNull(), _texts(m)).alias("answer"),
                )

            return _let(_problem(a["batch"], a["error"], m, unknown, _not_text(m)), finish)

        return _let(_objects(a["response"]), lambda o: _let(_single(o, a["response"]), judged))

    return F.transform(answers, read)


def whole_answers(answers: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """True when every batch of the catalog is answered and none failed."""
    good = F.transform(F.filter(answers, lambda a: a["error"].isNull()), lambda a: a["batch"])
    names = F.array(*(F.lit(b.name) for b in catalog.batches))
    return F.coalesce(F.size(F.array_except(names, good)) == 0, F.lit(False)) & ~F.exists(answers, lambda a: a["error"].isNotNull())


def first_problem(answers: Column) -> Column:
    """The error of the failed answer that comes first by ordinal; null if none failed."""
    failed = F.filter(answers, lambda a: a["error"].isNotNull())
    return F.array_min(F.transform(failed, lambda a: F.struct(F.coalesce(a["batch_ordinal"], F.lit(0)).alias("order"), a["error"].alias("error"))))["error"]


def cells_of(answers: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """All fields of a document's good answers as one map; of several answers to a batch, the first."""
    names = F.array(*(F.lit(b.name) for b in catalog.batches))
    each = F.transform(names, lambda n: F.get(F.filter(answers, lambda a: (a["batch"] == n) & a["error"].isNull()), F.lit(0))["answer"])
    entries = F.transform(F.filter(each, lambda m: m.isNotNull()), lambda m: F.map_entries(m))
    return F.map_from_entries(F.flatten(entries))


def merge_answers(documents: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """Nested answers (key, answers) to (key, structured, synthesis), whole documents only; nothing moves."""
    merged = documents.where(whole_answers(F.col("answers"), catalog)).select(key, cells_of(F.col("answers"), catalog).alias("_cells"))

    def part(synthesis: bool) -> str:
        fields = (f for b in catalog.part(synthesis) for f in b.fields)
        na = sql.text(NOT_AVAILABLE)
        return "struct({})".format(sql.listing(f"coalesce(try_element_at(_cells, {sql.text(f)}), {na}) AS {sql.name(f)}" for f in fields))

    columns = [F.expr(f"{part(False)} AS structured")]
    if catalog.part(synthesis=True):
        columns.append(F.expr(f"{part(True)} AS synthesis"))
    return merged.select(key, *columns)


def merge_batches(answers: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """Long answers (key, batch, field, value) to one wide row per document.

    The fields are listed, so no job is needed to find them and a field nobody
    answered is still a column. ``max`` combines before the shuffle, so each
    task sends one row per document.
    """
    na = sql.text(NOT_AVAILABLE)
    return answers.groupBy(key).agg(
        *(
            F.expr(f"coalesce(max(CASE WHEN field = {sql.text(e.field)} THEN value END), {na}) AS {sql.name(e.field)}")
            for e in catalog.entries
        )
    )


def merge_responses(parsed: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """Parsed responses to (key, structured, synthesis), whole documents only.

    One aggregation does the merge and the all-or-nothing test: it needs 11 rows
    per document instead of 39, and only documents whose every batch is free of
    errors come out. ``parsed`` is the result of :func:`parse_strict`.
    """

    def record(batch: Batch) -> Column:
        cells = sql.listing(
            f"coalesce(try_element_at(answer, {sql.text(f)}), {sql.text(NOT_AVAILABLE)}) AS {sql.name(f)}"
            for f in batch.fields
        )
        answered = f"batch = {sql.text(batch.name)} AND error IS NULL"
        return F.expr(f"max(CASE WHEN {answered} THEN struct({cells}) END) AS b{batch.ordinal}")

    merged = (
        parsed.groupBy(key).agg(*map(record, catalog.batches), whole_document(catalog).alias("ok")).where("ok")
    )

    def part(batches: tuple[Batch, ...]) -> str:
        return "struct({})".format(sql.listing(f"b{b.ordinal}.{sql.name(f)}" for b in batches for f in b.fields))

    columns = [F.expr(f"{part(catalog.part(synthesis=False))} AS structured")]
    if catalog.part(synthesis=True):
        columns.append(F.expr(f"{part(catalog.part(synthesis=True))} AS synthesis"))
    return merged.select(key, *columns)


def whole_document(catalog: Catalog) -> Column:
    """Aggregate: every batch of the catalog answered, none failed.

    Only names of the catalog's batches are gathered, so the set stays small.
    """
    names = [b.name for b in catalog.batches]
    good = F.collect_set(F.when(F.col("error").isNull() & F.col("batch").isin(names), F.col("batch")))
    return (F.size(good) == len(names)) & (F.count_if(F.col("error").isNotNull()) == 0)


def all_or_nothing(responses: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """(key, complete, failed_batches): complete only if every batch worked."""
    return responses.groupBy(key).agg(
        whole_document(catalog).alias("complete"), F.count_if(F.col("error").isNotNull()).alias("failed_batches")
    )


def join_synthesis(structured: DataFrame, synthesis: DataFrame, key: str = "doc_key") -> DataFrame:
    """Both passes of a document as (key, structured, synthesis); both are needed."""
    return structured.join(synthesis, key, "inner")


def nest(wide: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """Wide record to (key, structured, synthesis)."""

    def part(synthesis: bool) -> Column:
        return F.struct(*(F.col(f) for b in catalog.part(synthesis) for f in b.fields))

    columns = [part(False).alias("structured")]
    if catalog.part(synthesis=True):
        columns.append(part(True).alias("synthesis"))
    return wide.select(key, *columns)


def flatten_row(
    extraction: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key", clean: bool = True, cap: int | None = None
) -> DataFrame:
    """Nested extraction to output columns in catalog order.

    ``clean`` drops control characters; ``cap`` cuts cells to so many
    characters, for a sink that needs it.
    """

    def cell(entry: Entry) -> Column:
        part = "synthesis" if entry.batch == SYNTHESIS else "structured"
        value = f"coalesce({part}.{sql.name(entry.field)}, {sql.text(NOT_AVAILABLE)})"
        if clean:
            value = f"regexp_replace({value}, {sql.text(CONTROL_CHARS)}, '')"
        if cap is not None:
            value = f"left({value}, {int(cap)})"
        return F.expr(f"{value} AS {sql.name(entry.column)}")

    return extraction.select(key, *map(cell, catalog.entries))
