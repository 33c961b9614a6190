"""The column catalog: which columns a run produces and which batch fills each.

The catalog is schema, not data: its rows become columns of the output, so it
is held on the driver like any other schema. ``Catalog.of`` refuses a table
with more rows than an output table could have columns.

The integrity and header checks below are ordinary DataFrame operators; they
work for one header or for millions of headers keyed by file.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrow.errors import GuardError
from siftrow.functions import sql

MAX_CATALOG_ROWS = 2_000
SYNTHESIS = "synthesis"

CATALOG_SCHEMA = (
    "ordinal int, column string, field string, batch string, batch_ordinal int, instruction string"
)

# Output column, field name and batch of the default catalog, in
# output order. The last item is our own short instruction for the field.
_DEFAULT_ENTRIES = (
    ("Article Classification", "article_classification", "classification",
     "the one study type that fits best"),
    ("Main Focus", "main_focus", "classification", "every comfort topic the article is about"),
    ("Title", "title", "bibliographic", "the whole published title"),
    ("Authors", "authors", "bibliographic", "up to six authors as Last, First, then et al."),
    ("Year", "year", "bibliographic", "publication year in four digits"),
    ("Journal", "journal", "bibliographic", "journal or conference, unabbreviated"),
    ("DOI / Unique Identifier", "doi", "bibliographic", "DOI as a https://doi.org/ link, else ISBN"),
    ("Country", "country", "study_context", "where the study took place"),
    ("City", "city", "study_context", "cities of the study sites"),
    ("Climate", "climate", "study_context", "climate as the article words it"),
    ("Season(s)", "seasons", "study_context", "seasons or months covered"),
    ("Urban Space Types", "urban_space_types", "study_context", "kinds of outdoor space"),
    ("Age", "age", "participants", "age range, mean or group"),
    ("Gender", "gender", "participants", "share of genders"),
    ("Ethnicity / Nationality / Participant Group", "ethnicity", "participants",
     "who the participants were"),
    ("Clothing Level or Description", "clothing_level", "participants", "clothing with clo values"),
    ("Activity During Exposure", "activity_during_exposure", "participants",
     "what people did while measured"),
    ("Activity up to 24 Hours Before Exposure", "activity_before_exposure", "participants",
     "what people did in the day before, if said"),
    ("Environmental Variables Measured: Quantitative", "variables_quantitative", "measurements",
     "measured quantities with units"),
    ("Environmental Variables Measured: Qualitative", "variables_qualitative", "measurements",
     "votes and scales"),
    ("Questionnaire Extent", "questionnaire_extent", "subjective_comfort",
     "forms handed out, valid and rate"),
    ("Survey Time", "survey_time", "subjective_comfort", "hours and period of the survey"),
    ("Questionnaire Questions", "questionnaire_questions", "subjective_comfort", "what was asked"),
    ("Calculated Indexes", "calculated_indexes", "indexes", "each named index with thresholds"),
    ("Urban Cooling Strategies", "urban_cooling", "strategies", "city-scale measures against heat"),
    ("Personal Cooling Strategies", "personal_cooling", "strategies", "personal measures against heat"),
    ("Urban Heating Strategies", "urban_heating", "strategies", "city-scale measures against cold"),
    ("Personal Heating Strategies", "personal_heating", "strategies",
     "personal measures against cold"),
    ("Modeling / Simulation", "modeling_simulation", "modeling",
     "labelled parts: software, purpose, inputs, outputs, validation, statistics"),
    ("Review Scope", "review_scope", "review", "topic, region and years of a review"),
    ("Number of Studies Reviewed", "number_of_studies_reviewed", "review", "count of papers"),
    ("Themes / Categories", "themes_categories", "review", "groups the review uses"),
    ("Methods Compared", "methods_compared", "review", "methods set side by side"),
    ("Gaps Identified", "gaps_identified", "review", "open questions the review names"),
    ("Conclusions", "conclusions", "review", "what the review concludes"),
    ("Key Research Questions", "research_questions", "synthesis", "questions asked or implied"),
    ("Key Goals", "key_goals", "synthesis", "aims in the article's words"),
    ("Methodology", "methodology", "synthesis", "design and analysis in two to five sentences"),
    ("GMR Brief", "gmr_brief", "synthesis", "goal, method and result in one sentence of 40 words"),
)


@dataclass(frozen=True)
class Entry:
    """One output column."""

    column: str
    field: str
    batch: str
    instruction: str = ""


@dataclass(frozen=True)
class Batch:
    """One extraction call: a topic, its place in the order and its fields."""

    name: str
    ordinal: int
    fields: tuple[str, ...]
    instruction: str


@dataclass(frozen=True)
class Catalog:
    """Output columns in order. Batches keep the order of first appearance."""

    entries: tuple[Entry, ...]

    def __post_init__(self) -> None:
        for kind in ("column", "field"):
            names = [getattr(e, kind) for e in self.entries]
            twice = sorted({n for n in names if names.count(n) > 1})
            if twice:
                raise GuardError(f"catalog names a {kind} more than once: {twice}")

    @classmethod
    def of(cls, table: DataFrame) -> Catalog:
        """Catalog from a table with the columns of ``CATALOG_SCHEMA``."""
        rows = table.orderBy("ordinal").limit(MAX_CATALOG_ROWS + 1).collect()
        if len(rows) > MAX_CATALOG_ROWS:
            raise GuardError(f"a catalog may have at most {MAX_CATALOG_ROWS} rows")
        return cls(tuple(Entry(r.column, r.field, r.batch, r.instruction or "") for r in rows))

    @cached_property
    def columns(self) -> tuple[str, ...]:
        return tuple(e.column for e in self.entries)

    @cached_property
    def batches(self) -> tuple[Batch, ...]:
        grouped: dict[str, list[Entry]] = {}
        for entry in self.entries:
            grouped.setdefault(entry.batch, []).append(entry)
        return tuple(
            Batch(name, i, tuple(e.field for e in members), _batch_instruction(name, members))
            for i, (name, members) in enumerate(grouped.items(), start=1)
        )

    def part(self, synthesis: bool) -> tuple[Batch, ...]:
        """Batches of the structured pass, or of the synthesis pass."""
        return tuple(b for b in self.batches if (b.name == SYNTHESIS) == synthesis)

    def to_df(self, spark: SparkSession) -> DataFrame:
        ordinal_of = {b.name: b.ordinal for b in self.batches}
        rows = [
            (i, e.column, e.field, e.batch, ordinal_of[e.batch], e.instruction)
            for i, e in enumerate(self.entries, start=1)
        ]
        return spark.createDataFrame(rows, CATALOG_SCHEMA)

    def allowed_fields(self, batch: Column) -> Column:
        """Field names a response of this batch may hold, as an array; null for a batch that is not known, or null."""
        known = sql.listing(
            f"{sql.text(b.name)}, array({sql.listing(map(sql.text, b.fields))})" for b in self.batches
        )
        return F.try_element_at(F.expr(f"map({known})"), batch)


def batch_fingerprints(catalog: Catalog, system: str | None = None) -> dict[str, str]:
    """What each batch asks for, as a digest: its instruction, its fields and the system text."""
    return {
        b.name: hashlib.md5(json.dumps([b.instruction, list(b.fields), system]).encode()).hexdigest() for b in catalog.batches
    }


def _batch_instruction(name: str, members: list[Entry]) -> str:
    wanted = "; ".join(f"{e.field}: {e.instruction or e.column}" for e in members)
    return f"Topic {name}. Answer as one JSON object with these text fields: {wanted}."


DEFAULT_CATALOG = Catalog(tuple(Entry(*row) for row in _DEFAULT_ENTRIES))


def catalog_integrity(table: DataFrame) -> DataFrame:
    """One row of counts over any table of (column, field, batch).

    A sound catalog has zero in every ``*_twice``, ``unmapped`` and
    ``shared_fields`` count. Each count is a two-step aggregation (per name,
    then over names), so no single name gathers its rows in one place.
    """

    def per_name(name: str, *aggs: Column) -> DataFrame:
        return table.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), *aggs)

    columns = per_name("column").agg(
        F.count("*").alias("columns"), F.count_if(F.col("n") > 1).alias("columns_twice")
    )
    fields = per_name(
        "field", F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch")
    ).agg(
        F.count("*").alias("fields"),
        F.count_if(F.col("n") > 1).alias("fields_twice"),
        F.count_if(F.col("first_batch") != F.col("last_batch")).alias("shared_fields"),
    )
    rest = per_name("batch", F.count_if(F.col("field").isNull()).alias("gaps")).agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("unmapped")
    )
    counts = columns.unionByName(fields, True).unionByName(rest, True)
    return counts.agg(*(F.max(c).alias(c) for c in counts.columns))


def header_diff(
    headers: DataFrame, expected: tuple[str, ...] | list[str], key: str = "doc_key", files: DataFrame | None = None
) -> DataFrame:
    """Differences between each file's header and the expected column list.

    ``headers`` holds (key, ordinal, name), ordinals from 1; a null name is an
    empty one, and a row without an ordinal stands for a file whose header is
    empty. ``files`` may name all files (key); one without any header row
    lacks every column. The result holds
    (key, kind, ordinal, name): ``missing`` for an expected column the header
    lacks, ``unexpected`` for a name that is not expected, ``moved`` for an
    expected name at another place. No rows for a key means an exact match.

    Only expected names are gathered per key, so a group never grows past the
    catalog, however long the header is.
    """
    names = F.array(*map(F.lit, expected))
    if files is not None:
        none = F.lit(None)
        headers = headers.select(key, "ordinal", "name").unionByName(
            files.select(key, none.cast("int").alias("ordinal"), none.cast("string").alias("name"))
        )
    named = headers.withColumn("name", F.when(F.col("ordinal").isNotNull(), F.coalesce("name", F.lit(""))))
    known = named.withColumn("place", F.array_position(names, F.col("name")))
    off = known.where((F.col("place") == 0) | (F.col("place") != F.col("ordinal"))).select(
        key,
        F.when(F.col("place") == 0, "unexpected").otherwise("moved").alias("kind"),
        F.col("ordinal").cast("int").alias("ordinal"),
        "name",
    )
    found = known.groupBy(key).agg(F.collect_set(F.when(F.col("place") > 0, F.col("name"))).alias("found"))
    missing = found.select(key, F.explode(F.array_except(names, "found")).alias("name")).select(
        key,
        F.lit("missing").alias("kind"),
        F.array_position(names, F.col("name")).cast("int").alias("ordinal"),
        "name",
    )
    return off.unionByName(missing)


def require_header(header: list[str], catalog: Catalog = DEFAULT_CATALOG) -> None:
    """Guard: a header must equal the catalog's columns, in order."""
    expected = list(catalog.columns)
    if header == expected:
        return
    missing = [c for c in expected if c not in header]
    unexpected = [h for h in header if h not in expected]
    raise GuardError(
        "header differs from the catalog: "
        f"missing {missing or 'none'}, unexpected {unexpected or 'none'}"
        + ("" if missing or unexpected else ", order or repetition differs")
    )
