"""Does the output keep its contract? Checks over a wide table of fields.

Every check takes a table with a key and one column per field (see
``by_field`` for a results table) and returns (key, field, value, ok). A check
reads only the columns it is about, and none of them shuffles; only the profile
and the grounding join do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrow.functions import sql
from siftrow.functions.text import MULTIPLE, NOT_AVAILABLE, UNCERTAIN, is_blank, value_array
from siftrow.operators.catalog import DEFAULT_CATALOG, Catalog

# The closed vocabularies of the two classification fields.
ARTICLE_TYPES = (
    "Field Study",
    "Simulation Study",
    "Review",
    "Mixed (Field + Simulation)",
    "Method / Model Paper",
    "Machine Learning / Predictive Study",
    "Case Study",
    "Other (specify)",
)
FOCUS_TOPICS = (
    "Thermal Comfort",
    "Outdoor Air Quality",
    "Visual Comfort",
    "Acoustic Comfort",
    "Multi-Sensory Comfort",
    "Calibration / Assessment Tools",
    "Other (specify)",
)
# Limits and formats the contract states.
MAX_AUTHORS = 6
AND_OTHERS = "et al."
MAX_BRIEF_WORDS = 40
METHODOLOGY_SENTENCES = (2, 5)
IDENTIFIER_PREFIX = "https://doi.org/"
ASSUMED = "(assumed)"
SECTION_SEPARATOR = " — "

LABELS = (NOT_AVAILABLE, UNCERTAIN, MULTIPLE)
PARTICIPANT_FIELDS = tuple(e.field for e in DEFAULT_CATALOG.entries if e.batch == "participants")
SURVEY_FIELDS = tuple(e.field for e in DEFAULT_CATALOG.entries if e.batch == "subjective_comfort")
REVIEW_FIELDS = tuple(e.field for e in DEFAULT_CATALOG.entries if e.batch == "review")

_SENTENCE_END = r"[.!?](\s|$)"


def by_field(results: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """A results table with its columns renamed to field names."""
    return results.select(key, *(F.col(f"`{e.column}`").alias(e.field) for e in catalog.entries))


def is_label(value: Column) -> Column:
    return value.isin(*LABELS)


def label_class(value: Column) -> Column:
    """``NA``, ``UNCERTAIN``, ``MULTIPLE``, ``blank`` or ``value``."""
    return (
        F.when(value.isNull() | is_blank(value), "blank")
        .when(is_label(value), value)
        .otherwise("value")
    )


def _verdict(table: DataFrame, field: str, ok: Column, key: str) -> DataFrame:
    value = F.col(field)
    return table.select(
        key,
        F.lit(field).alias("field"),
        value.alias("value"),
        F.coalesce(is_label(value) | ok, F.lit(False)).alias("ok"),
    )


def check_labels(table: DataFrame, catalog: Catalog = DEFAULT_CATALOG, key: str = "doc_key") -> DataFrame:
    """One row per cell; a blank cell is not ok."""
    return _cells(table, catalog, key).select("*", (label_class(F.col("value")) != "blank").alias("ok"))


def _cells(table: DataFrame, catalog: Catalog, *keep: str) -> DataFrame:
    """One row per cell: the kept columns, field and value."""
    cells = sql.listing(
        f"struct({sql.text(e.field)} AS field, {sql.name(e.field)} AS value)" for e in catalog.entries
    )
    return table.select(*keep, F.expr(f"inline(array({cells}))"))


def label_profile(table: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """(field, class, n, share): how often each field is filled, labelled or blank.

    Counts combine before the shuffle, so each task sends at most five rows per
    field.
    """
    classes = _cells(table, catalog).select("field", label_class(F.col("value")).alias("class"))
    counted = classes.groupBy("field", "class").agg(F.count("*").alias("n"))
    totals = counted.groupBy("field").agg(F.sum("n").alias("all_rows"))
    return counted.join(totals, "field").select("field", "class", "n", (F.col("n") / F.col("all_rows")).alias("share"))


def explode_multi(table: DataFrame, field: str, key: str = "doc_key") -> DataFrame:
    """Multi-value cell to one row per part: (key, position from 0, part)."""
    return table.select(key, F.posexplode(value_array(F.col(field))).alias("position", "part"))


def check_year(table: DataFrame, field: str = "year", key: str = "doc_key") -> DataFrame:
    """Four digits."""
    return _verdict(table, field, F.col(field).rlike("^[0-9]{4}$"), key)


def check_identifier(table: DataFrame, field: str = "doi", key: str = "doc_key") -> DataFrame:
    """A DOI carries its link prefix; an ISBN or another identifier may stand as it is."""
    is_doi = F.col(field).rlike(r"10\.[0-9]{4,}/")
    return _verdict(table, field, ~is_doi | F.col(field).startswith(IDENTIFIER_PREFIX), key)


def check_authors(table: DataFrame, field: str = "authors", key: str = "doc_key") -> DataFrame:
    """One to six names; ``et al.`` is not a name, alone or at the end of the last one. A blank cell is not ok."""
    names = F.filter(value_array(F.col(field)), lambda n: F.trim(n) != AND_OTHERS)
    return _verdict(table, field, (F.size(names) <= MAX_AUTHORS) & ~is_blank(F.col(field)), key)


def check_vocabulary(
    table: DataFrame, field: str, vocabulary: tuple[str, ...], key: str = "doc_key"
) -> DataFrame:
    """Every part of the cell is in the closed list, or is ``Other (...)``."""
    known = F.array(*map(F.lit, vocabulary))
    fits = F.forall(
        value_array(F.col(field)), lambda p: F.array_contains(known, p) | p.rlike(r"^Other \(.*\)$")
    )
    return _verdict(table, field, fits, key)


def check_brief(table: DataFrame, field: str = "gmr_brief", key: str = "doc_key") -> DataFrame:
    """One sentence of at most 40 words. A blank cell is not ok."""
    words = F.size(F.split(F.trim(F.col(field)), r"\s+"))
    fits = (words <= MAX_BRIEF_WORDS) & (_sentences(field) <= 1) & ~is_blank(F.col(field))
    return _verdict(table, field, fits, key)


def check_methodology(table: DataFrame, field: str = "methodology", key: str = "doc_key") -> DataFrame:
    """Two to five sentences. A warning only: abbreviations look like sentence ends."""
    least, most = METHODOLOGY_SENTENCES
    return _verdict(table, field, _sentences(field).between(least, most), key)


def _sentences(field: str) -> Column:
    return F.size(F.regexp_extract_all(F.col(field), F.lit(_SENTENCE_END), F.lit(0)))


def check_study_type(
    table: DataFrame, classification: str = "article_classification", key: str = "doc_key"
) -> DataFrame:
    """Fields that must be empty for the kind of study, one row per such field.

    No review: the review fields are ``NA``. Simulation only: participant
    fields are ``NA`` or marked as assumed. No survey, that is neither an
    extent nor questions: the survey time is ``NA``. An article whose type is
    only a label is not judged by type.
    """
    kinds, typed = value_array(F.col(classification)), ~is_label(F.col(classification))
    not_review = typed & ~F.array_contains(kinds, "Review")
    simulated = typed & (F.col(classification) == "Simulation Study")
    extent, when_asked, questions = SURVEY_FIELDS
    no_survey = (F.col(extent) == NOT_AVAILABLE) & (F.col(questions) == NOT_AVAILABLE)

    def cell(field: str, applies: Column, allowed: Column) -> Column:
        return F.struct(
            F.lit(field).alias("field"), F.col(field).alias("value"), F.coalesce(~applies | allowed, F.lit(False)).alias("ok")
        )

    def empty(field: str) -> Column:
        return F.col(field) == NOT_AVAILABLE

    cells = [cell(f, not_review, empty(f)) for f in REVIEW_FIELDS]
    cells += [cell(f, simulated, empty(f) | F.contains(F.col(f), F.lit(ASSUMED))) for f in PARTICIPANT_FIELDS]
    cells.append(cell(when_asked, no_survey, empty(when_asked)))
    return table.select(key, F.inline(F.array(*cells)))


def labelled_sections(table: DataFrame, field: str = "modeling_simulation", key: str = "doc_key") -> DataFrame:
    """Sections of a ``LABEL: body — LABEL: body`` cell: (key, position, label, body, ok).

    Rows, not a map: a repeated label is kept as it is. A section without a
    label has a null label and is not ok. A cell that is only a label such as
    ``NA`` has no sections.
    """
    sections = table.where(~is_label(F.col(field))).select(
        key, F.posexplode(F.split(F.col(field), SECTION_SEPARATOR, -1)).alias("position", "section")
    )
    # The label runs to the first colon, which a blank must follow.
    label = F.substring_index("section", ":", 1)
    size = F.length(label)
    ok = (size > 0) & (F.col("section").substr(size + 1, F.lit(2)) == ": ")
    return sections.select(
        key,
        "position",
        F.when(ok, label).alias("label"),
        F.when(ok, F.col("section").substr(size + 3, F.length("section"))).otherwise(F.col("section")).alias("body"),
        ok.alias("ok"),
    )


def check_grounding(
    table: DataFrame, docs: DataFrame, fields: tuple[str, ...], text: str = "text", key: str = "doc_key"
) -> DataFrame:
    """Which values of a cell occur in the document's whole text: (key, field, position, value, ok).

    A cell of several values gives a row for each, by position from 0. A label
    is ok as it is; a blank value, a null cell (one row with a null value) and a
    value without a document are not. The wide row meets its document once,
    before the cells are taken apart, so a text moves once and is not repeated
    per value: what follows the join is a projection.
    """
    joined = table.select(key, *fields).join(docs.select(key, F.col(text).alias("_text")), key, "left")

    def values(field: str) -> Column:
        # A cell that is a label is one value; a null cell is one null value.
        parts = F.coalesce(value_array(F.col(field)), F.array(F.lit(None).cast("string")))

        def one(value: Column, position: Column) -> Column:
            ok = is_label(F.col(field)) | (F.contains(F.col("_text"), value) & ~is_blank(value))
            return F.struct(
                F.lit(field).alias("field"), position.alias("position"), value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok")
            )

        return F.transform(parts, one)

    return joined.select(key, F.flatten(F.array(*map(values, fields))).alias("values")).select(key, F.inline("values"))


def grounding_share(checked: DataFrame) -> DataFrame:
    """(field, stated, grounded, share) over real values."""
    return (
        checked.where(~is_label(F.col("value")))
        .groupBy("field")
        .agg(F.count("*").alias("stated"), F.count_if("ok").alias("grounded"))
        .select("*", (F.col("grounded") / F.col("stated")).alias("share"))
    )
