"""Text expressions over a string column.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen and can be pushed next to the scan. Lengths are counted in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrow.errors import GuardError

# Formats and limits that results depend on.
PAGE_BREAK = "\f"
NOT_AVAILABLE = "NA"
UNCERTAIN = "UNCERTAIN"
MULTIPLE = "MULTIPLE"
VALUE_SEPARATOR = " | "
TRUNCATION_MARKER = "\n\n[... middle of article truncated ...]\n\n"
MAX_TEXT_CHARS = 200_000
MAX_CELL_CHARS = 32_767
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# White space in the Unicode sense plus the four separator control characters,
# which Java's Unicode class leaves out.
_BLANK = r"(?U)\A[\s\x1c-\x1f]*\z"


def page_array(text: Column) -> Column:
    """Pages of a text as an array; trailing empty pages are kept."""
    return F.split(text, PAGE_BREAK, -1)


def page_count(text: Column) -> Column:
    """Number of pages: page breaks plus one, and 0 for an empty text."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit(PAGE_BREAK), F.lit("")))
    return F.when(F.length(text) > 0, breaks + 1).otherwise(F.lit(0))


def is_blank(text: Column) -> Column:
    """True when a text holds nothing but white space (any script)."""
    return text.rlike(_BLANK)


def truncate_middle(text: Column, limit: int = MAX_TEXT_CHARS) -> Column:
    """Keep the two ends of a text longer than ``limit`` and mark the cut."""
    if limit < 2:
        raise GuardError(f"the text limit must be at least 2, not {limit}")
    half = limit // 2
    shortened = F.concat(
        F.substring(text, 1, half), F.lit(TRUNCATION_MARKER), F.substring(text, -half, half)
    )
    return F.when(F.length(text) <= limit, text).otherwise(shortened)


def sanitize_cell(value: Column) -> Column:
    """Drop control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(value, CONTROL_CHARS, "")


def cap_cell(value: Column, size: int = MAX_CELL_CHARS) -> Column:
    """Keep the first ``size`` characters, the most one output cell may hold."""
    return F.substring(value, 1, size)


def clean_cell(value: Column) -> Column:
    """Sanitise first, cap second."""
    return cap_cell(sanitize_cell(value))


def fill_na(value: Column) -> Column:
    """A missing value becomes the ``NA`` label."""
    return F.coalesce(value, F.lit(NOT_AVAILABLE))


def value_array(value: Column) -> Column:
    """Parts of a multi-value cell; a bare pipe without spaces does not split."""
    return F.split(value, r" \| ", -1)
