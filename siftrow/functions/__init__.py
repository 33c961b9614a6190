"""Column expressions: text in, text (or a flag, or a number) out."""

from siftrow.functions.text import (
    cap_cell,
    clean_cell,
    fill_na,
    is_blank,
    page_array,
    page_count,
    sanitize_cell,
    truncate_middle,
    value_array,
)

__all__ = [
    "cap_cell",
    "clean_cell",
    "fill_na",
    "is_blank",
    "page_array",
    "page_count",
    "sanitize_cell",
    "truncate_middle",
    "value_array",
]
