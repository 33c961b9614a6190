"""Quoting for expressions written as SQL text.

Wide expressions, such as one branch per catalog field, are handed to Spark as
one piece of SQL instead of hundreds of single column calls.
"""

from __future__ import annotations


def text(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def name(column: str) -> str:
    """A column name taken literally."""
    return "`" + column.replace("`", "``") + "`"


def listing(parts) -> str:
    return ", ".join(parts)
