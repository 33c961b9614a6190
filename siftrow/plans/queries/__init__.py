"""Queries over the shared test tables, each with the SQL that must agree with it.

Every query reads whole tables. Where an operator needs failures, blank texts
or odd values, these are derived from the tables' own columns.
"""

from siftrow.plans.queries import checks, extraction, ledger, runs, texts  # noqa: F401 (they register)
from siftrow.plans.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
