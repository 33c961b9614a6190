"""All queries of the subpackage. Importing the modules registers them."""

from siftrow.llm.queries import documents, joins, models, native, search, token_files, vocabulary
from siftrow.llm.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "documents", "joins", "models", "native", "search", "token_files", "vocabulary"]
