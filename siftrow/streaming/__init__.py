"""Incremental runs over a growing source."""
