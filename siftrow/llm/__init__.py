"""Operators for training data: deduplication, fingerprints, tokens, models, extraction, mixing and packing.

Nothing else in the library imports this subpackage.
"""
