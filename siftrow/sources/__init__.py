"""Readers and writers: documents, headers, results, the ledger."""
