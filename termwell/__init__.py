"""Retrieval, curation and query-log analytics as PySpark DataFrame operators."""
