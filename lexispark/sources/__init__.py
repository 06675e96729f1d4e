"""Sources of documents: CSV, JSON lines, Parquet, Python collections and DataFrames."""

from .readers import from_documents, read_corpus, with_ordinal

__all__ = ["from_documents", "read_corpus", "with_ordinal"]
