"""Operators of the index build and of ranked retrieval, DataFrame in and DataFrame out."""
