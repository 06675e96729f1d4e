"""Streams of queries against an index."""

from .queries import stream_search

__all__ = ["stream_search"]
