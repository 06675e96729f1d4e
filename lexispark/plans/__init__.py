"""The search index: how the operators are put together, saved, loaded and queried."""

from .index import SearchIndex

__all__ = ["SearchIndex"]
