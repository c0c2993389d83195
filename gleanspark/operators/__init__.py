"""Operators: retrieval over whole sets of queries, documents and their chunks."""

from . import documents, retrieval

__all__ = ["documents", "retrieval"]
