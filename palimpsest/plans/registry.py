"""Imports every query module, so that the registry is complete."""

from palimpsest.plans import (queries_align, queries_comments, queries_functions,  # noqa: F401
                              queries_insight, queries_layout, queries_library, queries_streaming)
from palimpsest.plans.catalog import ORACLE, QUERIES

FLAGSHIP = "revision_changes"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
