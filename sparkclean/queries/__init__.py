"""Registered queries: every operator on the given tables, with a SQL oracle beside it."""

from sparkclean.queries import bounds, clean, events, flow, guards, profiling, quality  # noqa: F401
from sparkclean.queries.registry import QUERIES

__all__ = ["QUERIES"]
