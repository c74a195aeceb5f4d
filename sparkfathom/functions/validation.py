"""Checks of queries and names, on the driver and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOP_K, MAX_QUERY_CHARS, MAX_NAME = 50, 8000, 100

_NAME = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def check_query(query: str, top_k: int, tokens: int | None = None, n_ctx: int | None = None) -> None:
    """Raise ValueError for a query that cannot be searched."""
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    if not query.strip():
        raise ValueError("query cannot be empty")
    if len(query) > MAX_QUERY_CHARS:
        raise ValueError(f"query too long: {len(query)} characters (max {MAX_QUERY_CHARS})")
    if tokens is not None and n_ctx is not None and tokens > max(1, int(0.9 * n_ctx)):
        raise ValueError(f"query too long: {tokens} tokens for a window of {n_ctx}")


def check_collection_name(name: str) -> str:
    """The trimmed name, or ValueError."""
    name = name.strip()
    if not re.match(_NAME, name) or len(name) > MAX_NAME:
        raise ValueError(f"invalid collection name {name!r}")
    return name


def is_collection_name(name: Column) -> Column:
    trimmed = F.trim(name)
    return trimmed.rlike(_NAME) & (F.char_length(trimmed) <= MAX_NAME)
