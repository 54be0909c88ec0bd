"""The query catalogue over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from screenfold.plans import graph_queries, list_queries, model_queries, read_queries, screen_queries, set_queries, text_queries  # noqa: F401
from screenfold.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
