"""The catalogue of registered queries: name -> (Spark callable, SQL it is checked against)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame callable, with its SQL where SQL can say the same."""
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load() -> None:
    from wardlight.plans import aggregate_queries, guard_queries, message_queries, quality_queries, source_queries, stream_queries, text_queries  # noqa: F401
