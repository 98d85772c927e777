"""Registry of named queries: a Spark builder and (when SQL can say it) an oracle.

Each Spark builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables; builders that write intermediate tables or fit a model
run those steps when they are called. Each oracle is DuckDB SQL over the same
tables. Joins, aggregates and folds are written independently; the text rules
(H, N, E) are rendered from the same step lists and patterns as the Spark
side, so the unit tests hold those against hand-written values and the
standard library. Computed columns carry the same aliases on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, Callable[[], str]] = {}
_OPERATORS: dict[str, tuple[str, ...]] = {}


def query(name: str, operators: tuple[str, ...], oracle: Callable[[], str] | None = None):
    """Register ``fn`` under ``name``; ``operators`` lists the covered SURVEY IDs."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        _OPERATORS[name] = operators
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: f() for k, f in _ORACLES.items()}


def coverage() -> dict[str, tuple[str, ...]]:
    _load()
    return dict(_OPERATORS)


def _load() -> None:
    from . import q_chunks, q_edgar, q_files, q_manifest, q_models, q_speech, q_text, q_topics, q_vectors  # noqa: F401  (registers on import)
