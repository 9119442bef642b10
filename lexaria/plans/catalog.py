"""Query catalogue: inventory id -> (Spark query, DuckDB oracle SQL or None).

Every query reads the test tables (or relations Spark derives from them) in
full; caps occur only where they are the operator (top-k, first n, samplers).  Keys are inventory ids from the
survey followed by a short name.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from lexaria.plans import (  # noqa: F401
        q_text,
        q_vectors,
        q_evaluate,
        q_sampling,
        q_linalg,
        q_io,
        q_positions,
        q_losses,
        q_train,
        q_streaming,
        q_language,
    )
