"""Registry of every query the package exposes: name -> (DataFrame builder, oracle SQL).

Each builder takes the entity tables of one driver directory and returns a lazy DataFrame
over the whole tables. The SQL is the independent DuckDB statement used by the correctness
gate (None where no SQL form is given).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from supplymetrics.oracle import with_ctes
from supplymetrics.sources.adapters import Tables


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None, *needs: str) -> None:
    if name in REGISTRY:
        raise ValueError(f"duplicate query {name}")
    REGISTRY[name] = Entry(build, with_ctes(sql, *needs) if sql is not None else None)


def _load() -> None:
    # importing the modules registers their queries
    from supplymetrics.plans import queries_core  # noqa: F401
    from supplymetrics.plans import queries_more  # noqa: F401


def all_entries() -> dict[str, Entry]:
    if not REGISTRY:
        _load()
    return REGISTRY
