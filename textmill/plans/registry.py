"""Registering queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from textmill.plans.oracle import sql


class Registry:
    """Queries and oracles of one module of plans."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, oracle: str | None = None):
        def register(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracles[f.__name__] = sql(oracle)
            return f

        return register
