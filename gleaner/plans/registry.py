"""How a module of queries names them and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
