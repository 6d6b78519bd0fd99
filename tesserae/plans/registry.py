"""A decorator that files a query under its function's name, with its oracle."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql.strip()
            return f

        return add
