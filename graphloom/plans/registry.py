"""A small registry: query name -> function, and its SQL."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.q: dict = {}
        self.s: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f):
            self.q[name] = f
            if sql:
                self.s[name] = sql.replace(", 4)", " + 1e-9, 4)")  # half-up at four places, on both sides
            return f

        return keep
