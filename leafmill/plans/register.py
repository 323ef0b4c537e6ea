"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from leafmill.plans import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_views: bool = True):
    """Registers a function under its own name; sql sees the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (views.SQL + sql if with_views else sql).strip()
        return f

    return add
