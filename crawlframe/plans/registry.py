"""Registered queries: name -> Spark callable, and name -> check SQL."""

from __future__ import annotations

from collections.abc import Callable

from crawlframe.plans.views import with_views

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; `sql` may read the named views as plain tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if views and body[:4].upper() == "WITH":
                head = with_views(views, "")
                CHECKS[name] = f"{head.strip()},\n{body[4:].strip()}"
            else:
                CHECKS[name] = with_views(views, body)
        return fn

    return add
