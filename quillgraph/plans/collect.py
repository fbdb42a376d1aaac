"""A table of queries and the decorator that fills it."""

from __future__ import annotations


def collector():
    found: dict = {}

    def query(sql: str | None = None):
        def add(f):
            found[f.__name__] = (f, sql)
            return f

        return add

    return found, query
