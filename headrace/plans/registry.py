"""Collects (query, SQL) pairs of one family."""

from __future__ import annotations

from .fixtures import query


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None, extra: dict | None = None):
        """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""
        if sql is not None:
            self.sql[name] = query(sql, extra)

        def keep(fn):
            self.queries[name] = fn
            return fn

        return keep
