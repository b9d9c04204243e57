"""Collects queries and their oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a job under its function's name, with the SQL that must give the same rows."""

        def add(job):
            self.queries[job.__name__] = job
            if sql is not None:
                self.oracle[job.__name__] = sql
            return job

        return add
