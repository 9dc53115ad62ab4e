"""Registration of queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Register:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return add


def rounded(digits: int = 6, **columns: Column) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in columns.items()]
