"""Named queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[["Inputs"], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Bytes of files: row groups are of 128 MB at most unless a writer is told otherwise.
MANY_ROW_GROUPS = 4 * 128 * 1024 * 1024


class Tables:
    """The given Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str, columns: list[str], key: str) -> DataFrame:
        """Columns of a table, dealt out by a key ahead of costly expressions where it may be a single row group.

        A table of several times the usual size of a row group is read by many tasks as it is, and a shuffle of all its rows would
        only take disk.
        """
        rows = self.table(name)
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        chosen = rows.select(*columns)
        return chosen if size >= MANY_ROW_GROUPS else chosen.repartition(key)


def _needed(sql: str, seen: list[str], inside: tuple[str, ...] = ()) -> list[str]:
    for name in VIEWS:
        if name not in seen and name not in inside and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen, (*inside, name))
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Prepends the views that the statement names, in order of dependence."""
    names = _needed(sql, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[["Inputs"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
