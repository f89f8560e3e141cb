"""Collects the registered queries for the driver."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from footprints.queries.inputs import Inputs
from footprints.queries.registry import ORACLES, QUERIES, with_views
from footprints.session import ship_package

MODULES = ["counting", "read_queries", "alignment_queries", "profile_queries", "pause_queries", "compare_queries", "boundary_queries", "source_queries", "workflow_queries"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"footprints.queries.{module}")


def _run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return QUERIES[name](Inputs(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: partial(_run, name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in ORACLES.items()}
