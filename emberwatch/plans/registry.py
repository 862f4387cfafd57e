"""All registered queries and oracles, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberwatch.plans.fixtures import Tables

GROUPS = ("ingest", "security", "anomaly", "correlate", "context", "chain", "retrieval", "investigate", "portal",
          "streams", "rollups")


def _modules():
    return [importlib.import_module(f"emberwatch.plans.{name}") for name in GROUPS]


def _bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for module in _modules() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
