"""All queries over the star schema and the events, each bound to an operator, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql gives the same rows in DuckDB."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.load(spark, sf_dir, (name,))[name]


def place(spark: SparkSession) -> str:
    """A new folder for what a query writes, in the folder that all machines share; a temporary one on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fleetlens-")
    return f"{root}/written-{uuid.uuid4().hex}"


def rows(spark: SparkSession, schema: str, values: str) -> DataFrame:
    """A small table of literals, such as rules."""
    return spark.sql(f"select * from values {values} as t({schema})")


def _load() -> None:
    from fleetlens.plans import alerting, capacity, catalog, filtering, health, ingestion, maintenance, streams  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
