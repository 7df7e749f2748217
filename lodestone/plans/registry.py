"""The registry of queries: callables and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    import importlib
    import pkgutil

    from lodestone import plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{plans.__name__}.{m.name}")
    return QUERIES, ORACLES
