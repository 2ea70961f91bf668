"""Registry of named queries over the driver tables, each with its SQL oracle.

A query is ``fn(spark, sf_dir) -> DataFrame`` that runs one operator over whole
driver tables (or views derived from them). Its oracle is an independent DuckDB
SQL text over the same tables; queries whose result is a model output (no SQL
equivalent) register without one.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
PLAN_MODULES = ["profile_plans", "clean_plans", "anomaly_plans", "compare_plans", "correlate_plans",
                "chart_plans", "model_plans", "forecast_plans", "check_plans", "io_plans"]


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _load() -> None:
    for m in PLAN_MODULES:
        try:
            importlib.import_module(f"tabulyst.plans.{m}")
        except ModuleNotFoundError as exc:
            if exc.name != f"tabulyst.plans.{m}":
                raise


def _shipping(fn: Callable) -> Callable:
    """Wrap a query so the package is importable in the session's Python workers."""
    def run(spark, sf_dir):
        from tabulyst.session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable]:
    _load()
    return {name: _shipping(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every floating column (at the edge of a query, for comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql_round(expr: str, places: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places})"
