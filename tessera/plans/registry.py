"""The registered queries, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.analogue import Reports
from . import backtest, book, catalog, court, evidence, flags, market, notes, panel, release, series, signals, verifiers, xray  # noqa: F401  they register their plans
from .register import PLANS


def _bound(f: Callable[[Reports], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(Reports(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(f) for name, (f, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
