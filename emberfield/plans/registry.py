"""All queries of the library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Tables, oracle
from . import fires, flows, survey

MODULES = [fires, survey, flows]
ALL = {name: q for m in MODULES for name, q in m.QUERIES.items()}


def _bound(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(f) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in ALL.items() if sql}
