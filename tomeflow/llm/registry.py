"""The queries and SQL of this subpackage; __spark_entry__ adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canonical, encode, language, mixing, near_duplicates, offence, pairs, scan_noise, split

MODULES = (scan_noise, language, canonical, pairs, split, near_duplicates, encode, mixing, offence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
