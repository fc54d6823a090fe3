"""Fail-closed checks: bad input raises, it is never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvalidInput(ValueError):
    """The rows break a rule of the operator."""


def assert_empty(violations: DataFrame, message: str) -> None:
    """Raise with the first violation, if there is one. Runs a job that stops at the first row."""
    rows = violations.limit(1).collect()
    if rows:
        raise InvalidInput(f"{message}: {rows[0].asDict()}")


def assert_unique(df: DataFrame, columns: list[str], message: str) -> None:
    assert_empty(df.groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1"), message)


def require(condition: Column, value: Column, message: str) -> Column:
    """value where condition holds; elsewhere the query fails with message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
