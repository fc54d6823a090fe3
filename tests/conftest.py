"""One local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    built = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }.items():
        built = built.config(key, value)
    session = built.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _text(value: object) -> str:
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted("|".join(_text(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="session")
def same_as_duckdb():
    """Compares a DataFrame with SQL over the same tables, as sets of rows with repeats."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")

    def compare(df: DataFrame, sql: str) -> None:
        found = db.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        expected = rows_of(columns, found.fetchall())
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected

    return compare
