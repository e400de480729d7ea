"""One local session for all tests, the sample tables, and DuckDB views of them."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"  # for the Python workers
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/quernstone-warehouse",
    }
    session = SparkSession.builder.appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


def canonical(table) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in order, of an Arrow table."""
    names = sorted(table.column_names)
    return names, sorted(tuple(map(_plain, r)) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True))


@pytest.fixture(scope="session")
def agrees(duck):
    """Asserts that a DataFrame has what a statement gives in DuckDB."""

    def check(df, sql: str) -> None:
        got, wanted = canonical(df.toArrow()), canonical(duck.sql(sql).to_arrow_table())
        assert got[0] == wanted[0]
        assert got[1] == wanted[1]

    return check
