"""One local session for all tests, and a comparison of query results with SQL."""

from __future__ import annotations

import glob
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from codestrata.session import local_session, ship

    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if hasattr(value, "as_tuple"):
        return round(float(value), 9)
    if isinstance(value, dict):
        return str(sorted((k, canon(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return str([canon(v) for v in value])
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Compares a query with its SQL as bags of rows."""

    def check(query, sql: str) -> None:
        df = query(spark, sf_dir)
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        got, want = bag(df.columns, [tuple(r) for r in df.collect()]), bag(rel.columns, rel.fetchall())
        assert not (got - want) and not (want - got), (list((got - want).items())[:3], list((want - got).items())[:3])

    return check
