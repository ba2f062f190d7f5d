"""Every catalogued query with SQL against DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from orrery.plans import catalogue, catalogue_more, catalogue_scans  # noqa: F401  (registers its queries)

DIR = os.environ.get("ORRERY_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")


def canonical(rows):
    plain = lambda v: None if v is None or v != v else float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else v
    return sorted((tuple(plain(v) for v in row) for row in rows), key=str)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, oracle, name):
    frame = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    got = frame.select(columns).collect()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = oracle.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    want = found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert canonical(map(tuple, got)) == canonical(want)


def test_entry(spark):
    rows = catalogue.entry(spark, DIR).collect()
    assert rows and set(rows[0].asDict()) == {"room_id", "num_objects"}
