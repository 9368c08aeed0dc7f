"""Every query of the catalogue against its SQL in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from provenir.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else str(x) if isinstance(x, (list, dict)) else x for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(plain(r) for r in df.select(*cols).collect())
    if name not in catalogue.SQL:
        assert sum(got.values()) > 0
        return
    want = Counter(map(plain, con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()))
    assert got == want


def test_entry_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
