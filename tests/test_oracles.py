"""Every query with SQL of its own gives the same rows in DuckDB; the others run and give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from trackforge import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def same(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return round(float(value), 4)
    return value


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in plans.ORACLES:
        assert columns
        return
    found = duck.sql(plans.ORACLES[name])
    assert sorted(found.columns) == columns
    order = sorted(range(len(columns)), key=lambda i: found.columns[i])
    assert rows == sorted((tuple(same(r[i]) for i in order) for r in found.fetchall()), key=repr)
