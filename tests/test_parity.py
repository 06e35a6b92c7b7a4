"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import sys
from pathlib import Path

import pytest

sys.path.append("/opt/oracle")
duckdb = pytest.importorskip("duckdb")

from tidemark.plans.registry import ORACLES, QUERIES, load  # noqa: E402

load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(canon, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, SF).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
