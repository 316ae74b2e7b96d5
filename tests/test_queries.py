"""Every domain query that has an oracle gives the oracle's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from faultline.plans import decision, explore, learning, records, registry, relational, roles, service, suggest, text, triage  # noqa: F401
from faultline.sources.views import TABLES

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{PATH}/*.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{PATH}/{t}.parquet')")
    return con


def plain(x):
    """Values as they are: results are compared to the last digit."""
    return "nan" if isinstance(x, float) and math.isnan(x) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, PATH)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, PATH).count() > 0


def test_names_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 50, set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["True", "True"]
