"""Every registered query of the reference's operators against its oracle at the smallest scale."""

import os
import subprocess
import sys

import duckdb
import pytest

from notelink.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_oracle(spark, db, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), db.sql(q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_extras():
    import __spark_entry__

    assert set(q.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_session():
    """The driver may ask for the queries before it has a session."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, timeout=120)
