"""Every query with SQL equals it on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from echofold import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_scans_read_only_what_they_need(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    plan = catalog.queries()["comment_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "Python" not in plan
