"""Every core query with SQL agrees with DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from pliego.plans import analysis, checks, validation  # noqa: F401, register their queries
from pliego.plans import queries as core

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = "chunks contracts customer documents embeddings eval_items events hits lineitem nation orders part region responses source_catalog supplier".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) or "" for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(core.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0
