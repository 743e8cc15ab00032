"""Every query with a DuckDB twin equals it on sf0.001 (the driver checks sf0.01)."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows_of  # noqa: E402
from tillroll.operators import ml as ML  # noqa: E402
from tillroll.plans.oracle import SQL as CATALOG  # noqa: E402
from tillroll.sources.tables import TABLES  # noqa: E402

SQL = {k: v for k, v in E.oracle_sql().items() if k in CATALOG}  # the subpackage's own twins are tested in tests/llm
SKIP = {"export_manifest"}  # writes every view; covered by the sf0.01 check tool


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_registered_with_callable():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 88


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["category", "revenue"]


# Two physical layouts: the session default, and many tiny input splits with
# 3 shuffle partitions and no AQE.  Results must equal DuckDB *exactly* in
# both, i.e. they do not depend on partitioning or merge order.
LAYOUTS = {
    "default": {},
    "scattered": {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0",
                  "spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.enabled": "false"},
}


@pytest.fixture(params=list(LAYOUTS))
def layout(spark, request):
    old = {k: spark.conf.get(k) for k in LAYOUTS[request.param]}
    for k, v in LAYOUTS[request.param].items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(autouse=True, scope="module")
def short_fits():
    """``model_checks`` holds whatever the rounds; the full budgets take minutes."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ML, "GBT_ROUNDS", 3)
        m.setattr(ML, "RF_TREES", 5)
        yield


@pytest.mark.parametrize("name", sorted(k for k in SQL if k not in SKIP))
def test_oracle(spark, con, layout, name):
    sdf = E.queries()[name](spark, SF001)
    sc, sr = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(SQL[name])
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr, [(a, b) for a, b in zip(sr, dr) if a != b][:3]
