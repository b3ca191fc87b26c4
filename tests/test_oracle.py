"""Every registered query of the surveillance part against its DuckDB SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import watchpost.plans.jobs  # noqa: F401
from watchpost.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


#: FEW_QUERIES=1 runs these only.
SOME = ["anomaly_from_z", "boundary_adjacency", "briefing_text", "contributions", "deseasonal_z", "drift_report", "emerging_variants", "ffill_daily", "fhir_ingest", "latest_confidence", "national_rollup", "policy_backtest", "psi", "quality_report", "risk_assessment", "scenario_projection", "source_reliability", "spread_forecast", "weather_unpivot", "weighted_source_mean"]


@pytest.mark.parametrize("name", SOME if os.environ.get("FEW_QUERIES") else sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, r.fetchall())


@pytest.mark.parametrize("name", ["risk_assessment", "quality_report", "briefing_text", "scenario_projection"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
