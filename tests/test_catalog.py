"""Registered queries against their SQL. Set PANELFLOW_FULL=1 to run all of them."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = """src01_read_bars src03_resample_week src04_calendar fil02_ffill fil04_interpolate xf01_log_returns xf04_robust agg01_series_stats
agg07_ragged_panel agg10_directional win03_rolling win04_ewma mod01_adf_lag0 mod08_garch_filter mod14_fevd_generalized int07_spillover_pct
str01_stream_bars str02_stream_returns""".split()
NAMES = list(entry.queries()) if os.environ.get("PANELFLOW_FULL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        df.collect()
        return
    ok, message = compare(df, con, sql)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
