"""A sample of named queries against their SQL twins on the smallest data."""

import os
import subprocess
import sys

import duckdb
import pytest

from furrow.catalog import all_queries, all_twins

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
from check_twins import NAMES, normal

SF = "/root/testdata/sf0.001"
SAMPLE = ["features_53", "baseline_forecast", "backtest", "ks_drift", "ffill_weather", "upsert_prices",
          "alerts_due", "latency_histogram", "cv_select", "classify_command"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = all_queries()[name](spark, SF)
    cur = con.execute(all_twins()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(cols, cur.fetchall())


def test_every_twin_has_a_query():
    assert set(all_twins()) <= set(all_queries())
    assert len(all_queries()) >= 120


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode == 0
