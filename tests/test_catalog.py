import os

import pytest

import __spark_entry__ as e


def test_every_check_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 170


@pytest.mark.parametrize("key", ["filter_max_age", "win_fan_out", "local_day", "norm_urls", "stream_daily_counts", "cc_story"])
def test_query_equals_sql(spark, key):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = e.queries()[key](spark, sf)
    cur = con.execute(e.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


def test_the_entry_module_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
