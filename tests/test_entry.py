import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.path.join(os.environ.get("TARNFLOW_TESTDATA", "/root/testdata"), "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
FAST = ["p1_found", "p1_descendants", "p3_found", "p4_found", "p4_region_profile", "spillfield_masked", "spill_regions_tiled", "spillpoints", "trap_summary", "trap_parents", "flow_accumulation", "event_states", "asof_state"]


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    text = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_same_rows_as_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), cols)


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    assert isinstance(entry.entry(spark).toPandas(), pd.DataFrame)
