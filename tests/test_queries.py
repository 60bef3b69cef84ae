"""Each query with an oracle against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from lodestar import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or "date" in str(df[c].dtype):
            df[c] = df[c].map(lambda v: str(v)[:19].replace(" 00:00:00", ""))
        else:
            df[c] = df[c].astype(float)
    text = [c for c in df.columns if df[c].dtype == object]
    return df.sort_values(text + [c for c in df.columns if c not in text]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, db, name):
    got, want = _rows(plans.QUERIES[name](spark, DATA).toPandas()), _rows(db.execute(plans.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object:
            assert (got[c] == want[c]).all(), c
        else:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=2e-6, err_msg=c)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
