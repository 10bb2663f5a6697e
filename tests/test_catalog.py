"""Every query on readings against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from silocast.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    both = []
    for df in (got, want):
        df = df[columns].copy()
        for c in columns:
            if c in ("day", "detection_time", "time") and df[c].dtype.kind not in "iu":
                df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
            elif df[c].dtype.kind in "iuf":
                df[c] = df[c].astype(float)
        both.append(df.sort_values(columns).reset_index(drop=True))
    pd.testing.assert_frame_equal(*both, check_dtype=False, atol=2e-6)
