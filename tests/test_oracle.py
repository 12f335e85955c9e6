"""Every query of the engine that has SQL, against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from crestline.queries import engine

DATA = "/root/testdata/sf0.001"
TABLES = ("orders", "events")


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(v) if isinstance(v, (str, bool)) else str(bool(v)) if str(type(v)).find("bool") >= 0 else repr(float(v))

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    ours, theirs = engine.queries()[name](spark, DATA).toPandas(), con.sql(engine.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    out = engine.entry(spark, DATA)
    assert {"signal_high", "signal_low", "baseline_high", "baseline_low"} <= set(out.columns)
    assert out.where("signal_high OR signal_low").count() > 0
