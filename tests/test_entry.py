"""The driver contract, and a few queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_query_has_its_sql():
    own = {name for name in entry.queries() if name != "pipeline" and not name.startswith("op")}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "severity", "n"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", [
    "n1_normalize", "m9_pack_match_documents", "m11_verdicts", "p1_validation_cascade", "t4_rate_limit", "usage_snapshot",
    "s10_event_batches", "q3_acting_review_patterns",
])
def test_query_equals_its_sql(spark, name):
    import duckdb
    from check import TABLES, canonical
    import pandas as pd

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = entry.queries()[name](spark, DATA)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    rel = con.sql(entry.oracle_sql()[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
