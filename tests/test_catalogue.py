"""Every catalogue query against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkloom import catalogue
from sparkloom.catalogue import contracts

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Rows-only: no SQL twin.
NO_SQL = set()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def canonical(df):
    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns)
    if name in NO_SQL:
        assert name not in catalogue.SQL
        got.collect()
        return
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.toPandas()) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cumcount_per_group", "lookahead_return"])
def test_contract_cases_have_all_events(spark, name):
    d = "/root/testdata/sf0.01"  # the smallest tables have no user over 50
    (inputs, _), events = contracts.cases(spark, d)[name], spark.read.parquet(f"{d}/events.parquet")
    assert inputs["df"].exceptAll(events).count() == 0 and inputs["df"].count() == events.count() > 0


@pytest.mark.parametrize("name", ["past_return", "past_return_global"])
def test_returns_from_zeros_and_at_ties(spark, tmp_path, name):
    import datetime as dt

    values = [6.4, 57.63, 0.0, 2.0, 0.0, 0.0, -1.0, None, 6.4, 57.63]
    rows = [(k, dt.datetime(2024, 1, 1, k), 1, v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(catalogue.SQL[name]).df()
    assert canonical(got) == canonical(want) and "inf" in {x for row in canonical(got) for x in row}


@pytest.mark.parametrize("name", ["page_parse", "page_titles_and_links"])
def test_titles_cut_in_a_reference(spark, tmp_path, name):
    html = ["<title>a &amp; b&amp</title><a href='x'>y</a>", "<title> &quot;c&quo</title>", "<title>d&lt</title>", "<title>&amp;lt;&#39;&am</title>", "none", ""]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert canonical(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(c.execute(catalogue.SQL[name]).df())
