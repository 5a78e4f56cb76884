"""Registered queries against their DuckDB oracles."""

import duckdb
import pytest

from lodestead.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLES:
        out = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_drop_constants_where_every_site_reaches_the_cap(spark, sf, tmp_path):
    """pages_crawled is 25 throughout, yet the SQL names it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id = 0")
    pages.selectExpr("explode(sequence(0L, 29L)) AS page_id", "url", "html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    expected = c.execute(catalogue.ORACLES["drop_constants"])
    names, rows = [d[0] for d in expected.description], expected.fetchall()
    assert {r[names.index("pages_crawled")] for r in rows} == {25}
    got = catalogue.QUERIES["drop_constants"](spark, str(tmp_path))
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(rows)


def test_shared_trackers_of_events_with_gaps(spark, tmp_path):
    """Users, kinds and values that are missing share nothing, as in the SQL."""
    events = [(1, "a", 1.0), (2, "a", 1.0), (2, None, 2.5), (3, "b", 2.5), (None, "a", 1.0), (4, "a", None), (5, None, None), (6, "b", 9.0), (6, "b", 9.0)]
    spark.createDataFrame(events, "user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = c.execute(catalogue.ORACLES["shared_tracker_union"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["shared_tracker_union"](spark, str(tmp_path)).collect()), key=str) == sorted(expected, key=str)
