"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import os

import duckdb
import pytest

from stratafs.operators import feed
from stratafs.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_its_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(catalogue.ORACLE_SQL[name])
    theirs = [c[0] for c in want.description]
    assert sorted(theirs) == columns
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b


#: Queries in which the size of a content shows that only a later one of its files has.
SIZED = [
    "agg_by_ext",
    "agg_dir_pairs",
    "agg_dir_stats",
    "agg_dup_groups",
    "agg_redundant_bytes",
    "agg_tier1_total",
    "fn_regenerable_reason",
    "jn_paths_docs",
    "jn_redundant",
    "jn_stale",
    "prj_byte_size0",
    "q_audit",
    "q_backup_audit",
]


@pytest.fixture(scope="module")
def sizeless(spark, tmp_path_factory):
    """Tables where file 5, which has no size, has the text of file 45, which is a build's output in /r0 with newer versions elsewhere."""
    folder = str(tmp_path_factory.mktemp("sizeless"))
    rows = [(i, f"text {i % 40}".ljust(100 + i % 40), "en", "web") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", SIZED)
def test_size_of_a_content_whose_first_file_has_none(spark, sizeless, name):
    folder, con = sizeless
    got = catalogue.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(catalogue.ORACLE_SQL[name])
    theirs = [c[0] for c in want.description]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_binary_texts_are_whole_and_zero_on_both_sides(spark):
    rows = catalogue._zeroed(spark, SF).collect()
    at = {(r["id"] % 7 == 0, bytes(r["content"]).find(0)) for r in rows}
    assert {(True, 8191), (False, 8192), (False, -1)} <= at and all(0 <= i < 8192 for within, i in at if within)
    assert all(len(r["content"]) == r["size"] + (0 in r["content"]) for r in rows) and max(r["size"] for r in rows) > 8192


def test_poll_of_one_request(spark):
    requests = spark.createDataFrame([(7, "complete", 3, None), (8, "pending", None, None)], "id long, status string, scan_run_id long, error string")
    runs = spark.sql("select 3L id, timestamp_seconds(10) started_at, timestamp_seconds(12) finished_at, 5L files_seen")
    polled = lambda i: [tuple(r) for r in feed.progress(requests.where(f"id = {i}"), runs).collect()]
    assert polled(7) == [(7, "complete", 3, 5, 2000, None)] and polled(8) == [(8, "pending", None, None, None, None)] and polled(9) == []
