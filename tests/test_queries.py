"""Every query with SQL against DuckDB on the smallest tables: names, rows and values, floats to 9 digits."""

import glob
import os

import duckdb
import pytest

from tallyspark import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(rows):
    return sorted(tuple(round(float(v), 9) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, db, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert norm(got.select(*columns).collect()) == norm(want.fetchall())


def test_embedded_audio_of_long_urls(spark, tmp_path):
    """Urls around and beyond the 57 bytes that fill a line of 76 base64 characters; the smallest tables have shorter ones."""
    urls = [None, "", *("u" * n for n in (56, 57, 58, 59, 114, 115, 5000)), "é" * 28, "é" * 29]
    spark.createDataFrame([(i, u) for i, u in enumerate(u for u in urls for _ in range(2))], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(f"WITH pages AS (FROM '{tmp_path}/pages.parquet/*.parquet') {queries.ORACLES['embedded_audio']}")
    got = queries.QUERIES["embedded_audio"](spark, str(tmp_path)).select(*want.columns)
    assert norm(got.collect()) == norm(want.fetchall())
