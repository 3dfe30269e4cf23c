"""Registered training-data queries against their SQL on the smallest tables, where these are at hand."""

import glob
import os

import pytest

from inkstone.llm import queries

FOLDER = os.environ.get("INKSTONE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, FOLDER)
    got = c.execute(queries.SQL[name])
    columns = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, got.fetchall()))


def test_tables_without_rows_give_no_rows(spark, tmp_path):
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{tmp_path}/{os.path.basename(f)}")
    for name in ("p1_found", "p2_found", "p2_splits", "p3_found", "p4_found", "p5_budget", "p6_found", "p7_found", "p8_ids", "p9_drawn"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0, name
