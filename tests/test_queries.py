"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import glob
import math
import os
import re

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("INKSTONE_TEST_DATA", "/root/testdata/sf0.001")
NAMES = ("text_counts", "article_summary", "chunks", "mfw_zscores", "char_gram_idf", "auc_cosine_delta", "permutation_auc", "author_distances", "fold_scores", "tricks_by_model", "jaccard", "headline")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), columns)


def test_permutations_are_those_of_the_operator(spark):
    got = entry.queries()["permutation_auc"](spark, FOLDER).select("k").collect()
    assert sorted(r.k for r in got) == list(range(250))
    assert entry.queries()["permutation_summary"](spark, FOLDER).first().n_valid == 250


def test_every_query_has_sql_or_a_reason():
    without = {n for n in entry.queries() if n not in entry.oracle_sql() and not re.match(r"p\d+_", n)}
    assert without == {"leakage_check"}
