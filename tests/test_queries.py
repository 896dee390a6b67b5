"""Queries against their SQL on the smallest tables."""

import os

import pytest

from marginalia.plans.oracles import ORACLES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
#: These parse a file per document and take most of the suite's time; test_extraction covers what they run.
SLOW = {"paired_comments", "merged_comments", "edited_files", "file_diffs", "file_status", "markup_comments"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_its_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries

    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    found = db.execute(oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    frame = queries()[name](spark, FOLDER)
    assert sorted(frame.columns) == columns
    names = [d[0] for d in found.description]
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=repr)
    assert sorted((tuple(row) for row in frame.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want


def test_every_sql_has_its_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
