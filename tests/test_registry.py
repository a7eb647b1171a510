"""Queries against their SQL on the smallest tables, where these are present."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUICK = ["tidy", "listed", "targets", "respell", "is_number", "maximal_match", "uncovered_runs", "merge_deps", "deck_notes", "cue_parse", "p2_found", "unreadable"]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) or "" for c in columns) for r in df.collect())
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(plain(r[names.index(c)]) or "" for c in columns) for r in found.fetchall())
    assert sorted(names) == columns
    assert got == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "title", "sent", "first", "last", "key"]
