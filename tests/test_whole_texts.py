"""Text queries over whole texts and whole surfaces, against brute force and their SQL."""

import re

import duckdb

from lexiloom.plans import text_queries as Q


def rows_and_sql(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = Q.QUERIES[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.SQL[name]})").fetchall()
    return {tuple(r) for r in df.collect()}, set(found), len(found)


def test_markers_of_every_line(spark, tmp_path):
    texts = ["- one\n * two\nthree\n12) four - five", "plain", "1. a\n\n• b", "", None, "-dash\n3.14 is\n- - x"]
    rows = list(enumerate(texts))
    got, found, n = rows_and_sql(spark, tmp_path, "unmarker", "documents", rows, "doc_id long, text string")
    want = {(i, k, re.sub(r"^\s*(?:[-*•]|\d+[.)])\s+", "", line)) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))}
    assert (0, 0, "one") in got and (0, 1, "two") in got and (2, 0, "a") in got
    assert got == want == found and n == len(want)


def test_every_piece_of_a_surface_is_masked(spark, tmp_path):
    glosses = [("lantern", "a lamp; renal", "tern"), ("水車小屋", "小さい水車", "屋"), ("◌ָ", "called ָ", "x"), ("ab", None, "b"), ("x.y", "yx", "."), ("𠮷野家", "家 𠮷", "野"), ("a", "banana", "a")]
    rows = [(i, *g) for i, g in enumerate(glosses)]
    got, found, n = rows_and_sql(spark, tmp_path, "mask_pieces", "glosses", rows, "gloss_id long, surface string, definition string, entry string")
    want = set()
    for i, surface, definition, entry in rows:
        text = f"{surface} ({definition or ''}) {entry}, {surface}x"
        for piece in (surface, *surface):
            text = text.replace(piece, "■")
        want.add((i, text))
    assert (0, "■ (■ ■■mp; ■■■■■) ■■■■, ■x") in got
    assert got == want == found and n == len(want)
