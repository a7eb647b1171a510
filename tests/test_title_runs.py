"""Titles that are spelled as runs of tokens, against their SQL, and where the runs go."""

import duckdb

from lexiloom.plans import term_queries as Q

GLOSSES = "entry string, examples array<struct<sentence: string, rendering: string>>"


def test_runs_are_shuffled_however_small_the_planner_takes_them_for(spark, tmp_path):
    texts = [("水 車 小屋。 火 山", "ja"), ("水,車 小屋", "zh"), ("a b a b", "ja"), ("c d", "en"), ("火\n\n車", "ja"), (None, "zh"), ("", "ja"), ("ab " * 3000, "zh")]
    entries = ["水車", "水車小屋", "水車", "車小屋火", "火山", "火車", "abab", "cd", "水", "", None, "ab" * 8, "ab" * 9, "a b"]
    examples = [("x", "The a b rest"), ("y", "ab ab"), (None, None)]
    spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(e, examples) for e in entries], GLOSSES).coalesce(1).write.parquet(f"{tmp_path}/glosses.parquet")
    con = duckdb.connect()
    for name in ("documents", "glosses"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = Q.QUERIES["title_runs"](spark, str(tmp_path))
    got = sorted(r.title for r in df.collect())
    assert got == sorted(["水車", "水車小屋", "火山", "abab", "ab" * 8]) == sorted(t for (t,) in con.execute(Q.SQL["title_runs"]).fetchall())
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
