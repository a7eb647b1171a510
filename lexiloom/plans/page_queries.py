"""Queries over dictionary pages, recognised text and event windows, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import glosses as G
from lexiloom.sources import html, ocr
from lexiloom.streaming.coverage import windowed_counts


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(s: SparkSession, d: str) -> DataFrame:
    """Every gloss as a page, with markup that isn't well-formed."""
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return G.records(read(s, d, "glosses")).select(
        F.col("gloss_id").alias("page_id"),
        F.concat(
            F.lit("<html><style>p{}</style><script>var a='</p>';</script><h2>"), escape("entry"), F.lit("</h2><h3>Noun</h3><p>See <a href='/wiki/"), escape("lemma"),
            F.lit("'>"), escape("surface"), F.lit("</a><ol><li>"), escape("definition"), F.lit("<ul><li>"), escape("surface"), F.lit("</ul></ol><h3>See also</h3><ol><li>other</ol></span>"),
        ).alias("html"),
    )


def parsed(s: SparkSession, d: str) -> DataFrame:
    return html.parsed_pages(pages(s, d))


def ocr_pages(s: SparkSession, d: str) -> DataFrame:
    """Cue texts as recognised pages: a page for each cue, a block of its words as lines."""
    rows = read(s, d, "cues").where("text is not null").dropDuplicates(["cue_id"])
    lines = F.split("text", " ")
    return rows.select(F.col("cue_id").alias("page_id"), F.to_json(F.struct(F.array(F.struct(lines.alias("lines"))).alias("blocks"))).alias("json"))


QUERIES = {
    "html_text": lambda s, d: parsed(s, d).select("page_id", "text"),
    "html_headings": lambda s, d: parsed(s, d).select("page_id", F.posexplode("headings").alias("at", "h")).select("page_id", "at", "h.level", "h.name"),
    "html_links": lambda s, d: parsed(s, d).select("page_id", F.explode("links").alias("href")),
    "html_sections": lambda s, d: parsed(s, d).select("page_id", F.explode("senses").alias("x")).select("page_id", "x.heading", "x.definition"),
    "ocr_blocks": lambda s, d: ocr.blocks(ocr_pages(s, d)),
    "ocr_fold": lambda s, d: ocr.speech(ocr_pages(s, d)),
    "event_windows": lambda s, d: windowed_counts(read(s, d, "events")),
}
REC = "g AS (SELECT DISTINCT ON (gloss_id) * FROM glosses ORDER BY gloss_id)"
SPACED = r"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"
SQL = {
    "html_headings": f"WITH {REC} SELECT gloss_id AS page_id, CAST(i AS INTEGER) AS \"at\", CAST(v.level AS INTEGER) AS level, v.name AS name FROM (SELECT gloss_id, unnest([0, 1, 2]) AS i, unnest([{{'level': 2, 'name': {SPACED.format(x='entry')}}}, {{'level': 3, 'name': 'Noun'}}, {{'level': 3, 'name': 'See also'}}]) AS v FROM g)",
    "html_links": f"WITH {REC} SELECT gloss_id AS page_id, '/wiki/' || coalesce(lemma, '') AS href FROM g",
    "event_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS from_ts, event_type, count(*) AS n FROM events GROUP BY ALL",
}
