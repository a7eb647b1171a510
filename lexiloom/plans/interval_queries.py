"""Queries over merged intervals, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.operators.intervals import coverage, periods_and_gaps


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods of every file and the gaps between them."""
    return periods_and_gaps(spark.read.parquet(f"{folder}/cues.parquet"))


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Covered and silent milliseconds of every file."""
    return coverage(spark.read.parquet(f"{folder}/cues.parquet"))


_PERIODS = """
    WITH c AS (
        SELECT DISTINCT file_id, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b
        FROM cues
    ), v AS (SELECT * FROM c WHERE b > a),
    w AS (
        SELECT *, max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
        FROM v
    ), g AS (
        SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END)
            OVER (PARTITION BY file_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k
        FROM w
    ), p AS (SELECT file_id, k, min(a) AS a, max(b) AS b FROM g GROUP BY file_id, k),
    f AS (
        SELECT file_id, 'period' AS kind, a AS from_ms, b AS to_ms FROM p
        UNION ALL
        SELECT file_id, 'gap', e, a FROM (SELECT *, lag(b) OVER (PARTITION BY file_id ORDER BY k) AS e FROM p)
        WHERE e IS NOT NULL
    )"""
SQL = {
    "p2_found": _PERIODS + " SELECT * FROM f",
    "p2_coverage": _PERIODS + """
        SELECT file_id, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps,
            CAST(sum(CASE WHEN kind = 'period' THEN to_ms - from_ms ELSE 0 END) AS BIGINT) AS covered_ms,
            CAST(sum(CASE WHEN kind = 'gap' THEN to_ms - from_ms ELSE 0 END) AS BIGINT) AS silent_ms
        FROM f GROUP BY file_id""",
}
QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}
