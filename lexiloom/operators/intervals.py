"""Merging intervals into continuous periods and listing the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.sequence import ordered_scan

SPAN_MS = 600_000


def milliseconds(seconds: str) -> Column:
    """Seconds as whole milliseconds, nearest; NaN and infinite values as null."""
    value = F.col(seconds)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(9.0e12))
    return F.when(finite, F.round(value * 1000).cast("long"))


def periods_and_gaps(
    df: DataFrame, entity: str = "file_id", start: str = "start_s", end: str = "end_s", span_ms: int = SPAN_MS
) -> DataFrame:
    """The longest stretches without an uncovered moment, and the stretches between neighbouring ones, per entity.

    Rows are sorted by start inside each entity, each start is compared with the greatest end of all rows before, a
    start beyond that end opens the next island, the running number of openings labels the islands, and the islands are
    aggregated to periods; a gap lies between such a greatest end and the start that opens an island.

    Times are seconds; they are compared in whole milliseconds. Intervals that touch are continuous. A row covers
    nothing if a time or the entity is null, or if its end isn't after its start. Repeated rows change nothing, ties
    neither. An empty table gives no rows. Other columns are ignored, whatever their names.

    Result: (entity, kind 'period' | 'gap', from_ms, to_ms). Buckets of ``span_ms`` keep an entity with a large share of
    all rows spread over many tasks (see ``ordered_scan``).
    """
    cover = (
        df.select(F.col(entity).alias("entity"), milliseconds(start).alias("a"), milliseconds(end).alias("b"))
        .where("entity is not null and b > a")
        .withColumn("span", F.floor(F.col("a") / span_ms))
    )
    opened = ordered_scan(cover, ["entity"], "span", ["a", "b"], peak_before={"reach": "b"}).withColumn(
        "opens", F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0)
    )
    # Of equal intervals the one that opens the island comes first.
    opened = opened.withColumn("follows", 1 - F.col("opens"))
    labelled = ordered_scan(opened, ["entity"], "span", ["a", "b", "follows"], total={"island": "opens"})
    both = (
        labelled.groupBy("entity", "island")
        .agg(
            F.min("a").alias("a"),
            F.max("b").alias("b"),
            F.max(F.when(F.col("opens") == 1, F.col("reach"))).alias("before"),
        )
        .select(
            "entity",
            F.explode(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("a").alias("from_ms"), F.col("b").alias("to_ms")),
                    F.struct(F.lit("gap").alias("kind"), F.col("before").alias("from_ms"), F.col("a").alias("to_ms")),
                )
            ).alias("x"),
        )
    )
    return both.select(F.col("entity").alias(entity), "x.kind", "x.from_ms", "x.to_ms").where("from_ms is not null")


def coverage(df: DataFrame, entity: str = "file_id", **columns: str) -> DataFrame:
    """Per entity the number of periods and gaps and the milliseconds covered and silent."""
    x = periods_and_gaps(df, entity, **columns)
    length, period = F.col("to_ms") - F.col("from_ms"), F.col("kind") == "period"
    return x.groupBy(entity).agg(
        F.count_if(period).alias("n_periods"),
        F.count_if(~period).alias("n_gaps"),
        F.sum(F.when(period, length).otherwise(0)).alias("covered_ms"),
        F.sum(F.when(~period, length).otherwise(0)).alias("silent_ms"),
    )
