"""Cues as the caption operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.intervals import SPAN_MS, milliseconds

#: The place of a cue in its file: by start in whole milliseconds, then by the place as written.
ORDER = ["start_ms", "cue_ord", "cue_id"]


def ordered_cues(
    cues: DataFrame, files: DataFrame, tracks: list[str], more: DataFrame | None = None, span_ms: int = SPAN_MS
) -> DataFrame:
    """The cues with a start and a text of the files of ``tracks``, one row for each cue_id.

    Columns: file_id, span (the bucket of ``ordered_scan``), cue_id, cue_ord, start_ms, end_ms (may be null), text,
    lang (may be null), and those that ``more`` has for a file_id. Cues whose file isn't in ``files``, whose start isn't a finite number or whose text is null or
    blank are left out. Rows of one cue_id are equal but for the delivery and meet in one span, so that the one shuffle
    that brings a span together also serves to drop repeated deliveries.
    """
    of = files.where(F.col("track").isin(tracks)).select("file_id", "lang").dropDuplicates(["file_id"])
    if more is not None:
        of = of.join(more, "file_id", "left")
    kept = cues.where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}]")).select(
        "file_id", "cue_id", "cue_ord", milliseconds("start_s").alias("start_ms"),
        milliseconds("end_s").alias("end_ms"), "text",
    )
    kept = kept.where("start_ms is not null and cue_id is not null").join(of, "file_id")
    placed = kept.withColumn("span", F.floor(F.col("start_ms") / span_ms))
    return placed.repartition("file_id", "span").dropDuplicates(["file_id", "span", "cue_id"])
