"""Streaming forms: words met per time window, and a schedule that carries state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type) per window and type, for batch and stream; on a stream rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("from_ts"), "event_type", "n")


def kept(n: int) -> bool:
    """Whether the n-th offered form of a rule is kept: the first four, then every 2nd, 4th, ... after each four kept."""
    step, seen, at = 1, 0, 0
    while at < n:
        at += step
        seen += 1
        if seen % 4 == 0:
            step *= 2
    return at == n


def culled(occurrences: DataFrame) -> DataFrame:
    """Occurrences (rule, ord, surface) of a stream with whether they're kept; counters live in the state of each rule.

    A surface that is kept passes from then on without counting; one that is culled is offered again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, known = state.get if state.exists else (0, [])
        have = set(known)
        for rows in batches:
            flags = []
            for surface in rows.sort_values("ord")["surface"]:
                if surface in have:
                    flags.append(True)
                    continue
                n += 1
                if kept(n):
                    have.add(surface)
                flags.append(surface in have)
            yield rows.sort_values("ord").assign(kept=flags)[["rule", "ord", "surface", "kept"]]
        state.update((n, sorted(have)))

    return occurrences.groupBy("rule").applyInPandasWithState(
        step, "rule string, ord long, surface string, kept boolean", "n long, known array<string>", "append", GroupStateTimeout.NoTimeout
    )
