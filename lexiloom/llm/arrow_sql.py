"""DuckDB as the expression engine inside Arrow partitions, and groups of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_sql(df: DataFrame, query: str, schema: str) -> DataFrame:
    """Run ``query`` over every Arrow batch of ``df``, which it reads as table ``rows``.

    One DuckDB per task with one thread, so that tasks don't compete for cores; a batch is handed over without a copy
    and the result is a batch again. The query has to treat rows one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "500MB"}) as con:
            for batch in batches:
                con.register("rows", pa.Table.from_batches([batch]))
                yield from con.sql(query).to_arrow_table().to_batches()
                con.unregister("rows")

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """``df`` over as many partitions as there are cores if its scan is small: one small file is one task otherwise.

    Only what the optimizer knows of the input's size is asked, so that nothing runs; a scan of more than ``least`` bytes
    a core stays as it is and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * least else df


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows at which a new group of ``keys`` begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = table[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``keys``; a batch's last group waits for the next one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*rest, batch])
        if table.num_rows:
            last = int(changes(table, keys)[-1])
            if last:
                yield table.slice(0, last).combine_chunks()
            rest = table.slice(last).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()
