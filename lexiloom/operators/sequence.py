"""Ordered scans over groups of any size.

A window over a whole group puts the group into one task. The scans here split every group into buckets that follow the
order (time spans, say), reduce each bucket to one row, carry values over the few bucket rows of a group, and finish
inside the buckets. No task ever holds more than one bucket of rows, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    *,
    count: str | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    fill: dict[str, str] | None = None,
    peak_before: dict[str, str] | None = None,
    low_from: dict[str, str] | None = None,
    total: dict[str, str] | None = None,
) -> DataFrame:
    """Add running columns to ``df`` over the order (``bucket``, ``order``) inside each ``group``.

    ``count`` names the 1-based place in the group. The mappings give new column -> source column:
    ``lag`` the value of the row before, ``lead`` that of the row after, ``fill`` the last value that isn't null up to and
    with this row, ``peak_before`` the greatest value of all rows before, ``low_from`` the least of this and all rows
    after, ``total`` the running sum up to and with this row.

    ``bucket`` has to grow with the order; ``order`` has to be unique inside a bucket, save for rows whose mutual order
    doesn't matter. Rows with null in ``group`` or ``bucket`` have no place and are left out. An empty table gives an
    empty table. New columns replace columns of the same name.
    """
    lag, lead, fill, peak_before, low_from, total = lag or {}, lead or {}, fill or {}, peak_before or {}, low_from or {}, total or {}
    keys, place = [*group, bucket], F.struct(*order)
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # What lies ahead is read in the opposite order: a frame that ends at the group's end is computed anew for every row.
    from_end = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*group).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)

    aggs: dict[str, Column] = {"_n": F.count(F.lit(1))}
    carried: dict[str, Column] = {}
    out: dict[str, Column] = {}
    if count:
        carried["_n"] = F.coalesce(F.sum("_n").over(across), F.lit(0))
        out[count] = F.count(F.lit(1)).over(upto) + F.col("_c_n")
    if lag:
        aggs["_lag"] = F.max_by(F.struct(*[F.col(s).alias(n) for n, s in lag.items()]), place)
        carried["_lag"] = F.last("_lag").over(across)
        first = F.row_number().over(inside) == 1
        for n, s in lag.items():
            out[n] = F.when(first, F.col("_c_lag")[n]).otherwise(F.lag(s).over(inside))
    if lead:
        aggs["_lead"] = F.min_by(F.struct(*[F.col(s).alias(n) for n, s in lead.items()]), place)
        carried["_lead"] = F.last("_lead").over(behind)
        last = F.lead(F.lit(1)).over(inside).isNull()
        for n, s in lead.items():
            out[n] = F.when(last, F.col("_c_lead")[n]).otherwise(F.lead(s).over(inside))
    for i, (n, s) in enumerate(low_from.items()):
        aggs[f"_w{i}"] = F.min(s)
        carried[f"_w{i}"] = F.min(f"_w{i}").over(behind)
        out[n] = F.least(F.min(s).over(from_end), F.col(f"_c_w{i}"))
    for i, (n, s) in enumerate(fill.items()):
        aggs[f"_f{i}"] = F.max_by(s, F.when(F.col(s).isNotNull(), place))
        carried[f"_f{i}"] = F.last(f"_f{i}", ignorenulls=True).over(across)
        out[n] = F.coalesce(F.last(s, ignorenulls=True).over(upto), F.col(f"_c_f{i}"))
    for i, (n, s) in enumerate(peak_before.items()):
        aggs[f"_p{i}"] = F.max(s)
        carried[f"_p{i}"] = F.max(f"_p{i}").over(across)
        out[n] = F.greatest(F.max(s).over(before), F.col(f"_c_p{i}"))
    for i, (n, s) in enumerate(total.items()):
        aggs[f"_t{i}"] = F.sum(s)
        carried[f"_t{i}"] = F.coalesce(F.sum(f"_t{i}").over(across), F.lit(0))
        out[n] = F.coalesce(F.sum(s).over(upto), F.lit(0)) + F.col(f"_c_t{i}")

    marks = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    marks = marks.select(*keys, *[c.alias(f"_c{n}") for n, c in carried.items()])
    joined = df.join(marks, keys)
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])
