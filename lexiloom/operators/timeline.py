"""How much of a timed text a study order covers, over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

EVERY, RATE, COVER = 300, 20, 0.95
SPAN = 4096


def as_of(points: DataFrame, marks: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """``points`` with the ``value`` of the last of ``marks`` at or before their ``at``; before all, the first one's.

    Both tables have ``group`` and ``at``; points carry further columns along. One ordered scan over their union.
    """
    carried = [c for c in points.columns if c not in (group, at)]
    extra = F.struct(*carried).alias("carried")
    p = points.select(group, at, F.lit(1).alias("kind"), extra, F.lit(None).cast("double").alias(value))
    m = marks.select(group, at, F.lit(0).alias("kind"), F.lit(None).cast(p.schema["carried"].dataType).alias("carried"), F.col(value).cast("double").alias(value))
    both = p.unionByName(m).withColumn("span", F.floor(F.col(at) / SPAN))
    filled = ordered_scan(both, [group], "span", [at, "kind"], fill={"last": value}).where("kind = 1")
    first = marks.groupBy(group).agg(F.min_by(value, at).alias("first"))
    timed = filled.join(first, group, "left")
    return timed.select(group, at, "carried.*", F.coalesce("last", "first").cast("double").alias(value))


def cutoffs_of(ends: DataFrame, group: str, every: int) -> DataFrame:
    """The cutoffs of each group (group, end), numbered: the multiples of ``every`` up to the end, and the end itself."""
    last = F.floor(F.col("end") / F.lit(every)).cast("long")
    beyond = F.when(last * every < F.col("end"), 1).otherwise(0)
    none = F.when((last == 0) & (beyond == 0), 1).otherwise(0)
    numbered = ends.select(group, "end", last.alias("last"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(last + beyond + none, F.lit(1)))).alias("nth"))
    at = F.when(F.col("nth") > F.col("last"), F.col("end")).otherwise((F.col("nth") * every).cast("double"))
    return numbered.select(group, "nth", at.alias("cutoff"))


def coverage_rows(met: DataFrame, ends: DataFrame, group: str, every: int = EVERY, rate: int = RATE, cover: float = COVER) -> DataFrame:
    """Per group and cutoff how far into the deck the words met so far reach.

    ``met`` has (group, t, position; null where no card teaches the word), ``ends`` (group, end). Cutoffs are the
    multiples of ``every`` seconds and the end. cards is the position by which the share ``cover`` of the words met is
    taught: null if more are untaught than that leaves, 0 before any word.

    Each word is counted once, at its first cutoff. A group's positions fall into as many blocks as the root of its last
    position; running counts per block tell in which block the wanted rank falls, and only that block's words, counted
    by position, are looked at for each cutoff. So no word is repeated for all later cutoffs.
    """
    every = max(every, 1)
    marks = cut(cutoffs_of(ends, group, every))
    last = marks.groupBy(group).agg(F.max("nth").alias("last_nth"), F.max_by("cutoff", "nth").alias("end"))
    first = F.greatest(F.ceil(F.col("t") / F.lit(every)).cast("long"), F.lit(1).cast("long"))
    words = met.join(last, group).where("t <= end").select(group, "position", F.least(first, F.col("last_nth")).alias("nth"))
    side = words.groupBy(group).agg(F.greatest(F.ceil(F.sqrt(F.coalesce(F.max("position"), F.lit(1)))), F.lit(1)).cast("long").alias("side"))
    counted = words.groupBy(group, "nth", "position").agg(F.count(F.lit(1)).alias("n")).join(side, group)
    counted = cut(counted.withColumn("block", F.floor(F.col("position") / F.col("side"))))

    upto = Window.partitionBy(group).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    per = counted.groupBy(group, "nth").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("position").isNull(), F.col("n")).otherwise(0)).alias("u"), F.max("position").alias("far"))
    running = marks.join(per, [group, "nth"], "left").select(
        group, "nth", "cutoff", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n_met"), F.coalesce(F.sum("u").over(upto), F.lit(0)).alias("n_untaught"),
        F.max("far").over(upto).alias("furthest"),
    )
    running = cut(running.withColumn("wanted", F.ceil(F.lit(cover) * F.col("n_met"))))
    # Of each block the running count at every cutoff, then over the blocks.
    taught = counted.where("position is not null")
    blocks = taught.select(group, "block").distinct()
    in_block = taught.groupBy(group, "nth", "block").agg(F.sum("n").alias("n"))
    dense = running.where("wanted > 0 and wanted <= n_met - n_untaught").select(group, "nth", "wanted").join(blocks, group)
    every_nth = running.select(group, "nth").join(blocks, group).join(in_block, [group, "nth", "block"], "left")
    by_block = Window.partitionBy(group, "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    filled = every_nth.select(group, "nth", "block", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("n"))
    over = Window.partitionBy(group, "nth").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    reach = dense.join(filled, [group, "nth", "block"]).withColumn("total", F.sum("n").over(over))
    hit = reach.where("total >= wanted and total - n < wanted").select(group, F.col("nth").alias("at"), "block", (F.col("wanted") - F.col("total") + F.col("n")).alias("rank"))
    inner = hit.join(taught.select(group, "block", "nth", "position", "n"), [group, "block"]).where("nth <= at")
    inner = inner.groupBy(group, "at", "rank", "position").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(group, "at").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    cards_at = inner.withColumn("total", F.sum("n").over(along)).where("total >= rank").groupBy(group, F.col("at").alias("nth")).agg(F.min("position").alias("cards"))

    rows = running.join(cards_at, [group, "nth"], "left")
    cards = F.when(F.col("n_met") == 0, F.lit(0)).otherwise(F.col("cards")).cast("long")
    furthest = F.coalesce("furthest", F.lit(0)).cast("long")
    days = lambda c: c / F.lit(float(rate)) if rate else F.lit(0.0)
    return rows.select(
        group, "cutoff", F.col("n_met").cast("long").alias("n_met"), F.col("n_untaught").cast("long").alias("n_untaught"),
        cards.alias("cards"), days(cards).alias("days"), furthest.alias("furthest"), days(furthest).alias("furthest_days"),
    )
