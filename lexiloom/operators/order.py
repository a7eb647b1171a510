"""A shuffle of cards that keeps dependencies first and every card near its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.graph import PARTS, acyclic, heights_and_depths, together
from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

#: The most places a card moves, and the least and most it comes after what it waits for.
WINDOW, GAP = 140, (10.0, 70.0)


def draw(seed: int, salt: int) -> Column:
    """A uniform number in [0, 1) that depends on the seed, the card and the salt only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col("source_ord"), F.col("idx")), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def shuffled(cards: DataFrame, edges: DataFrame, seed: int, window: int = WINDOW) -> DataFrame:
    """Cards (source_ord, idx) in their new order: source_ord, idx, place (1-based).

    A card's key is its position plus a random part of the window, less for cards that others wait for; it lies a
    random gap after the latest key of what it depends on, and is drawn anew between that and the end of its window
    where the gap leads beyond. Then the cards are sorted by key.

    Edges to later cards count like others, and then a card may leave its window; only edges that close a cycle are left
    out (``graph.cycle_edges`` lists them). Lists of any length are keyed level by level of the dependency graph, all
    cards of a level at once: a level's keys go along its edges to the cards that wait, and stay written.
    """
    cards = cards.select("source_ord", "idx").where("source_ord is not null and idx is not null").distinct()
    known = cards.select("source_ord", F.col("idx").alias("dep"))
    kept = acyclic(edges.join(cards, ["source_ord", "idx"], "left_semi").join(known, ["source_ord", "dep"], "left_semi"))
    spans = keys(cards, kept, seed, float(window)).withColumn("span", F.floor(F.col("key") / 512))
    return ordered_scan(spans, ["source_ord"], "span", ["key", "idx"], count="place").select("source_ord", "idx", "place")


def keys(cards: DataFrame, edges: DataFrame, seed: int, window: float) -> DataFrame:
    """The keys of all cards: source_ord, idx, key."""
    position, gap = F.col("idx").cast("double"), F.lit(GAP[0]) + draw(seed, 2) * (GAP[1] - GAP[0])
    drawn = heights_and_depths(cards, edges).select(
        "source_ord", "idx", "depth", (position + draw(seed, 1) * window / (F.col("height") + 1)).alias("own"), gap.alias("gap"),
        (position + window).alias("ceiling"), draw(seed, 3).alias("again"),
    )
    drawn = cut(drawn)
    deepest = drawn.agg(F.max("depth")).first()[0] or 0
    back = edges.select("source_ord", F.col("dep").alias("from"), F.col("idx").alias("to"))
    level = cut(drawn.where("depth = 0").select("source_ord", "idx", F.col("own").alias("key")))
    parts, sent = [level], []
    floor, ceiling, after = F.col("floor"), F.col("ceiling"), F.col("floor") + F.col("gap")
    raised = F.greatest("own", after)
    key = F.when(raised <= ceiling, raised).when(floor < ceiling, ceiling - F.col("again") * (ceiling - floor)).otherwise(after)
    for depth in range(1, deepest + 1):
        moved = level.select("source_ord", F.col("idx").alias("from"), "key").join(back, ["source_ord", "from"])
        sent.append(moved.groupBy("source_ord", F.col("to").alias("idx")).agg(F.max("key").alias("floor")))
        reached = together(sent).groupBy("source_ord", "idx").agg(F.max("floor").alias("floor"))
        level = cut(drawn.where(F.col("depth") == depth).join(reached, ["source_ord", "idx"]).select("source_ord", "idx", key.alias("key")))
        parts.append(level)
        if len(sent) >= PARTS:
            sent = [cut(reached)]
            parts = [cut(together(parts))]
    return together(parts)
