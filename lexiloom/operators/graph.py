"""Dependency graphs given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

#: Written parts of a growing table are written as one when there are so many.
PARTS = 12
#: Levels of a graph that are followed in one go, between two writes.
STEPS = 4


def edges_of(glosses: DataFrame) -> DataFrame:
    """Distinct edges (source_ord, idx, dep) of glosses' dependencies; a gloss doesn't depend on itself."""
    out = glosses.select("source_ord", "idx", F.explode("depends_on").alias("dep"))
    return out.where("dep is not null and dep <> idx").distinct()


def together(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, each written once."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def closure(edges: DataFrame) -> DataFrame:
    """Everything each node depends on, directly or not: (source_ord, idx, dep), each once.

    Chains double: round k finds the pairs whose shortest chain has up to 2^k edges, by joining those found in the round
    before, as first halves, with all known ones. So the number of rounds is the logarithm of the longest chain,
    whatever its length, cycles end, and each round writes only the pairs it finds.
    """
    fresh = cut(edges.select("source_ord", "idx", "dep").distinct())
    parts = [fresh]
    while True:
        known = together(parts)
        second = known.select("source_ord", F.col("idx").alias("dep"), F.col("dep").alias("further"))
        more = fresh.join(second, ["source_ord", "dep"]).select("source_ord", "idx", F.col("further").alias("dep")).distinct()
        fresh = cut(more.join(known, ["source_ord", "idx", "dep"], "left_anti"))
        if fresh.isEmpty():
            return known
        parts.append(fresh)


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges to later cards that lie on a cycle: (source_ord, idx, dep).

    Every cycle has an edge to a later card. One lies on a cycle exactly if what it leads to depends on its own card,
    which is followed from such edges only, node by node.
    """
    ahead = edges.where("dep > idx").select("source_ord", "idx", "dep").distinct()
    step = edges.select("source_ord", F.col("idx").alias("at"), F.col("dep").alias("to"))
    fresh = cut(ahead.select("source_ord", "idx", "dep", F.col("dep").alias("at")))
    parts = [fresh]
    while not fresh.isEmpty():
        seen = together(parts)
        moved = fresh.join(step, ["source_ord", "at"]).select("source_ord", "idx", "dep", F.col("to").alias("at")).distinct()
        fresh = cut(moved.join(seen, ["source_ord", "idx", "dep", "at"], "left_anti"))
        parts.append(fresh)
        if len(parts) > PARTS:
            parts = [cut(together(parts))]
    return together(parts).where("at = idx").select("source_ord", "idx", "dep").distinct()


def acyclic(edges: DataFrame) -> DataFrame:
    """``edges`` without those of ``cycle_edges``: what goes back in the list stays, what goes ahead stays off cycles."""
    kept = cut(edges.select("source_ord", "idx", "dep").distinct())
    if kept.where("dep > idx").isEmpty():
        return kept
    return kept.join(cycle_edges(kept), ["source_ord", "idx", "dep"], "left_anti")


def heights_and_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The longest chain of what waits for each node (height) and of what it needs (depth): source_ord, idx, height, depth.

    ``edges`` have no cycle. Round k holds the nodes at the end of a chain of k edges, of both ways at once; only distinct
    nodes go on, so that the work is the edges at each level, not the number of chains.
    """
    ways = F.explode(F.array(
        F.struct(F.lit(True).alias("up"), F.col("idx").alias("at"), F.col("dep").alias("to")),
        F.struct(F.lit(False).alias("up"), F.col("dep").alias("at"), F.col("idx").alias("to")),
    ))
    step = cut(edges.select("source_ord", ways.alias("x")).select("source_ord", "x.up", "x.at", "x.to"))
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("up")
    front = cut(nodes.select("source_ord", "idx").distinct().select("source_ord", "idx", both).withColumn("level", F.lit(0)))
    parts, level = [front], 0
    while True:
        steps = []
        for _ in range(STEPS):
            level += 1
            moved = front.select("source_ord", "up", F.col("idx").alias("at")).join(step, ["source_ord", "up", "at"])
            front = moved.select("source_ord", F.col("to").alias("idx"), "up").distinct().withColumn("level", F.lit(level))
            steps.append(front)
        reached = cut(together(steps))
        parts.append(reached)
        front = reached.where(F.col("level") == level)
        if front.isEmpty():
            break
        if len(parts) > PARTS:
            parts = [cut(together(parts).groupBy("source_ord", "idx", "up").agg(F.max("level").alias("level")))]
    best = lambda up: F.max(F.when(F.col("up") == up, F.col("level"))).alias("height" if up else "depth")
    return together(parts).groupBy("source_ord", "idx").agg(best(True), best(False))


def levels(nodes: DataFrame, edges: DataFrame, upward: bool) -> DataFrame:
    """The longest chain at each node (source_ord, idx, level): of what waits for it (``upward``) or of what it needs.

    Edges ahead in the list count like others; those that close a cycle are left out (see ``cycle_edges``).
    """
    found = heights_and_depths(nodes, acyclic(edges))
    return found.select("source_ord", "idx", F.col("height" if upward else "depth").alias("level"))


def dependency_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A topological order: source_ord, idx, depth, place (1-based), by depth and then by place in the list."""
    found = heights_and_depths(nodes, acyclic(edges)).drop("height")
    spread = found.withColumn("span", F.struct("depth", F.floor(F.col("idx") / 512).alias("block")))
    return ordered_scan(spread, ["source_ord"], "span", ["idx"], count="place").drop("span")
