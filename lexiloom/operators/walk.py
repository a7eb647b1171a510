"""The walk that turns occurrences of words into an ordered list of glosses, and the context they are met in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

LAST = 2147483647
#: A sentence is shown with neighbours until the words come to so many.
CONTEXT_WORDS = 20


def walked(occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """Glosses in the order in which a walk over the occurrences first adds them: source_ord, idx, ordinal (1-based).

    ``occurrences`` have (source_ord, occ, idx), ``edges`` (source_ord, idx, dep, dep_ord). Before a gloss comes all it
    depends on, in the order of its dependencies, each with its own dependencies first, and whatever was met before isn't
    added again. A gloss's place is its least path: the occurrence and the dependencies that lead to it. Least paths are
    found round by round, and only glosses whose path improved go on; a path never improves along a cycle. Then the end of
    a path comes after what continues it.
    """
    step = edges.select("source_ord", "idx", "dep", "dep_ord")
    best = cut(occurrences.groupBy("source_ord", "idx").agg(F.min(F.array(F.col("occ").cast("int"))).alias("path")))
    front = best
    while True:
        moved = front.join(step, ["source_ord", "idx"]).select("source_ord", F.col("dep").alias("idx"), F.concat("path", F.array(F.col("dep_ord").cast("int"))).alias("path"))
        moved = moved.groupBy("source_ord", "idx").agg(F.min("path").alias("path"))
        known = best.withColumnRenamed("path", "known")
        front = cut(moved.join(known, ["source_ord", "idx"], "left").where("known is null or path < known").drop("known"))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("source_ord", "idx").agg(F.min("path").alias("path")))
    keyed = best.withColumns({"post": F.concat("path", F.array(F.lit(LAST))), "block": F.floor(F.get("path", F.lit(0)) / 256)})
    return ordered_scan(keyed, ["source_ord"], "block", ["post"], count="ordinal").select("source_ord", "idx", "ordinal")


def with_context(sentences: DataFrame, key: str = "doc_id", least: int = CONTEXT_WORDS) -> DataFrame:
    """``sentences`` (key, sent, sentence) with before and after: the neighbours that bring a short one to ``least`` words.

    Neighbours are added in turn, the one before first, and from one side where the other has no more. Every neighbour
    has a word at least, so that no more than ``least`` of either side are ever looked at.
    """
    size = F.size(F.filter(F.split("sentence", r"[\s\p{Z}]+"), lambda w: w != ""))
    rows = sentences.withColumn("n", size).where("n > 0")
    order = Window.partitionBy(key).orderBy("sent")
    item = F.struct("sentence", "n")
    rows = rows.withColumns({
        "behind": F.reverse(F.collect_list(item).over(order.rowsBetween(-least, -1))), "ahead": F.collect_list(item).over(order.rowsBetween(1, least)),
    })
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("a"), F.col("n").alias("words"))

    def take(state, _):
        more_b, more_a = state["b"] < F.size("behind"), state["a"] < F.size("ahead")
        back = more_b & ((state["b"] <= state["a"]) | ~more_a)
        words = F.when(back, F.get("behind", state["b"])["n"]).otherwise(F.get("ahead", state["a"])["n"])
        on = (state["words"] < least) & (more_b | more_a)
        return F.when(on, F.struct((state["b"] + back.cast("int")).alias("b"), (state["a"] + (~back).cast("int")).alias("a"), (state["words"] + words).alias("words"))).otherwise(state)

    done = rows.withColumn("x", F.aggregate(F.sequence(F.lit(1), F.lit(2 * least)), start, take))
    text = lambda part: F.array_join(F.transform(part, lambda s: s["sentence"]), " ")
    return done.select(key, "sent", "sentence", text(F.reverse(F.slice("behind", F.lit(1), F.col("x.b")))).alias("before"), text(F.slice("ahead", F.lit(1), F.col("x.a"))).alias("after"))


def limited(terms: DataFrame, most: int) -> DataFrame:
    """The terms (source_ord, term, n_new) of each source until ``most`` new glosses are reached, the one that reaches it
    taken whole: a term stays if fewer than ``most`` glosses came before it."""
    rows = terms.withColumn("block", F.floor(F.col("term") / 512))
    counted = ordered_scan(rows, ["source_ord"], "block", ["term"], total={"upto": "n_new"})
    return counted.where(F.col("upto") - F.col("n_new") < most).drop("block", "upto")
