"""Cards of glosses, and decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import fronted, masked_anywhere
from lexiloom.operators.glosses import records
from lexiloom.operators.sequence import ordered_scan


def cards(glosses: DataFrame) -> DataFrame:
    """Recognition and, where a gloss asks for it, production cards: source_ord, idx, kind, front, back.

    A recognition card asks for the definition of the fronted surface, a production card for the surface, which its
    definition doesn't show.
    """
    surface, definition = F.col("surface"), F.coalesce(F.col("definition"), F.lit(""))
    recognition = F.struct(F.lit("recognition").alias("kind"), fronted(surface, F.col("definition")).alias("front"), definition.alias("back"))
    production = F.struct(F.lit("production").alias("kind"), masked_anywhere(definition, surface).alias("front"), surface.alias("back"))
    made = F.when(F.coalesce("production", F.lit(False)), F.array(recognition, production)).otherwise(F.array(recognition))
    return records(glosses).select("source_ord", "idx", F.explode(made).alias("c")).select("source_ord", "idx", "c.*")


def card_dependencies(glosses: DataFrame, edges: DataFrame) -> DataFrame:
    """What each card waits for: a recognition card for those of its gloss's dependencies, a production card for its own
    gloss's: source_ord, idx, kind, dep. Edges to later glosses count too."""
    rows = records(glosses).select("source_ord", "idx", "production")
    known = rows.select("source_ord", F.col("idx").alias("dep"))
    recognition = edges.join(rows.select("source_ord", "idx"), ["source_ord", "idx"], "left_semi").join(known, ["source_ord", "dep"], "left_semi")
    production = rows.where("production").select("source_ord", "idx", F.lit("production").alias("kind"), F.col("idx").alias("dep"))
    return recognition.select("source_ord", "idx", F.lit("recognition").alias("kind"), "dep").unionByName(production)


def places(deck: DataFrame) -> DataFrame:
    """Cards in the order they are studied: card_id, source_ord, gloss_key, kind, studied, position.

    Unstudied cards of a source are ranked by due and id; a studied one is at 0.
    """
    new = deck.where("card_type = 0").withColumn("block", F.floor(F.coalesce("due", F.lit(-1)) / 256))
    ranked = ordered_scan(new, ["source_ord"], "block", ["due", "card_id"], count="position")
    kept = ["card_id", "source_ord", "gloss_key", "kind"]
    unseen = ranked.select(*kept, F.lit(False).alias("studied"), "position")
    seen = deck.where("card_type <> 0").select(*kept, F.lit(True).alias("studied"), F.lit(0).cast("long").alias("position"))
    return unseen.unionByName(seen)


def positions(deck: DataFrame) -> DataFrame:
    """How far into each source's deck a key has been taught by: its last recognition card."""
    rows = places(deck).where("gloss_key is not null and kind = 'recognition'")
    return rows.groupBy("source_ord", "gloss_key").agg(F.max("position").alias("position"))


def taught(deck: DataFrame) -> DataFrame:
    """Keys with a card that has been studied."""
    return deck.where("card_type <> 0 and gloss_key is not null").select("source_ord", "gloss_key").distinct()


def last_positions(deck: DataFrame) -> DataFrame:
    """Per source the last due number among unstudied cards, 0 without any."""
    return deck.groupBy("source_ord").agg(F.coalesce(F.max(F.when(F.col("card_type") == 0, F.col("due"))), F.lit(0)).alias("last_due"))


def carried(glosses: DataFrame, deck: DataFrame) -> DataFrame:
    """New cards with the id of the card they replace, the first of the same kind and key: source_ord, idx, kind, card_id."""
    old = deck.where("gloss_key is not null").groupBy("source_ord", "gloss_key", "kind").agg(F.min("card_id").alias("card_id"))
    keyed = cards(glosses).join(records(glosses).select("source_ord", "idx", "gloss_key"), ["source_ord", "idx"])
    return keyed.join(old, ["source_ord", "gloss_key", "kind"], "left").select("source_ord", "idx", "kind", "card_id")


def told_apart(rows: DataFrame, title: str, english: str) -> DataFrame:
    """``title``, or ``english`` where the title stands for several English ones of a source."""
    group = Window.partitionBy("source_ord", title)
    clash = F.min(english).over(group) != F.max(english).over(group)
    return rows.withColumn("shown", F.when(clash, F.col(english)).otherwise(F.col(title)))
