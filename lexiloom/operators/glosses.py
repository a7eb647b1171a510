"""Glosses, their pages and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import is_marked, leading_qualifier


def records(glosses: DataFrame) -> DataFrame:
    """One row for each gloss, whichever delivery."""
    return glosses.dropDuplicates(["gloss_id"])


def deduplicated(glosses: DataFrame) -> DataFrame:
    """The first gloss of each surface and definition in a source."""
    place = Window.partitionBy("source_ord", "surface", "definition").orderBy("idx")
    return records(glosses).withColumn("nth", F.row_number().over(place)).where("nth = 1").drop("nth")


def unknown(glosses: DataFrame, deck: DataFrame) -> DataFrame:
    """Glosses whose key no card of the source's deck has."""
    known = deck.where("gloss_key is not null").select("source_ord", "gloss_key").distinct()
    return records(glosses).join(known, ["source_ord", "gloss_key"], "left_anti")


def pages(glosses: DataFrame) -> DataFrame:
    """Pages: an entry of a source with its number of senses, of word senses, and its first gloss.

    A sense with production is a word sense; a page without any keeps all of its senses.
    """
    return records(glosses).groupBy("source_ord", "entry").agg(
        F.count(F.lit(1)).alias("n_senses"), F.count_if("production").alias("n_word"), F.min("idx").alias("first_idx")
    )


def word_senses(glosses: DataFrame) -> DataFrame:
    """The senses a page's word is taught by: source_ord, entry, idx."""
    rows = records(glosses).select("source_ord", "entry", "idx", "production")
    any_word = F.max(F.coalesce("production", F.lit(False))).over(Window.partitionBy("source_ord", "entry"))
    return rows.withColumn("any", any_word).where("production or not any").select("source_ord", "entry", "idx")


def first_pages(glosses: DataFrame) -> DataFrame:
    """For each gloss the first of its candidate titles (surface, lemma, entry) that has a page."""
    rows = records(glosses).select("gloss_id", "source_ord", F.posexplode(F.array("surface", "lemma", "entry")).alias("ord", "title"))
    listed = records(glosses).select("source_ord", F.col("entry").alias("title")).distinct()
    return rows.join(listed, ["source_ord", "title"]).groupBy("gloss_id").agg(F.min_by("title", "ord").alias("page"))


def candidate_pages(glosses: DataFrame) -> DataFrame:
    """For each gloss the pages of its own spelling, else its first page: gloss_id, page."""
    listed = records(glosses).select("source_ord", F.col("entry").alias("page")).distinct()
    own = records(glosses).select("gloss_id", "source_ord", F.col("surface").alias("page")).join(listed, ["source_ord", "page"])
    rest = first_pages(glosses).join(own.select("gloss_id"), "gloss_id", "left_anti")
    return own.select("gloss_id", "page").unionByName(rest.select("gloss_id", "page"))


def winners(glosses: DataFrame) -> DataFrame:
    """For each lemma of a source the entry with most senses, the earliest where several have as many."""
    counts = records(glosses).where("lemma is not null").groupBy("source_ord", "lemma", "entry").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx")
    )
    return counts.groupBy("source_ord", "lemma").agg(F.min_by("entry", F.struct(-F.col("n"), "first_idx")).alias("page"), F.max("n").alias("n"))


def plain_dependencies(glosses: DataFrame) -> DataFrame:
    """Edges from each marked sense to the first plain sense of its entry that stands before it: source_ord, idx, dep."""
    rows = records(glosses).where("entry is not null and definition is not null").select("source_ord", "entry", "idx", is_marked(F.col("definition")).alias("marked"))
    place = Window.partitionBy("source_ord", "entry").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.first(F.when(~F.col("marked"), F.col("idx")), ignorenulls=True).over(place)
    return rows.withColumn("dep", plain).where("marked and dep is not null").select("source_ord", "idx", "dep")


def form_dependencies(glosses: DataFrame) -> DataFrame:
    """Edges from each form to the first gloss whose surface is its entry and that stands before it."""
    rows = records(glosses).select("source_ord", "idx", "surface", "entry")
    base = rows.groupBy("source_ord", F.col("surface").alias("entry")).agg(F.min("idx").alias("dep"))
    return rows.where("surface <> entry").join(base, ["source_ord", "entry"]).where("dep < idx").select("source_ord", "idx", "dep")


def merged_dependencies(glosses: DataFrame) -> DataFrame:
    """Each gloss's dependencies, stored ones first, then plain senses and bases, none twice: gloss_id, deps."""
    more = plain_dependencies(glosses).withColumn("kind", F.lit(1)).unionByName(form_dependencies(glosses).withColumn("kind", F.lit(2)))
    extra = more.groupBy("source_ord", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "dep"))), lambda x: x["dep"]).alias("extra"))
    rows = records(glosses).join(extra, ["source_ord", "idx"], "left")
    both = F.concat(F.coalesce("depends_on", F.array().cast("array<int>")), F.coalesce("extra", F.array().cast("array<int>")))
    return rows.select("gloss_id", F.array_distinct(both).alias("deps"))


def labels(glosses: DataFrame) -> DataFrame:
    """The labels of each definition's qualifier as concepts: gloss_id, label."""
    inner = F.btrim(leading_qualifier(F.col("definition")), F.lit("()"))
    split = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return records(glosses).where("definition is not null").select("source_ord", "gloss_id", "idx", F.explode(split).alias("label"))
