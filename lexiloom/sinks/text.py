"""JSON, CSV, text and Markdown forms of glosses, cards and timelines, as rows in order; files are written by tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import clock, listed, slug


def json_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each row as a JSON object (null fields too), with the columns of ``order``: order..., line."""
    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(*order, whole.alias("line"))


def timeline_csv(rows: DataFrame, group: str = "file_id") -> DataFrame:
    """Timeline rows as lines of a table with a fixed header: group, cutoff, line. Null numbers are empty, days have one
    decimal place."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    days = lambda c: F.coalesce(F.format_string("%.1f", F.col(c).cast("double")), F.lit(""))
    none = lambda c, x: F.when(F.col(c).isNull(), F.lit("")).otherwise(x)
    line = F.concat_ws(",", clock(F.col("cutoff")), number("n_met"), number("n_untaught"), number("cards"), none("days", days("days")), number("furthest"), none("furthest_days", days("furthest_days")))
    return rows.select(group, "cutoff", line.alias("line"))


CSV_HEADER = "at,met,untaught,cards,days,furthest,furthest_days"


def term_lines(terms: DataFrame) -> DataFrame:
    """Terms (source_ord, sent_ord, place, surface, titles) as lines: the surface and its entries."""
    shown = F.when(F.size("titles") > 0, listed(F.col("titles"))).otherwise(F.lit("no entry"))
    return terms.select("source_ord", "sent_ord", "place", F.concat("surface", F.lit(": "), shown).alias("line"))


def card_lines(cards: DataFrame) -> DataFrame:
    """Cards (source_ord, idx, kind, front, back) as lines."""
    return cards.select("source_ord", "idx", "kind", F.concat_ws(" | ", "kind", "front", "back").alias("line"))


def escaped(text: Column) -> Column:
    """``text`` with the characters that Markdown reads as marks escaped."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>#|])", r"\\$1")


def markdown(glosses: DataFrame) -> DataFrame:
    """Glosses (source_ord, idx, surface, definition, examples, depends_on) as Markdown: source_ord, idx, block.

    A heading, its definition, its examples as a list, and links to the headings of what it depends on. A heading that
    comes again in a source has its number behind its anchor, as readers number them.
    """
    again = F.row_number().over(Window.partitionBy("source_ord", "surface").orderBy("idx")) - 1
    anchor = slug(F.col("surface"))
    rows = glosses.withColumn("anchor", F.when(again > 0, F.concat(anchor, F.lit("-"), again.cast("string"))).otherwise(anchor))
    links = rows.select("source_ord", "idx", F.posexplode("depends_on").alias("at", "dep"))
    named = links.join(rows.select("source_ord", F.col("idx").alias("dep"), F.concat(F.lit("["), escaped(F.col("surface")), F.lit("](#"), "anchor", F.lit(")")).alias("link")), ["source_ord", "dep"])
    deps = named.groupBy("source_ord", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda x: x["link"]), ", ").alias("links"))
    example = lambda e: F.concat(F.lit("\n- "), escaped(e["sentence"]), F.coalesce(F.concat(F.lit(" — "), escaped(e["rendering"])), F.lit("")))
    body = F.concat(
        F.lit("## "), escaped(F.col("surface")), F.lit("\n\n"), F.coalesce(escaped(F.col("definition")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("examples", example), "")), F.lit("")), F.coalesce(F.concat(F.lit("\n\nSee "), "links"), F.lit("")),
    )
    return rows.join(deps, ["source_ord", "idx"], "left").select("source_ord", "idx", body.alias("block"))


def write_lines(rows: DataFrame, path: str, order: list[str], line: str = "line", header: str | None = None) -> None:
    """Lines in order as text files: sorted over all tasks, so that the files follow each other by name.

    A header stands in a file of its own before them.
    """
    ordered = rows.orderBy(*order).select(F.col(line).alias("value"))
    if header is not None:
        rows.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    ordered.write.mode("overwrite").text(f"{path}/lines" if header is not None else path)
