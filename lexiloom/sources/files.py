"""Source files of any kind: which kind a file is, and its text or lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.cues import HEADER, TIMING, lines_of


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files under ``path``, each whole: name, text (UTF-8, a mark of the byte order gone)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def kind_of(name: Column, text: Column) -> Column:
    """'cues' or 'text': by the name's ending, or for names that don't tell by what stands in the first forty lines."""
    head = F.slice(F.split(text, r"\r\n?|\n"), 1, 40)
    sniffed = F.exists(head, lambda x: x.rlike(TIMING)) | F.coalesce(F.get(head, F.lit(0)).rlike(HEADER), F.lit(False))
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending.isin("srt", "vtt"), "cues").when(ending.isin("txt", "md"), "text").otherwise(F.when(sniffed, "cues").otherwise("text"))


def sources(files: DataFrame) -> DataFrame:
    """Files (name, text) as sources: name (which gives their order), kind, text without white space around it."""
    return files.select("name", kind_of(F.col("name"), F.col("text")).alias("kind"), F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("text"))


def cue_lines(rows: DataFrame, key: str = "name") -> DataFrame:
    """The lines of the sources that are cue files: key, line_no, line."""
    return lines_of(rows.where("kind = 'cues'"), key)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles of a list with one a line, plain or gzip: title, its underscores as spaces, empty lines left out.

    A gzip file is read by one task; the titles are spread right after it.
    """
    rows = spark.read.text(path).select(F.translate(F.trim("value"), "_", " ").alias("title")).where("title <> ''")
    return rows.repartition("title")


def read_dump_pages(spark: SparkSession, path: str, denied: tuple[str, ...] = ("flow-board",)) -> DataFrame:
    """Pages of an XML dump whose content model isn't ``denied``: title, model, text."""
    rows = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<model: string, text: string>").load(path)
    return rows.select("title", "revision.model", "revision.text").where(~F.coalesce(F.col("model"), F.lit("")).isin(*denied))


def missing_pages(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted pages (title, edition) that the table of stored ones doesn't have: what a fetcher has to ask for."""
    return wanted.select("title", "edition").where("title is not null").distinct().join(stored.select("title", "edition"), ["title", "edition"], "left_anti")


def with_fetched(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """The table of pages (title, edition, html) with those fetched; failures that pass aren't kept, nor are known ones."""
    transient = F.col("html").isNull() | F.lower("html").rlike("the time allocated for running (?:lua modules|scripts) has expired")
    fresh = fetched.where(~transient).dropDuplicates(["title", "edition"]).join(stored.select("title", "edition"), ["title", "edition"], "left_anti")
    return stored.select("title", "edition", "html").unionByName(fresh.select("title", "edition", "html"))


def archive_title(metadata: Column) -> Column:
    """The title of a volume from its metadata: series and volume, or the title alone."""
    part = lambda n: F.get_json_object(metadata, f"$.{n}")
    both = F.concat_ws(" ", part("series"), part("volume"))
    return F.when(both != "", both).otherwise(part("title"))
