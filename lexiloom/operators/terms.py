"""Sentences, tokens and dictionary terms of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE_END = r"([.!?。！？…]+)[\s\p{Z}]+|\n[ \t]*\n"
NON_WORD = r"[^\p{L}\p{N}_]+"
CUT = "\x01"
LONGEST_RUN = 8
#: Titles of up to so many bytes, with so many for each row besides its texts, are broadcast; the size is summed up before.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 64


def sentences(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of each text by the plain rule: a run of closing marks before white space, or a blank line, ends one.

    Result: key, sent (0-based), sentence. Null texts have none; empty stretches are left out.
    """
    marked = F.regexp_replace(F.regexp_replace(F.col(text), r"\n[ \t]*\n", CUT), r"([.!?。！？…]+)[\s\p{Z}]+", f"$1{CUT}")
    parts = F.filter(F.transform(F.split(marked, CUT), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select(key, F.posexplode(parts).alias("sent", "sentence"))


def tokens(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lower-case words of sentences: key, sent, tok (0-based), word."""
    words = F.filter(F.split(F.lower(F.col("sentence")), NON_WORD), lambda w: w != "")
    return parts.select(key, "sent", F.posexplode(words).alias("tok", "word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """Distinct words."""
    return words.select("word").distinct()


def title_tokens(titles: DataFrame) -> DataFrame:
    """Distinct titles with their words: title, words, size."""
    split = F.filter(F.split(F.lower(F.col("title")), NON_WORD), lambda w: w != "")
    return titles.where("title is not null").select("title").distinct().withColumn("words", split).withColumn("n", F.size("words"))


def spelled(title: Column, joiner: str = "־") -> Column:
    """A title as a text could spell it: without the mark that binds a morpheme, in lower case."""
    return F.lower(F.rtrim(title, F.lit(joiner)))


def title_words(titles: DataFrame, vocab: DataFrame) -> DataFrame:
    """Titles that are one word of the vocabulary."""
    return titles.withColumn("word", spelled(F.col("title"))).join(vocab, "word", "left_semi").select("title").distinct()


def reachable_titles(titles: DataFrame, vocab: DataFrame) -> DataFrame:
    """Titles of which every part between spaces is in the vocabulary, whole or by all its chunks of letters.

    Relational division: parts are looked up by an equi-join and counted per title.
    """
    parts = titles.select("title").distinct().select("title", F.posexplode(F.filter(F.split(F.lower("title"), r"[\s\p{Z}]+"), lambda p: p != "")).alias("at", "part"))
    chunks = parts.withColumn("chunk", F.explode(F.concat(F.array("part"), F.filter(F.split("part", NON_WORD), lambda c: c != ""))))
    hit = chunks.join(vocab.select(F.col("word").alias("chunk")).withColumn("hit", F.lit(1)), "chunk", "left")
    per_part = hit.groupBy("title", "at", "part").agg(
        F.max(F.when(F.col("chunk") == F.col("part"), F.col("hit"))).alias("whole"),
        F.count_if((F.col("chunk") != F.col("part")) & F.col("hit").isNotNull()).alias("found"),
        F.count_if(F.col("chunk") != F.col("part")).alias("chunks"),
    )
    ok = F.col("whole").isNotNull() | ((F.col("chunks") > 0) & (F.col("found") == F.col("chunks")))
    return per_part.groupBy("title").agg(F.every(ok).alias("ok")).where("ok").select("title")


def token_runs(words: DataFrame, key: str = "doc_id", longest: int = LONGEST_RUN) -> DataFrame:
    """Spellings of two to ``longest`` adjacent tokens without spaces: key, sent, tok, n, run."""
    place = Window.partitionBy(key, "sent").orderBy("tok")
    ahead = F.collect_list("word").over(place.rowsBetween(0, longest - 1))
    rows = words.withColumn("ahead", ahead)
    sizes = F.filter(F.sequence(F.lit(2), F.lit(longest)), lambda n: n <= F.size("ahead"))
    return rows.select(key, "sent", "tok", "ahead", F.explode(sizes).alias("n")).select(
        key, "sent", "tok", "n", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), "").alias("run")
    )


def spelled_titles(titles: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct titles that are spelled as a run of tokens (see ``token_runs``): title.

    Both sides are shuffled by their spelling. The planner takes the runs, of which every token has several, for smaller
    than the texts' files and would send all of them to the driver. A semi join would be moved below the titles' union and
    the runs made twice; both sides are distinct, so that an inner join has the same rows.
    """
    listed, spellings = titles.select("title").distinct(), runs.select(F.col("run").alias("title")).distinct()
    return listed.join(spellings.hint("merge"), "title")


def matches(parts: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Titles of any number of words found as adjacent tokens of sentences (key, sent, sentence): key, sent, first, last,
    title.

    Every stretch of adjacent words that has as many words as some title is looked up whole, by an equi-join, so that a
    common first word brings no candidates. The numbers of words that titles have are few and gathered; stretches are
    made where sentences are scanned, without a shuffle. Nothing matches a title without a word.
    """
    listed = title_tokens(titles).where("n > 0").select("title", "n", F.array_join("words", " ").alias("gram"))
    told = listed.groupBy("n").agg(F.sum(F.octet_length("title") + F.octet_length("gram") + ROW_BYTES).alias("bytes")).collect()
    sizes = sorted(r.n for r in told)
    # A title list whose size was found to be small goes to the sentences, so that no stretch is shuffled.
    small = sum(r.bytes for r in told) <= BROADCAST_BYTES
    words = F.filter(F.split(F.lower(F.col("sentence")), NON_WORD), lambda w: w != "")
    rows = parts.select(key, "sent", words.alias("words"))
    at = lambda n: F.transform(
        F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("first"), (i + n - 1).alias("last"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("gram")),
    )
    stretches = F.explode(F.flatten(F.array(*[at(n) for n in sizes or [1]]))).alias("x")
    return rows.select(key, "sent", stretches).select(key, "sent", "x.*").join(F.broadcast(listed.drop("n")) if small else listed.drop("n"), "gram").select(key, "sent", "first", "last", "title")


def maximal(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches that no match of more tokens in their sentence contains; equal stretches stay.

    Intervals of one sentence: one contains another if it starts no later and ends no earlier, so that running extremes
    over the sentence's matches decide without comparing all pairs. Titles of one stretch travel together, and one
    partitioning by key serves all steps.
    """
    order = Window.partitionBy(key, "sent").orderBy("first", F.desc("last"))
    spans = found.repartition(key).groupBy(key, "sent", "first", "last").agg(F.collect_list("title").alias("titles"))
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = spans.withColumn("reach", reach).where("reach is null or reach < last")
    return kept.select(key, "sent", "first", "last", F.explode("titles").alias("title"))


def term_groups(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches by the tokens they cover: key, sent, first, last, titles (sorted)."""
    return found.groupBy(key, "sent", "first", "last").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def uncovered_runs(words: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of adjacent tokens that no match covers, numbers left out: key, sent, first, last, run."""
    covered = found.select(key, "sent", F.explode(F.sequence("first", "last")).alias("tok")).distinct()
    bare = words.join(covered, [key, "sent", "tok"], "left_anti").where(~F.col("word").rlike(r"^\p{Nd}+$"))
    island = F.col("tok") - F.row_number().over(Window.partitionBy(key, "sent").orderBy("tok"))
    grouped = bare.withColumn("island", island).groupBy(key, "sent", "island")
    ordered = F.array_sort(F.collect_list(F.struct("tok", "word")))
    return grouped.agg(
        F.min("tok").alias("first"), F.max("tok").alias("last"), F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("run")
    ).drop("island")


def first_by_surface(terms: DataFrame, group: list[str], surface: str, order: list[str]) -> DataFrame:
    """The first row of each surface in a group."""
    place = Window.partitionBy(*group, surface).orderBy(*order)
    return terms.withColumn("nth", F.row_number().over(place)).where("nth = 1").drop("nth")
