"""Readings of words and characters, quotations of a word, and symbols of a script."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from lexiloom.functions.script import displayed
from lexiloom.functions.text import MASK

#: Where in a term a character stands.
ANYWHERE, AT_START, AT_END, WHOLE = "anywhere", "start", "end", "whole"
# The languages that lend a Han character a definition, in order.
HAN_SOURCES = ("Chinese", "Korean", "Vietnamese")
KANJI = r"[㐀-䶿一-鿿々]"
KANA = r"^[ぁ-ゟ゠-ヿ]+$"


def bare(reading: Column) -> Column:
    """A transcription's sounds: without delimiters, stress marks and spaces."""
    return F.regexp_replace(F.btrim(reading, F.lit("[]/ ")), "[ˈˌ ]", "")


def place_of(term: Column, char: Column) -> Column:
    """Where ``char`` stands in ``term``; anywhere if it comes several times or not at all."""
    times = F.length(term) - F.length(F.replace(term, char, F.lit("")))
    return F.when(times != 1, ANYWHERE).when(F.length(term) == 1, WHOLE).when(F.startswith(term, char), AT_START).when(F.endswith(term, char), AT_END).otherwise(ANYWHERE)


def contains_sound(reading: str, word: str, where: str) -> bool:
    """Whether ``reading`` stands in ``word``, where it has to, without cutting a sound from its combining marks."""
    if where == WHOLE:
        return reading == word
    ends = {len(word)} if where == AT_END else range(len(reading), len(word) + 1)
    for end in ends:
        begin = end - len(reading)
        if begin < 0 or where == AT_START and begin or word[begin:end] != reading:
            continue
        if not any(at < len(word) and unicodedata.combining(word[at]) for at in (begin, end)):
            return True
    return False


@F.pandas_udf(BooleanType())
def is_inside(reading: pd.Series, word: pd.Series, where: pd.Series) -> pd.Series:
    """Whether each bare reading is one of the sounds of a word (see ``contains_sound``); null for nulls."""
    return pd.Series([None if r is None or w is None else bool(r) and contains_sound(r, w, p or ANYWHERE) for r, w, p in zip(reading, word, where, strict=True)])


def read_as(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block whose reading the word uses: ask_id, entry_ord, reading.

    ``asked`` has (ask_id, title, readings, place: of the character in the word), ``blocks`` (title, entry_ord, ipa) in
    the page's order. Of a page's readings that stand in one of the word's the longest wins, the first of several.
    """
    sounds = asked.select("ask_id", "title", "place", F.explode("readings").alias("word")).withColumn("word", bare(F.col("word")))
    own = blocks.select("title", "entry_ord", F.posexplode("ipa").alias("at", "reading")).withColumn("reading", bare(F.col("reading"))).where("reading <> ''")
    hit = sounds.join(own, "title").where(is_inside("reading", "word", "place"))
    best = F.struct(-F.length("reading"), F.col("entry_ord"), F.col("at"))
    return hit.groupBy("ask_id").agg(F.min_by(F.struct("entry_ord", "reading"), best).alias("m")).select("ask_id", "m.entry_ord", "m.reading")


def as_used(lines: Column, headword: Column) -> Column:
    """A list of a character's readings cut to the line with the romanization that a headword names; else the whole list."""
    said = F.btrim(F.regexp_extract(headword, r"\(([^()]*)\)", 1), F.lit(" -‐‑"))
    one = F.concat(F.lit(r"[^\s、,()]+\s*\(\s*\Q"), said, F.lit(r"\E\s*(?:,[^()]*)?\)"))
    label = lambda x: F.when(F.instr(x, ":") > 0, F.concat(F.trim(F.substring_index(x, ":", 1)), F.lit(": "))).otherwise(F.lit(""))
    rest = lambda x: F.when(F.instr(x, ":") > 0, F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise(x)
    hits = F.filter(F.transform(lines, lambda x: F.struct(label(x).alias("l"), F.coalesce(F.regexp_substr(rest(x), one), F.lit("")).alias("r"))), lambda h: h["r"] != "")
    first = F.get(hits, F.lit(0))
    return F.when((F.size(lines) > 1) & (said != "") & (F.size(hits) > 0), F.array(F.concat(first["l"], first["r"]))).otherwise(lines)


@F.pandas_udf(ArrayType(StringType()))
def quotations(quoted: pd.Series, answer: pd.Series) -> pd.Series:
    """Which quotations are the answer, as they stand: equal, or equal once composed and freed of marks left over."""

    def freed(text: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFC", text) if not unicodedata.combining(c))

    return pd.Series([None if q is None else [x for x in q if x is not None and a is not None and a in (x, freed(x))] for q, a in zip(quoted, answer, strict=True)])


def masked_quotations(definition: Column, found: Column) -> Column:
    """A definition with the quotations of its own word blanked where they stand as words, the longest first."""
    longest = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    edge = lambda p, look: F.when(p.rlike(r"^[\p{L}\p{N}_]" if look == "<!" else r"[\p{L}\p{N}_]$"), F.lit(rf"(?{look}[\p{{L}}\p{{N}}_])")).otherwise(F.lit(""))
    put = lambda text, q: F.regexp_replace(text, F.concat(edge(q, "<!"), F.lit(r"\Q"), q, F.lit(r"\E"), edge(q, "!")), F.lit(MASK))
    return F.aggregate(F.filter(longest, lambda q: q != ""), definition, put)


def asked_definition(definition: Column, answer: Column, found: Column, foreign: Column, prefix: Column) -> Column:
    """What a production card asks: the definition without its answer, after the title's prefix, if any.

    An answer in a script that the reader doesn't read is blanked wherever it stands; one in the reader's own script only
    where the page quotes it.
    """
    blind = F.when(answer == "", definition).otherwise(F.replace(definition, answer, F.lit(MASK)))
    hidden = F.when(foreign, blind).otherwise(masked_quotations(definition, found))
    return F.when(F.coalesce(prefix, F.lit("")) == "", hidden).otherwise(F.concat(prefix, F.lit(" "), hidden))


def equivalents(gloss_language: Column, edition_language: str, title_prefix: Column, answer: Column) -> Column:
    """The mother tongue's word on a card: of words of the edition's own language only, not of cards that aren't words."""
    plain = F.coalesce(title_prefix, F.lit("")) == ""
    return F.when(plain & (gloss_language == edition_language), F.coalesce(answer, F.lit(""))).otherwise(F.lit(""))


def rejected_kana(titles: DataFrame, spellings: DataFrame, ends: DataFrame) -> DataFrame:
    """Kana titles that are only the reading of another word: title, spelling.

    ``spellings`` (title, sense_ord, spelling: null for none) are those a page names for its senses, ``ends`` (text, read:
    where the words of a text, or of a title read aloud, end). A title is a word if a sense names no spelling with a
    character, or if a named one is read as long and its words' ends take in the title's.
    """
    kana = titles.where(F.col("title").rlike(KANA)).select("title").distinct()
    groups = spellings.join(kana, "title").withColumn("written", F.when(F.col("spelling").rlike(KANJI), F.col("spelling")))
    per_sense = groups.groupBy("title", "sense_ord").agg(F.count("written").alias("n"))
    own = per_sense.groupBy("title").agg(F.min("n").alias("least")).where("least = 0").select("title")
    read = ends.select("text", "read").dropDuplicates(["text"])
    named = groups.where("written is not null").join(read.select(F.col("text").alias("title"), F.col("read").alias("own_ends")), "title", "left")
    named = named.join(read.select(F.col("text").alias("written"), "read"), "written", "left")
    fits = (F.element_at(F.filter("read", lambda i: i.isNotNull()), -1) == F.length("title")) & (F.size(F.array_except(F.coalesce("own_ends", F.array().cast("array<int>")), "read")) == 0)
    words = named.where(F.coalesce(F.size("read") > 0, F.lit(False)) & fits).select("title").distinct()
    first = named.groupBy("title").agg(F.min_by("written", F.struct("sense_ord", "written")).alias("spelling"))
    return first.join(own, "title", "left_anti").join(words, "title", "left_anti")


def symbol_definitions(chars: DataFrame, senses: DataFrame, names: DataFrame, language: str) -> DataFrame:
    """The definition that each foreign character (char) gets, and where from: char, surface, definition, way.

    ``senses`` (title, language, part_of_speech, definition, place) are those about shapes: the language's own section
    first, then Translingual, then the languages that lend Han characters, in order; the character database's name
    (``names``: char, name) is the last resort.
    """
    order = {language: 0, "Translingual": 1} | {name: i + 2 for i, name in enumerate(HAN_SOURCES) if name != language}
    rank = F.coalesce(*[F.when(F.col("language") == name, F.lit(i)) for name, i in order.items()])
    met = chars.select("char").distinct().join(senses.withColumnRenamed("title", "char").withColumn("rank", rank).where("rank is not null"), "char", "left")
    best = met.groupBy("char").agg(F.min_by(F.struct("definition", "rank"), F.struct(F.coalesce("rank", F.lit(99)), "place")).alias("m"))
    rows = best.join(names.select("char", "name"), "char", "left")
    ways = F.create_map(*[x for name, i in order.items() for x in (F.lit(i), F.lit(name))])
    return rows.select("char", F.concat(F.lit("Symbol: "), displayed(F.col("char"))).alias("surface"), F.coalesce("m.definition", "name").alias("definition"), F.coalesce(F.try_element_at(ways, F.col("m.rank")), F.lit("name")).alias("way"))


def folded_symbols(glosses: DataFrame) -> DataFrame:
    """Pairs of a symbol's gloss and the word's that takes its place: source_ord, idx (the place kept), word_idx.

    ``glosses`` have (source_ord, idx, char: of a symbol's gloss, surface, language, definition, way). A Han character's
    card and the card of the word of that one character are one if they say the same, or if the symbol's comes from
    elsewhere than the word's language.
    """
    symbols = glosses.where(F.col("char").rlike(KANJI)).select("source_ord", "idx", F.col("char").alias("surface"), F.col("definition").alias("told"), "way")
    words = glosses.where("char is null and length(surface) = 1").select("source_ord", F.col("idx").alias("word_idx"), "surface", "language", "definition")
    same = (F.col("told") == F.col("definition")) | (F.col("way") != F.col("language"))
    return symbols.join(words, ["source_ord", "surface"]).where(same).groupBy("source_ord", "idx").agg(F.min("word_idx").alias("word_idx"))


def backward_edges(folded: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (source_ord, idx, dep) with those of folded words on the place that stays, and a word that waits for its
    character's later card (source_ord, idx, dep with dep > idx allowed); none on itself, each once."""
    moved = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
    to = lambda c: folded.select("source_ord", F.col("word_idx").alias(c), F.col("idx").alias(f"_{c}"))
    rows = edges.join(to("idx"), ["source_ord", "idx"], "left").join(to("dep"), ["source_ord", "dep"], "left")
    return rows.select("source_ord", moved("idx"), moved("dep")).where("idx <> dep").distinct()


def document_name(first: Column, others: Column) -> Column:
    """What a deck's file is called: the first source's name without its format, and how many follow."""
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(first, "/", -1), r"\.[^.]+$", ""), r"(?i)\.(?:mbz|cbz)$", "")
    return F.when(others == 0, stem).otherwise(F.concat(stem, F.lit("+"), others.cast("string")))


def utterances(parts: Column) -> Column:
    """Sentences one a line, empty ones left out."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")
