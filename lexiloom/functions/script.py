"""Scripts of characters, from their Unicode names."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The words in character names that name a script, and scripts that write words without spaces.
SCRIPTS = frozenset(
    "LATIN GREEK COPTIC CYRILLIC ARMENIAN HEBREW ARABIC SYRIAC THAANA NKO SAMARITAN DEVANAGARI BENGALI GURMUKHI GUJARATI"
    " ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR GEORGIAN ETHIOPIC CHEROKEE CANADIAN OGHAM"
    " RUNIC KHMER MONGOLIAN HIRAGANA KATAKANA BOPOMOFO HANGUL CJK KANGXI YI VAI GOTHIC DESERET OSAGE ADLAM TIFINAGH"
    " JAVANESE BALINESE CHAM TAGALOG".split()
)
#: What a combining mark stands on when it's shown alone.
CARRIER = "\u25cc"
UNSPACED = frozenset({"CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER"})
#: A text is unreadable if so much of its writing is in other scripts; a script of less isn't named.
ENOUGH, WORTH_NAMING = 0.1, 0.01


def script_of(char: str) -> str:
    """The first word of the character's name that names a script, or the empty text."""
    words = unicodedata.name(char, "").replace("-", " ").split()
    return next((w for w in words if w in SCRIPTS), "")


@cache
def script_ranges() -> list[tuple[int, int, str]]:
    """Ranges of code points of one script: (first, last, script)."""
    found: list[tuple[int, int, str]] = []
    for code in range(0x41, 0x323B0):
        name = script_of(chr(code))
        if not name:
            continue
        if found and found[-1][1] == code - 1 and found[-1][2] == name:
            found[-1] = (found[-1][0], code, name)
        else:
            found.append((code, code, name))
    return found


def script_table(spark: SparkSession) -> DataFrame:
    """Characters of the scripts: a table of fixed size (char, script)."""
    ranges = spark.createDataFrame(script_ranges(), "low int, high int, script string")
    return ranges.select(F.explode(F.sequence("low", "high")).alias("code"), "script").select(F.col("code").alias("code"), "script")


def script_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Characters of each script in each text: key, script, n.

    Characters are counted where texts are scanned, and each distinct one is looked up once a batch; one row for each
    text and script is shuffled, to sum the rows of a key that comes several times. Null texts have no characters;
    characters of no script, and marks, aren't counted.
    """
    kind = texts.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            keys, scripts, numbers = [], [], []
            for number, value in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found: dict[str, int] = {}
                for char, n in Counter(value or "").items():
                    name = known.get(char)
                    if name is None:
                        name = known[char] = script_of(char)
                    if name:
                        found[name] = found.get(name, 0) + n
                keys += [number] * len(found)
                scripts += found
                numbers += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(scripts, pa.string()), pa.array(numbers, pa.int64())], names=[key, "script", "n"])

    counted = texts.select(key, text).mapInArrow(count, f"`{key}` {kind.simpleString()}, script string, n bigint")
    return counted.groupBy(key, "script").agg(F.sum("n").alias("n"))


def unreadable(texts: DataFrame, key: str, reads: tuple[str, ...] = ("LATIN",), text: str = "text") -> DataFrame:
    """Scripts that make a text unreadable for one who reads ``reads``: key, script, n, rank (the commonest first)."""
    counts = script_counts(texts, key, text)
    whole = Window.partitionBy(key)
    known = F.col("script").isin(*reads)
    full = counts.withColumns({"written": F.sum("n").over(whole), "other": F.sum(F.when(known, 0).otherwise(F.col("n"))).over(whole)})
    rows = full.where(~known & (F.col("other") >= F.lit(ENOUGH) * F.col("written")) & (F.col("n") >= F.lit(WORTH_NAMING) * F.col("written")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "script"))
    return rows.select(key, "script", "n", rank.cast("int").alias("rank"))


def foreign_characters(texts: DataFrame, key: str, text: str, reads: tuple[str, ...] = ("LATIN",)) -> DataFrame:
    """Distinct characters of a term in scripts that aren't read, by where they first stand so: key, char, script, at.

    A combining mark without a script of its own has that of the character before it; one that opens a term has none.
    """
    letters = F.split(text, "")
    chars = texts.select(key, letters.alias("letters"), F.posexplode(letters).alias("at", "char")).where("char <> ''")
    before = F.when(F.col("char").rlike(r"^\p{M}$") & (F.col("at") > 0), F.get("letters", F.col("at") - 1))
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
    table = script_table(texts.sparkSession)
    coded = chars.select(key, "at", "char", code(F.col("char")).alias("code"), code(before).alias("code_before"))
    own = coded.join(table, "code", "left").join(table.select(F.col("code").alias("code_before"), F.col("script").alias("inherited")), "code_before", "left")
    named = own.withColumn("script", F.coalesce("script", "inherited")).where(F.col("script").isNotNull() & ~F.col("script").isin(*reads))
    return named.groupBy(key, "char").agg(F.min_by("script", "at").alias("script"), F.min("at").alias("at"))


def displayed(char: Column) -> Column:
    """A character as a card shows it alone: a mark on the carrier it stands on."""
    return F.when(char.rlike(r"^\p{M}$"), F.concat(F.lit(CARRIER), char)).otherwise(char)


def unicode_names(chars: DataFrame, char: str = "char") -> DataFrame:
    """``chars`` with the character database's name of ``char`` (``name``), or its code point."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unicodedata.name(c, f"U+{ord(c):04X}") if c else None for c in batch[char].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "name"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chars.schema.fields)
    return chars.mapInArrow(named, f"{fields}, name string")
