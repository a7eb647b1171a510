"""One consistent form for text that looks the same but is stored with different characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.arrow_sql import map_sql, spread

# Letters of other scripts and the Latin letters they can't be told from.
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝӏѵАВЕКМНОРСТУХЅІЈԚԜҮ", "aeopcyxsijhdqwlvABEKMHOPCTYXSIJQWY", strict=True))
GREEK = dict(zip("οϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ocjABEZHIKMNOPTYX", strict=True))
OTHER = dict(zip("ɑɡıօҺ", "agioh", strict=True))
# Kana and the characters they can't be told from.
KANA = dict(zip("エカニロハトタチオノヌーヘベペ", "工力二口八卜夕千才丿又一へべぺ", strict=True))
# Spaces other than U+0020, and ranges of characters that show nothing.
SPACES = "               　"
INVISIBLE = (
    "­͏؜ᅟ-ᅠ឴-឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ"
    "︀-️﻿ﾠ￰-￸\U000e0000-\U000e0fff"
)
MARKS = [chr(c) for c in range(0x300, 0x329)]


def invisible_codes() -> list[int]:
    """The code points of the ranges in ``INVISIBLE``."""
    found: list[int] = []
    at = 0
    while at < len(INVISIBLE):
        if INVISIBLE[at + 1 : at + 2] == "-":
            found += range(ord(INVISIBLE[at]), ord(INVISIBLE[at + 2]) + 1)
            at += 3
        else:
            found.append(ord(INVISIBLE[at]))
            at += 1
    return found


@cache
def width_forms() -> dict[str, str]:
    """Single characters for width forms and Kangxi radicals, from the compatibility decompositions."""
    found = {}
    for code in [*range(0x2F00, 0x2FD6), *range(0xFF01, 0xFFEF)]:
        char = chr(code)
        kind = unicodedata.decomposition(char).split(" ")[0]
        full = unicodedata.normalize("NFKC", char)
        if kind in ("<wide>", "<narrow>") or code < 0x2FE0:
            if len(full) == 1 and full != char and full not in INVISIBLE:
                found[char] = full
    return found


@cache
def ligatures() -> dict[str, str]:
    """Joined letters and the letters they join."""
    codes = [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)]
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in codes}


def accented(pairs: dict[str, str]) -> dict[str, str]:
    """``pairs`` and, for each accent that both letters have as one character, the accented pair."""
    out = dict(pairs)
    for a, b in pairs.items():
        for mark in MARKS:
            x, y = unicodedata.normalize("NFC", a + mark), unicodedata.normalize("NFC", b + mark)
            if len(x) == 1 and len(y) == 1:
                out[x] = y
    return out


def parted(pairs: dict[str, str]) -> dict[str, str]:
    """The accented letters of ``pairs`` that are one character in their own script only, with a separate accent."""
    out = {}
    for a, b in pairs.items():
        for mark in MARKS:
            x, y = unicodedata.normalize("NFC", a + mark), unicodedata.normalize("NFC", b + mark)
            if len(x) == 1 and len(y) == 2:
                out[x] = y
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def translated(expression: str, pairs: dict[str, str]) -> str:
    return f"translate({expression}, {quoted(''.join(pairs))}, {quoted(''.join(pairs.values()))})"


def replaced(expression: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        expression = f"replace({expression}, {quoted(a)}, {quoted(b)})"
    return expression


def guarded(condition: str, column: str, pairs: dict[str, str], change: Callable[[str, dict[str, str]], str]) -> str:
    """``change`` of ``column`` by ``pairs`` where it holds any of their characters."""
    return (
        f"CASE WHEN {condition} AND regexp_matches({column}, '[{''.join(pairs)}]') THEN {change(column, pairs)}"
        f" ELSE {column} END"
    )


def settled_steps(names: str, value: str, source: str = "") -> list[str]:
    """Selections, each over the one before, whose column c is ``value`` with width forms, ligatures, composed accents,
    spaces and invisible characters settled; wide tells whether it has any character beyond ASCII.

    translate() builds its table for every row, so that rows without any of the characters are told apart before.
    """
    singles = width_forms() | dict.fromkeys(SPACES, " ")
    return [
        f"SELECT {names}, {value}, strlen({value}) > length({value}) AS wide" + (f" FROM {source}" if source else ""),
        f"SELECT *, CASE WHEN wide THEN regexp_replace({value}, '[{INVISIBLE}]', '', 'g') ELSE {value} END AS a",
        f"SELECT *, {guarded('wide', 'a', singles, translated)} AS b",
        f"SELECT *, CASE WHEN wide THEN nfc_normalize({guarded('wide', 'b', ligatures(), replaced)}) ELSE b END AS c",
    ]


@cache
def form_sql(names: str, value: str, with_clean: bool = True) -> str:
    """The query that adds to ``names`` and ``value`` of table rows the value's clean form and its skeleton.

    The clean form has width forms, ligatures, accents, spaces and invisible characters settled and keeps the letters
    of its words' own script. The skeleton also has every look-alike letter replaced by one of its class, whichever
    script it stands in: values look the same exactly if their skeletons are equal.
    """
    apart = parted(CYRILLIC) | parted(GREEK)
    bare = CYRILLIC | GREEK | OTHER
    latin = {a: b for a, b in (accented(CYRILLIC) | accented(GREEK)).items() if a not in bare}
    # A word keeps the script of the letters that only this script has; h is the word with all look-alikes as Latin.
    to_cyrillic = {b: a for a, b in reversed(accented(CYRILLIC).items())}
    to_greek = {b: a for a, b in reversed(accented(GREEK).items())}
    word = (
        f"CASE WHEN regexp_matches(h, '\\p{{Cyrillic}}') THEN {translated('h', to_cyrillic)}"
        f" WHEN regexp_matches(h, '\\p{{Greek}}') THEN {translated('h', to_greek)} ELSE h END"
    )
    clean = (
        "CASE WHEN strange THEN array_to_string(list_transform(string_split(hub, ' '),"
        f" lambda h: {word}), ' ') ELSE c END"
    )
    steps = [
        *settled_steps(names, value, "rows"),
        f"SELECT *, wide AND regexp_matches(c, '[{''.join([*bare, *latin])}]') AS strange",
        f"SELECT *, {guarded('strange', 'c', apart, replaced)} AS d",
        f"SELECT *, {guarded('strange', 'd', latin, translated)} AS e",
        f"SELECT *, CASE WHEN strange THEN nfc_normalize({translated('e', bare)}) ELSE e END AS hub",
        f"SELECT {names}, {value}, {clean if with_clean else 'NULL'} AS clean,"
        f" {guarded('wide', 'hub', KANA, translated)} AS skeleton",
    ]
    query = steps[0]
    for step in steps[1:]:
        query = f"{step} FROM ({query})"
    return query


def with_forms(df: DataFrame, keep: str, value: str = "value") -> DataFrame:
    """``df``'s columns ``keep`` (a schema string) and ``value`` with its ``clean`` form and ``skeleton``.

    Null stays null and the empty text stays empty. Line breaks, the number of spaces, case, accents, hyphens,
    superscript and circled digits and punctuation marks stay as they are; texts of any length are taken whole.
    """
    names = [part.split()[0] for part in keep.split(",")]
    query = form_sql(", ".join(f'"{n}"' for n in names), f'"{value}"')
    return map_sql(df.select(*names, value), query, f"{keep}, {value} string, clean string, skeleton string")


def values(glosses: DataFrame, cues: DataFrame) -> DataFrame:
    """Every surface, lemma and cue text that isn't null or blank as (field, scope, id, value)."""
    fields = F.explode(
        F.array(
            F.struct(F.lit("surface").alias("field"), F.col("surface").alias("value")),
            F.struct(F.lit("lemma").alias("field"), F.col("lemma").alias("value")),
        )
    ).alias("x")
    words = glosses.select("source_ord", "gloss_id", fields)
    words = words.select("x.field", F.col("source_ord").alias("scope"), F.col("gloss_id").alias("id"), "x.value")
    lines = cues.select(F.lit("text").alias("field"), F.col("file_id").alias("scope"), F.col("cue_id").alias("id"), F.col("text").alias("value"))
    return words.unionAll(lines).where("scope is not null and id is not null and trim(value) <> ''")


#: Records of one form that one task joins; a form with more is spread over as many tasks as it has times as many.
HOT = 512
KEY = ["field", "scope", "form", "form2"]


def hashed_forms(rows: DataFrame, more: str = "") -> DataFrame:
    """Records (field, scope, id) with hashes of their skeleton (form, form2: 126 bits of two functions) and of their value
    (v), whatever their length, and the columns that ``more`` (SQL with a schema after a bar) adds.

    Hashes are compared inside one field and scope only.
    """
    names = '"field", "scope", "id"'
    columns, schema = more.split("|") if more else ("", "")
    query = (
        f"SELECT {names}, (hash(skeleton) >> 1)::bigint AS form, (md5_number_lower(skeleton) >> 1)::bigint AS form2,"
        f" (hash(value) >> 1)::bigint AS v{columns} FROM ({form_sql(names, 'value', bool(more))})"
    )
    return map_sql(spread(rows), query, f"field string, scope bigint, id bigint, form bigint, form2 bigint, v bigint{schema}")


def mixed_forms(formed: DataFrame) -> DataFrame:
    """The forms that are stored in more than one way; partly aggregated before the shuffle."""
    return formed.groupBy(*KEY).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n_rows")).where("least <> most")


def look_same_pairs(rows: DataFrame) -> DataFrame:
    """Each pair of different records (field, scope, id, value) of one field and scope that look the same and differ.

    Result (field, id_a, id_b), id_a < id_b. A first aggregation finds the forms stored in more than one way; only their
    rows are joined, by form, and never with rows of the same stored value. A form that very many records have is joined
    in parts: each record on one side falls into one of as many parts as the form needs, each on the other meets all.
    Repeated deliveries of a record count once; null and blank values have no partners; an empty table gives no rows.
    """
    formed = hashed_forms(rows)
    mixed = mixed_forms(formed).select(*KEY, F.ceil(F.col("n_rows") / HOT).cast("int").alias("parts"))
    cases = formed.join(mixed, KEY).dropDuplicates([*KEY, "id", "v"])
    one = cases.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = cases.select(*KEY, F.col("id").alias("id_b"), F.col("v").alias("v_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = one.join(other, [*KEY, "part"]).where("id < id_b and v <> v_b")
    return pairs.select("field", F.col("id").alias("id_a"), "id_b")


def look_same_classes(rows: DataFrame) -> DataFrame:
    """Each record that looks like one stored differently, with its class and links: field, scope, id, class_id, n_links.

    The class is named by its least id; n_links is the number of other records of the class with another value. One row
    for each record, however many pairs its class has; records of several values count for each.
    """
    formed = hashed_forms(rows)
    cases = formed.join(mixed_forms(formed).select(*KEY), KEY, "left_semi").select(*KEY, "id", "v").distinct()
    by_value = cases.groupBy(*KEY, "v").agg(F.count(F.lit(1)).alias("n_value"), F.min("id").alias("least"))
    by_class = by_value.groupBy(*KEY).agg(F.sum("n_value").alias("n_class"), F.min("least").alias("class_id"))
    counted = cases.join(by_value.drop("least"), [*KEY, "v"]).join(by_class, KEY)
    return counted.groupBy("field", "scope", "id", "class_id").agg(F.sum(F.col("n_class") - F.col("n_value")).alias("n_links"))


def consistent_values(rows: DataFrame) -> DataFrame:
    """Each record's value and the one form that all values looking like it get: (field, scope, id, value, form).

    The form is the clean form that most records of the field and scope have among those that look the same, the first
    by code points where several are as frequent. Only forms stored in more than one way are counted; the others keep
    their own clean form, which isn't sent where it equals the value.
    """
    formed = hashed_forms(rows, ", value, CASE WHEN clean = value THEN NULL ELSE clean END AS clean|, value string, clean string")
    narrow = formed.select(*KEY, "id", "v")
    mixed = mixed_forms(narrow).select(*KEY)
    cases = formed.join(mixed, KEY, "left_semi").dropDuplicates([*KEY, "id", "v"])
    counts = cases.groupBy(*KEY, F.coalesce("clean", "value").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*KEY).agg(F.min_by("c", F.struct(-F.col("n"), "c")).alias("best"))
    shown = formed.join(best, KEY, "left").select("field", "scope", "id", "v", "value", F.coalesce("best", "clean", "value").alias("form"))
    # Rows of one record and value are equal.
    return shown.dropDuplicates(["field", "scope", "id", "v"]).drop("v")


@cache
def _settling() -> dict[int, str | None]:
    gone = {ord(c): None for c in "­͏؜ᅟᅠ឴឵᠎ㅤﾠ﻿"}
    for low, high in ((0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F)):
        gone |= dict.fromkeys(range(low, high + 1))
    return {ord(a): b for a, b in (width_forms() | ligatures() | dict.fromkeys(SPACES, " ")).items()} | gone


def settled(text: str) -> str:
    """The Python twin of ``settled_steps`` for operators that walk through a text anyway."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_settling()))


@cache
def _capitals() -> dict[int, str]:
    pairs = accented(CYRILLIC) | accented(GREEK)
    return {ord(a): b for a, b in pairs.items() if a == a.upper()}


def capitals(text: str) -> str:
    """``text`` in capitals with look-alikes as Latin letters, character by character: places stay the same."""
    upper = text.upper()
    if len(upper) != len(text):
        upper = "".join(u if len(u := c.upper()) == 1 else c for c in text)
    return upper if upper.isascii() else upper.translate(_capitals())
