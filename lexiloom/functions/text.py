"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "■"
# Labels that mark a sense as a figure, a register or an age of its word.
MARKED = (
    "archaic", "colloquial", "colloquially", "dated", "euphemistic", "figurative", "figuratively", "humorous",
    "ironic", "literary", "obsolete", "poetic", "poetically", "slang",
)
# Words of definitions that describe a form of another word.
GRAMMAR = (
    r"\b(inflection|form|spelling|participle|gerund|degree|diminutive|augmentative|superlative|clipping|abbreviation"
    r"|accusative|dative|nominative|genitive|vocative|singular|plural|indicative|subjunctive|imperative|imperfect"
    r"|preterite|conditional|(?:first|second|third)-person)\b"
)
TARGET = r"\bof\s+([^\s,;:.()\[\]“”\"]+)"
# Russian texts drop the marks of this letter; beyond so many places a word is left alone.
RESTORED, RESTORED_LIMIT = ("е", "ё"), 4
NUMBER = r"^[+-]?(?:\p{Nd}+(?:_\p{Nd}+)*\.?(?:\p{Nd}+(?:_\p{Nd}+)*)?|\.\p{Nd}+(?:_\p{Nd}+)*)(?:[eE][+-]?\p{Nd}+)?$"
LIST_MARKER = r"^\s*(?:[-*•]|\d+[.)])\s+"
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
GLOSSARY_LINK, APPENDIX_LINK, BIBLIOGRAPHY = "Appendix:Glossary#", "/wiki/Appendix:", "Appendix:Bibliography/"


def tidy(x: Column) -> Column:
    """White space collapsed, and spaces and the marks : ; , gone from both ends."""
    return F.btrim(F.regexp_replace(x, r"[\s\p{Z}]+", " "), F.lit(" \t\n:;,"))


def decapitalized(x: Column) -> Column:
    """The first letter in lower case."""
    return F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 2147483647))


def gloss_key(surface: Column, definition: Column) -> Column:
    """The 16 hexadecimal digits that stand for a surface with a definition."""
    return F.substring(F.sha2(F.concat(surface, F.lit("\n"), definition), 256), 1, 16)


def is_number(x: Column) -> Column:
    """Whether a token is a number in digits: 17,5 and 1 000 are; 1,000,000 with two marks isn't, nor is 5d."""
    return F.translate(F.trim(x), ",\u00a0\u202f ", ".").rlike(NUMBER)


def respellings(x: Column) -> Column:
    """All spellings with some of up to four е as ё, in the order of the subsets; none beyond four."""
    plain, restored = RESTORED
    letters = F.split(x, "")
    places = F.filter(F.transform(letters, lambda c, i: F.when(c == plain, i)), lambda i: i.isNotNull())
    many = F.size(places)

    def spelt(subset: Column) -> Column:
        def letter(c: Column, i: Column) -> Column:
            # The place's bit of the subset; letters elsewhere look at a bit that is never set.
            bit = F.coalesce(F.array_position(places, i), F.lit(0)).cast("int")
            chosen = F.when(bit > 0, F.floor(subset / F.pow(F.lit(2), bit - 1)) % 2 == 1).otherwise(False)
            return F.when(chosen, F.lit(restored)).otherwise(c)

        return F.array_join(F.transform(letters, letter), "")

    subsets = F.sequence(F.lit(1), F.pow(F.lit(2), F.least(many, F.lit(RESTORED_LIMIT))).cast("int") - 1)
    fits = many.between(1, RESTORED_LIMIT)
    return F.when(fits, F.transform(F.when(fits, subsets), spelt)).otherwise(F.array().cast("array<string>"))


def hiragana(x: Column) -> Column:
    """Katakana as hiragana."""
    return F.translate(x, KATAKANA, HIRAGANA)


def is_kana(x: Column) -> Column:
    """Whether a text is kana only."""
    return x.rlike(r"^[\p{IsHiragana}\p{IsKatakana}ー]+$")


def listed(x: Column) -> Column:
    """An array as a sentence lists it: a, b and c."""
    n = F.size(x)
    return (
        F.when(n <= 0, F.lit(""))
        .when(n == 1, F.element_at(x, 1))
        .otherwise(F.concat(F.array_join(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(x, F.lit(-1))))
    )


def clock(seconds: Column) -> Column:
    """Whole seconds as hh:mm:ss."""
    whole = F.floor(seconds).cast("long")
    hours, minutes = F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60
    return F.when(whole.isNotNull(), F.format_string("%02d:%02d:%02d", hours, minutes, whole % 60))


def without_list_marker(x: Column) -> Column:
    return F.regexp_replace(x, LIST_MARKER, "")


def leading_qualifier(definition: Column) -> Column:
    """The label in parentheses that a definition opens with, or the empty text."""
    return F.regexp_extract(F.trim(definition), r"^\(([^)]*)\)", 0)


def is_marked(definition: Column) -> Column:
    """Whether any label a definition opens with marks it as a figure of its word."""
    inner = F.btrim(leading_qualifier(definition), F.lit("()"))
    return F.coalesce(F.exists(F.split(inner, ","), lambda p: F.lower(F.trim(p)).isin(*MARKED)), F.lit(False))


def fronted(surface: Column, definition: Column) -> Column:
    """The surface as a card's front shows it: a figure with its label."""
    return F.when(is_marked(definition), F.concat(surface, F.lit(" "), leading_qualifier(definition))).otherwise(surface)


def label_of(prose: Column, base: Column) -> Column:
    """A form's description without the word it is a form of."""
    pattern = F.concat(F.lit(r"(?iu)\s+of\s+\Q"), base, F.lit(r"\E(?:[^\p{L}\p{N}_].*)?$"))
    short = F.regexp_replace(F.trim(prose), pattern, F.lit(""))
    return F.regexp_replace(F.when(short == "", F.trim(prose)).otherwise(short), r"[ .,;:]+$", "")


def targets(definition: Column, own: Column) -> Column:
    """The words a description of a form names after 'of', its own word left out."""
    named = F.array_distinct(F.regexp_extract_all(definition, F.lit(TARGET), F.lit(1)))
    found = F.filter(F.transform(named, lambda w: F.btrim(w, F.lit("“”\"'"))), lambda w: (w != "") & (w != own))
    none = F.when(definition.isNotNull(), F.array().cast("array<string>"))
    return F.when(definition.rlike(f"(?i){GRAMMAR}"), found).otherwise(none)


def masked_anywhere(definition: Column, term: Column) -> Column:
    """The term blanked wherever it stands, inside words too: for scripts the reader doesn't read."""
    return F.when(term == "", definition).otherwise(F.replace(definition, term, F.lit(MASK)))


def masked_words(definition: Column, term: Column) -> Column:
    """The term blanked where it stands as a word; an end that is no letter needs no boundary."""
    left = F.when(term.rlike(r"^[\p{L}\p{N}_]"), F.lit(r"(?<![\p{L}\p{N}_])")).otherwise(F.lit(""))
    right = F.when(term.rlike(r"[\p{L}\p{N}_]$"), F.lit(r"(?![\p{L}\p{N}_])")).otherwise(F.lit(""))
    pattern = F.concat(left, F.lit(r"\Q"), term, F.lit(r"\E"), right)
    return F.when(term == "", definition).otherwise(F.regexp_replace(definition, pattern, F.lit(MASK)))


def masked_pieces(definition: Column, term: Column) -> Column:
    """The whole term blanked first, then each of its characters."""
    pieces = F.filter(F.concat(F.array(term), F.split(term, "")), lambda p: p != "")
    return F.aggregate(pieces, definition, lambda text, piece: F.replace(text, piece, F.lit(MASK)))


def slug(heading: Column) -> Column:
    """A heading's anchor inside a document."""
    return F.translate(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}_\- ]", ""), " ", "-")


def title_path(title: Column) -> Column:
    """A title as the end of a page address."""
    return F.replace(F.url_encode(F.translate(title, " ", "_")), F.lit("+"), F.lit("%20"))


def path_title(path: Column) -> Column:
    return F.translate(F.url_decode(path), "_", " ")


def concept_reference(href: Column) -> Column:
    """What a link names as a concept: a glossary's anchor, or an appendix with its anchor; else null."""
    after = F.substring_index(href, "#", -1)
    page = F.translate(F.url_decode(F.substring_index(F.substring(href, 7, 1000000), "#", 1)), "_", " ")
    fragment = F.when(F.instr(href, "#") > 0, after).otherwise(F.lit(""))
    return (
        F.when(F.contains(href, F.lit(GLOSSARY_LINK)), F.url_decode(after))
        .when(~F.startswith(href, F.lit(APPENDIX_LINK)) | (fragment == ""), F.lit(None))
        .when(F.startswith(page, F.lit(BIBLIOGRAPHY)), F.lit(None))
        .otherwise(F.concat(page, F.lit("#"), F.url_decode(fragment)))
    )


def bracketed(sentence: Column, spans: Column) -> Column:
    """``sentence`` with ⟨ ⟩ around each of ``spans`` (structs s, e; code points from 0, e exclusive).

    Spans that touch get one bracket. A span that isn't in order or not inside the sentence leaves it unchanged.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def put(state: Column, span: Column) -> Column:
        touches = (F.endswith(state["text"], F.lit("⟩"))) & (state["at"] == span["s"])
        right = (state["at"] <= span["s"]) & (span["s"] < span["e"]) & (span["e"] <= F.length(sentence))
        gap = F.substring(sentence, state["at"] + 1, F.greatest(span["s"] - state["at"], F.lit(0)))
        inside = F.substring(sentence, span["s"] + 1, F.greatest(span["e"] - span["s"], F.lit(0)))
        text = F.when(
            touches, F.concat(F.substring(state["text"], F.lit(1), F.length(state["text"]) - 1), inside, F.lit("⟩"))
        ).otherwise(F.concat(state["text"], gap, F.lit("⟨"), inside, F.lit("⟩")))
        return F.struct(text.alias("text"), span["e"].cast("int").alias("at"), (state["ok"] & right).alias("ok"))

    done = F.aggregate(spans, start, put)
    rest = F.substring(sentence, done["at"] + 1, F.length(sentence))
    return F.when(done["ok"], F.concat(done["text"], rest)).otherwise(sentence)


def feature_names(features: Column) -> Column:
    """The sorted names of features written A=x|B=y."""
    return F.array_sort(F.map_keys(F.str_to_map(features, F.lit(r"\|"), F.lit("="))))
