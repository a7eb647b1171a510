"""Queries over text functions, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def over(name: str, table: str, keep: tuple[str, ...], columns: Callable[[], dict[str, Column]], sql: str) -> None:
    """Register a projection of a whole table and the statement with the same result."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{table}.parquet")
        return rows.select(*keep, *[c.alias(n) for n, c in columns().items()])

    query.__name__ = name
    QUERIES[name], SQL[name] = query, sql


def quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


LABEL = r"regexp_extract(trim(definition), '^\(([^)]*)\)', 0)"
IS_MARKED = (
    f"coalesce(len(list_filter(string_split(trim({LABEL}, '()'), ','), lambda p: lower(trim(p)) IN ({quoted(T.MARKED)})))"
    " > 0, false)"
)
c = F.col

over("tidy", "documents", ("doc_id",), lambda: {"tidied": T.tidy(c("text"))},
     r"SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'), E' \t\n:;,') AS tidied FROM documents")
over("decapitalize", "glosses", ("gloss_id",), lambda: {"lowered": T.decapitalized(c("surface"))},
     "SELECT gloss_id, lower(left(surface, 1)) || substr(surface, 2) AS lowered FROM glosses")
over("gloss_keys", "glosses", ("gloss_id",), lambda: {"key": T.gloss_key(c("surface"), c("definition"))},
     "SELECT gloss_id, substr(sha256(surface || chr(10) || definition), 1, 16) AS key FROM glosses")
over("hiragana", "glosses", ("gloss_id",), lambda: {"folded": T.hiragana(c("surface"))},
     f"SELECT gloss_id, translate(surface, '{T.KATAKANA}', '{T.HIRAGANA}') AS folded FROM glosses")
over("kana_only", "glosses", ("gloss_id",), lambda: {"kana": T.is_kana(c("surface"))},
     r"SELECT gloss_id, regexp_matches(surface, '^[\p{Hiragana}\p{Katakana}ー]+$') AS kana FROM glosses")
over("listed", "glosses", ("gloss_id",), lambda: {"listing": T.listed(F.concat("quoted", F.array("surface", "entry")))},
     """SELECT gloss_id, array_to_string(q[1:len(q) - 1], ', ') || ' and ' || q[len(q)] AS listing
        FROM (SELECT gloss_id, list_concat(quoted, [surface, entry]) AS q FROM glosses)""")  # fmt: skip
over("clock", "cues", ("cue_id",), lambda: {"shown": T.clock(c("start_s"))},
     """SELECT cue_id, CASE WHEN s IS NULL THEN NULL ELSE printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) END AS shown
        FROM (SELECT cue_id, CAST(floor(start_s) AS BIGINT) AS s FROM cues)""")  # fmt: skip
over("marked", "glosses", ("gloss_id",), lambda: {"label": T.leading_qualifier(c("definition")), "marked": T.is_marked(c("definition"))},
     f"SELECT gloss_id, {LABEL} AS label, {IS_MARKED} AS marked FROM glosses")
over("fronted", "glosses", ("gloss_id",), lambda: {"front": T.fronted(c("surface"), c("definition"))},
     f"SELECT gloss_id, CASE WHEN {IS_MARKED} THEN surface || ' ' || {LABEL} ELSE surface END AS front FROM glosses")
over("label_of", "glosses", ("gloss_id",), lambda: {"label": T.label_of(F.concat(c("definition"), F.lit(" of "), c("entry"), F.lit(".")), c("entry"))},
     r"""SELECT gloss_id, regexp_replace(CASE WHEN s = '' THEN p ELSE s END, '[ .,;:]+$', '') AS label FROM (
        SELECT gloss_id, p, regexp_replace(p, '(?i)\s+of\s+' || regexp_escape(entry) || '(?:[^\p{L}\p{N}_].*)?$', '') AS s
        FROM (SELECT gloss_id, entry, trim(definition || ' of ' || entry || '.') AS p FROM glosses))""")  # fmt: skip
over("targets", "glosses", ("gloss_id",),
     lambda: {"named": F.array_join(T.targets(F.concat(F.lit("plural of "), c("lemma"), F.lit("; "), c("definition")), c("surface")), "|")},
     rf"""SELECT gloss_id, CASE WHEN d IS NULL THEN NULL WHEN regexp_matches(d, '(?i){T.GRAMMAR}') THEN array_to_string(list_filter(
        list_distinct_in_order, lambda w: w <> '' AND w <> surface), '|') ELSE '' END AS named FROM (
        SELECT gloss_id, surface, d, list_filter(x, lambda w, i: list_position(x, w) = i) AS list_distinct_in_order FROM (
        SELECT gloss_id, surface, d, list_transform(regexp_extract_all(d, '{T.TARGET}', 1), lambda w: trim(w, '“”"''')) AS x
        FROM (SELECT gloss_id, surface, 'plural of ' || lemma || '; ' || definition AS d FROM glosses)))""")  # fmt: skip
PROSE = lambda: F.concat(c("surface"), F.lit(" ("), F.coalesce(c("definition"), F.lit("")), F.lit(") "), c("entry"), F.lit(", "), c("surface"), F.lit("x"))
PROSE_SQL = "surface || ' (' || coalesce(definition, '') || ') ' || entry || ', ' || surface || 'x'"
over("mask_blind", "glosses", ("gloss_id",), lambda: {"asked": T.masked_anywhere(PROSE(), c("surface"))},
     f"SELECT gloss_id, replace({PROSE_SQL}, surface, '{T.MASK}') AS asked FROM glosses")
over("mask_word", "glosses", ("gloss_id",), lambda: {"asked": F.when(c("surface").rlike(r"^[\p{L}\p{N}_]+$"), T.masked_words(PROSE(), c("surface")))},
     rf"""SELECT gloss_id, CASE WHEN regexp_matches(surface, '^[\p{{L}}\p{{N}}_]+$') THEN array_to_string(list_transform(
        regexp_extract_all({PROSE_SQL}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda w: CASE WHEN w = surface THEN '{T.MASK}' ELSE w END), '')
        END AS asked FROM glosses""")  # fmt: skip
over("mask_pieces", "glosses", ("gloss_id",), lambda: {"asked": T.masked_pieces(PROSE(), c("surface"))},
     f"""SELECT gloss_id, list_reduce(list_concat([{PROSE_SQL}, surface], regexp_extract_all(surface, '(?s).')),
        lambda t, piece: replace(t, piece, '{T.MASK}')) AS asked FROM glosses""")  # fmt: skip
over("md_anchor", "glosses", ("gloss_id",), lambda: {"anchor": T.slug(F.concat_ws(" — ", "surface", "definition"))},
     r"SELECT gloss_id, replace(regexp_replace(lower(concat_ws(' — ', surface, definition)), '[^\p{L}\p{N}_\- ]', '', 'g'), ' ', '-') AS anchor FROM glosses")
over("entry_title", "glosses", ("gloss_id",), lambda: {"path": T.title_path(c("entry")), "title": T.path_title(T.title_path(c("entry")))},
     "SELECT gloss_id, url_encode(replace(entry, ' ', '_')) AS path, replace(entry, '_', ' ') AS title FROM glosses")
HREF = lambda: (
    F.when(c("idx") % 4 == 0, F.concat(F.lit("/wiki/Appendix:Glossary#"), T.title_path(c("entry"))))
    .when(c("idx") % 4 == 1, F.concat(F.lit("/wiki/Appendix:Word_list#"), T.title_path(c("entry"))))
    .when(c("idx") % 4 == 2, F.lit("/wiki/Appendix:Word_list"))
    .otherwise(F.concat(F.lit("/wiki/"), T.title_path(c("entry"))))
)
over("concept_ref", "glosses", ("gloss_id",), lambda: {"concept": T.concept_reference(HREF())},
     """SELECT gloss_id, CASE idx % 4 WHEN 0 THEN replace(entry, ' ', '_') WHEN 1 THEN 'Appendix:Word list#' || replace(entry, ' ', '_') END
        AS concept FROM glosses""")  # fmt: skip
over("mark", "glosses", ("gloss_id",),
     lambda: {"shown": F.get(F.transform("examples", lambda e: T.bracketed(e["sentence"], F.array(
         F.struct(F.lit(0).alias("s"), F.lit(2).alias("e")), F.struct(F.lit(2).alias("s"), F.lit(3).alias("e")), F.struct(F.lit(5).alias("s"), F.lit(8).alias("e"))))), 0)},
     """SELECT gloss_id, CASE WHEN len(examples) = 0 THEN NULL ELSE '⟨' || left(x, 3) || '⟩' || substr(x, 4, 2) || '⟨' || substr(x, 6, 3) || '⟩' || substr(x, 9) END AS shown
        FROM (SELECT gloss_id, examples, examples[1].sentence AS x FROM glosses)""")  # fmt: skip
over("features", "glosses", ("gloss_id",),
     lambda: {"names": F.array_join(T.feature_names(F.array_join(F.transform(F.array_distinct(F.split("surface", "")), lambda x: F.concat(x, F.lit("="), c("idx"))), "|")), ",")},
     "SELECT gloss_id, array_to_string(list_sort(list_distinct(list_filter(string_split(surface, ''), lambda x: x <> ''))), ',') AS names FROM glosses")


def is_number(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers among the words between spaces of each document."""
    words = F.split(F.col("text"), r"[\s\p{Z}]+")
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", F.size(F.filter(words, lambda w: T.is_number(w))).cast("long").alias("n_numbers")
    )


def respell(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of Russian surfaces with restored marks."""
    rows = spark.read.parquet(f"{folder}/glosses.parquet").where("lang_name = 'Russian'")
    return rows.select("gloss_id", F.array_join(T.respellings(F.col("surface")), ",").alias("spellings"))


def unmarker_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of each document without its list marker."""
    lines = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.without_list_marker(c("line")).alias("plain"))


QUERIES |= {"is_number": is_number, "respell": respell, "unmarker": unmarker_lines}
SQL |= {
    "unmarker": rf"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(l[i], '{T.LIST_MARKER}', '') AS plain
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "is_number": rf"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[\s\p{{Z}}]+'),
        lambda w: regexp_matches(replace(w, ',', '.'), '{T.NUMBER}'))) AS BIGINT) AS n_numbers FROM documents""",
    "respell": """
        WITH w AS (SELECT gloss_id, surface, string_split(surface, '') AS l FROM glosses WHERE lang_name = 'Russian'),
        p AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: l[i] = 'е') AS places FROM w)
        SELECT gloss_id, CASE WHEN len(places) BETWEEN 1 AND 4 THEN array_to_string(list_transform(range(1, CAST(pow(2, len(places)) AS BIGINT)),
            lambda m: array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(places, i) > 0
                AND (m // CAST(pow(2, list_position(places, i) - 1) AS BIGINT)) % 2 = 1 THEN 'ё' ELSE l[i] END), '')), ',') ELSE '' END AS spellings
        FROM p""",
}
