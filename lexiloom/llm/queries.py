"""Queries over the training-data operators, and the SQL they can be held against."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import clocks, lookalike, mixing, packing, runs, sentences, truncation, turns
from lexiloom.llm.cues import ordered_cues


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose values look the same but differ as stored."""
    return lookalike.look_same_pairs(lookalike.values(table(spark, folder, "glosses"), table(spark, folder, "cues")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Records that look like others, by class, with their number of links."""
    return lookalike.look_same_classes(lookalike.values(table(spark, folder, "glosses"), table(spark, folder, "cues")))


def p1_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """The one form of every surface, lemma and cue text."""
    return lookalike.consistent_values(lookalike.values(table(spark, folder, "glosses"), table(spark, folder, "cues")))


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of cues that show the same line, with their number of cues, times and line."""
    return runs.runs(table(spark, folder, "cues"), table(spark, folder, "cue_files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_runs(spark, folder).select("file_id", "first_cue_id", "last_cue_id")


def p4_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker turns with times and words."""
    return turns.turns(table(spark, folder, "cues"), table(spark, folder, "cue_files"), table(spark, folder, "speakers"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Turns in the order of starts as stored, which no repair of clocks may change."""
    found = turns.turns(table(spark, folder, "cues"), table(spark, folder, "cue_files"), table(spark, folder, "speakers"), reset_ms=None)
    return found.select("file_id", "speaker_id", "first_cue_id", "last_cue_id")


def p4_clocks(spark: SparkSession, folder: str) -> DataFrame:
    """Segments and repaired times of the cues of all talk files."""
    return clocks.repaired_clocks(ordered_cues(table(spark, folder, "cues"), table(spark, folder, "cue_files"), ["talk"]))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where sentences end."""
    return sentences.sentence_ends(table(spark, folder, "cues"), table(spark, folder, "cue_files"))


def p6_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of all documents for each capacity."""
    return packing.assignment(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused room per capacity."""
    return packing.summary(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The selected documents and how often each is used."""
    return mixing.selection(table(spark, folder, "documents"), table(spark, folder, "mix_weights"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_weights"))


def p7_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of sources, languages and topics."""
    return mixing.marginals(table(spark, folder, "documents"), table(spark, folder, "mix_weights"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.cut_documents(table(spark, folder, "documents"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source the share of documents that are cut, and the hidden limit."""
    return truncation.cut_shares(table(spark, folder, "documents"))


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The hidden length limits of the sources."""
    return truncation.hidden_limits(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_found, p1_classes, p1_consistent, p3_found, p3_runs, p4_found, p4_turns, p4_clocks, p5_found, p6_assignment, p6_summary,
        p7_selection, p7_shares, p7_marginals, p8_found, p8_shares, p8_limits,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that one statement can express.

    The statement reaches the skeleton in its own way: character by character over a table of replacements that comes
    from the compatibility decompositions, instead of the operator's chain of expressions.
    """
    replace = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0x2F00, 0x2FD6), *range(0xFB00, 0xFB18), *range(0xFF01, 0xFFEF), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)] if unicodedata.decomposition(chr(c))}
    replace |= dict.fromkeys(lookalike.SPACES, " ") | {chr(c): "" for c in lookalike.invisible_codes()}
    alike = lookalike.CYRILLIC | lookalike.GREEK | lookalike.OTHER | lookalike.KANA
    pairs = lambda table: ", ".join(f"({ord(a)}, {lookalike.quoted(b)})" for a, b in table.items())
    decomposed = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x3040, 0x3100)] if unicodedata.normalize("NFD", chr(c)) != chr(c)}
    found = f"""
        WITH rows AS (
            SELECT 'surface' AS field, source_ord AS scope, gloss_id AS id, surface AS value FROM glosses
            UNION SELECT 'lemma', source_ord, gloss_id, lemma FROM glosses
            UNION SELECT 'text', file_id, cue_id, text FROM cues
        ), plain(code, put) AS (VALUES {pairs(replace)}), apart(code, put) AS (VALUES {pairs(decomposed)}), alike(code, put) AS (VALUES {pairs(alike)}),
        v AS (SELECT row_number() OVER () AS n, * FROM (SELECT DISTINCT value FROM rows WHERE trim(value) <> '')),
        c1 AS (SELECT n, i, unnest(string_split(coalesce(put, c), '')) AS c, generate_subscripts(string_split(coalesce(put, c), ''), 1) AS j
            FROM (SELECT n, unnest(string_split(value, '')) AS c, generate_subscripts(string_split(value, ''), 1) AS i FROM v) LEFT JOIN plain ON unicode(c) = code),
        s1 AS (SELECT n, nfc_normalize(string_agg(c, '' ORDER BY i, j)) AS t FROM c1 GROUP BY n),
        c2 AS (SELECT n, i, unnest(string_split(coalesce(put, c), '')) AS c, generate_subscripts(string_split(coalesce(put, c), ''), 1) AS j
            FROM (SELECT n, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM s1) LEFT JOIN apart ON unicode(c) = code),
        s2 AS (SELECT n, nfc_normalize(string_agg(coalesce(put, c), '' ORDER BY i, j)) AS skeleton FROM c2 LEFT JOIN alike ON unicode(c) = code GROUP BY n),
        formed AS (SELECT field, scope, id, rows.value, skeleton FROM rows JOIN v USING (value) JOIN s2 USING (n))
        SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b
        FROM formed a JOIN formed b ON a.field = b.field AND a.scope = b.scope AND a.skeleton = b.skeleton
        WHERE a.id < b.id AND a.value <> b.value"""
    return {"p1_found": found}
