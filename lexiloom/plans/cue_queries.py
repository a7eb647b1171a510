"""Queries over cue files, timelines and scripts, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import script as S
from lexiloom.operators import cards as C
from lexiloom.operators import glosses as G
from lexiloom.operators.timeline import COVER, EVERY, RATE, as_of, coverage_rows
from lexiloom.session import cut
from lexiloom.sources import cues as U


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(s: SparkSession, d: str) -> DataFrame:
    return U.as_lines(read(s, d, "cues"), read(s, d, "cue_files"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    return U.cues_of(U.as_ordered_lines(read(s, d, "cues"), read(s, d, "cue_files")), block=512 * U.CUE_STEP)


def clocked(s: SparkSession, d: str, cues: DataFrame | None = None) -> DataFrame:
    """When each gloss of a source is met in the file of the same number: its sentence, 60 characters each, as of the
    cue that the place falls in."""
    glosses = G.records(read(s, d, "glosses")).where("first_sentence is not null")
    points = glosses.select(F.col("source_ord").alias("file_id"), (F.col("first_sentence").cast("long") * 60).alias("starts_at"), "gloss_id", "gloss_key")
    cues = cut(parsed(s, d)) if cues is None else cues
    marks = U.offsets(cues).join(cues.select("file_id", "cue", F.col("start").alias("t")), ["file_id", "cue"]).select("file_id", "starts_at", "t")
    return as_of(points, cut(marks), "file_id", "starts_at", "t").select("file_id", "gloss_id", "gloss_key", F.coalesce("t", F.lit(0.0)).alias("t"))


def timeline(s: SparkSession, d: str) -> DataFrame:
    """Coverage of every file by its source's deck, every five minutes."""
    places = C.positions(read(s, d, "deck")).select(F.col("source_ord").alias("file_id"), "gloss_key", "position")
    cues = cut(parsed(s, d))
    met = clocked(s, d, cues).join(places, ["file_id", "gloss_key"], "left").select("file_id", "t", "position")
    ends = cues.groupBy("file_id").agg(F.max("end").alias("end"))
    return coverage_rows(met, ends, "file_id")


def greedy(s: SparkSession, d: str) -> DataFrame:
    """How the cues of unpunctuated files join."""
    cues = cut(parsed(s, d))
    return U.greedy_breaks(cues.join(U.punctuated(cues).where("not punctuated").select("file_id"), "file_id", "left_semi"))


QUERIES = {
    "cue_sniff": lambda s, d: U.looks_like_cues(lines(s, d)),
    "cue_lines": lines,
    "cue_parse": parsed,
    "cue_offsets": lambda s, d: U.offsets(cut(parsed(s, d))),
    "cue_punctuated": lambda s, d: U.punctuated(parsed(s, d)),
    "cue_fold": lambda s, d: U.folded(cut(parsed(s, d))),
    "cue_pause": lambda s, d: U.pauses(cut(parsed(s, d))),
    "cue_fold_greedy": greedy,
    "asof_times": clocked,
    "timeline": timeline,
    "timeline_gaps": lambda s, d: G.records(read(s, d, "glosses")).join(C.positions(read(s, d, "deck")), ["source_ord", "gloss_key"], "left_anti").select("gloss_id"),
    "script_of": lambda s, d: S.script_counts(read(s, d, "glosses").select("gloss_id", "surface").distinct(), "gloss_id", "surface").groupBy("script").agg(F.sum("n").alias("n")),
    "script_counts": lambda s, d: S.script_counts(read(s, d, "documents"), "doc_id"),
    "unreadable": lambda s, d: S.unreadable(read(s, d, "documents"), "doc_id"),
    "foreign_chars": lambda s, d: S.foreign_characters(read(s, d, "glosses").select("gloss_id", "surface").distinct(), "gloss_id", "surface"),
    "symbol_glosses": lambda s, d: S.foreign_characters(read(s, d, "glosses").select("gloss_id", "surface").distinct(), "gloss_id", "surface").groupBy("char", "script").agg(F.min("gloss_id").alias("first_gloss")),
}

STAMP = "printf('%02d:%02d:%02d', ({x} // 3600000) % 1000, ({x} // 60000) % 60, ({x} // 1000) % 60) || mark || printf('%03d', {x} % 1000)"
LINES = f"""lv AS (SELECT file_id, v, CAST(sum(len(v)) OVER (PARTITION BY file_id ORDER BY cue_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) - len(v) AS before FROM (
    SELECT file_id, cue_ord, list_concat([CAST(cue_ord AS VARCHAR), {STAMP.format(x='a')} || ' --> ' || {STAMP.format(x='b')}], string_split(text, chr(10)), ['']) AS v FROM (
    SELECT DISTINCT ON (file_id, cue_ord) c.file_id, cue_ord, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b, text,
        CASE WHEN dialect = 'vtt' THEN '.' ELSE ',' END AS mark FROM cues c JOIN cue_files f ON c.file_id = f.file_id
    WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND text IS NOT NULL))),
    li AS (SELECT file_id, before + i - 1 AS line_no, v[i] AS line FROM (SELECT file_id, before, v, unnest(range(1, len(v) + 1)) AS i FROM lv))"""


def clock_sql(first: int) -> str:
    g = lambda i: f"regexp_extract(line, '{U.TIMING}', {first + i})"
    return (f"CAST(CASE WHEN {g(0)} = '' THEN 0 ELSE CAST({g(0)} AS INTEGER) END * 3600 + CAST({g(1)} AS INTEGER) * 60 + CAST({g(2)} AS INTEGER) AS DOUBLE)"
            f" + CAST({g(3)} AS DOUBLE) / pow(10.0, length({g(3)}))")  # fmt: skip


PARSED = f"""{LINES}, tm AS (SELECT *, regexp_matches(line, '{U.TIMING}') AS timing FROM li),
    nu AS (SELECT *, CAST(sum(CAST(timing AS INTEGER)) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cue FROM tm),
    ck AS (SELECT file_id, cue, {clock_sql(1)} AS start, {clock_sql(5)} AS "end" FROM nu WHERE timing),
    wo AS (SELECT file_id, cue, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '(?i){U.MARKUP}', ' ', 'g'), '{U.SPEAKER_MARK}', ''), '[\\s\\p{{Z}}]+', ' ', 'g')) AS words FROM nu WHERE NOT timing),
    wk AS (SELECT *, lag(words) OVER (PARTITION BY file_id ORDER BY line_no) AS kept FROM wo WHERE words <> '' AND NOT regexp_matches(words, '{U.INDEX}') AND NOT regexp_matches(words, '{U.HEADER}')),
    tx AS (SELECT file_id, cue, string_agg(words, ' ' ORDER BY line_no) AS text FROM wk WHERE cue > 0 AND (kept IS NULL OR kept <> words) GROUP BY file_id, cue),
    pa AS (SELECT ck.file_id, ck.cue, start, "end", text FROM ck JOIN tx ON ck.file_id = tx.file_id AND ck.cue = tx.cue)"""
FOLD = f"""pu AS (SELECT file_id, count(*) FILTER (regexp_matches(rtrim(text), '{U.TERMINAL}')) >= CAST({U.PUNCTUATED} AS DOUBLE) * count(*) AS punctuated FROM pa GROUP BY file_id),
    nb AS (SELECT pa.*, punctuated, row_number() OVER w AS k, coalesce(start - lag("end") OVER w >= CAST({U.PAUSE} AS DOUBLE), true) AS paused,
        len(list_filter(string_split_regex(text, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) AS n FROM pa JOIN pu USING (file_id) WINDOW w AS (PARTITION BY file_id ORDER BY cue)),
    fd AS (SELECT file_id, k, cue, text, CAST('start' AS VARCHAR) AS joined, n AS words FROM nb WHERE k = 1
        UNION ALL SELECT b.file_id, b.k, b.cue, b.text, CASE WHEN NOT b.punctuated AND (b.paused OR a.words >= {U.MAX_WORDS}) THEN 'break' ELSE 'space' END,
            CASE WHEN b.paused OR a.words >= {U.MAX_WORDS} THEN 0 ELSE a.words END + b.n FROM fd a JOIN nb b ON b.file_id = a.file_id AND b.k = a.k + 1),
    jo AS (SELECT *, CASE joined WHEN 'start' THEN '' WHEN 'space' THEN ' ' ELSE chr(10) || chr(10) END AS joint FROM fd)"""
OFFSETS = f"""{FOLD}, os AS (SELECT jo.file_id, jo.cue, CAST(sum(length(joint) + length(jo.text)) OVER (PARTITION BY jo.file_id ORDER BY jo.cue ROWS UNBOUNDED PRECEDING)
    - length(jo.text) AS BIGINT) AS starts_at, start AS t FROM jo JOIN pa ON pa.file_id = jo.file_id AND pa.cue = jo.cue)"""
REC = "g AS (SELECT DISTINCT ON (gloss_id) * FROM glosses ORDER BY gloss_id)"
CLOCKED = f"""{PARSED}, {OFFSETS}, {REC}, cl AS (SELECT g.source_ord AS file_id, g.gloss_id, g.gloss_key,
    coalesce(o.t, (SELECT arg_min(t, starts_at) FROM os WHERE os.file_id = g.source_ord), 0.0) AS t
    FROM g ASOF LEFT JOIN os o ON o.file_id = g.source_ord AND o.starts_at <= g.first_sentence * 60 WHERE g.first_sentence IS NOT NULL)"""
PLACES = """pc AS (SELECT card_id, source_ord, gloss_key, kind, row_number() OVER (PARTITION BY source_ord ORDER BY due, card_id) AS position FROM deck WHERE card_type = 0
    UNION ALL SELECT card_id, source_ord, gloss_key, kind, 0 FROM deck WHERE card_type <> 0),
    ps AS (SELECT source_ord, gloss_key, max(position) AS position FROM pc WHERE gloss_key IS NOT NULL AND kind = 'recognition' GROUP BY ALL)"""
SQL = {
    "cue_sniff": f"WITH {LINES} SELECT file_id, max(regexp_matches(line, '{U.TIMING}') OR (line_no = 0 AND regexp_matches(line, '{U.HEADER}'))) AS is_cues FROM li WHERE line_no < 40 GROUP BY file_id",
    "cue_lines": f"WITH {LINES} SELECT * FROM li",
    "cue_parse": f"WITH {PARSED} SELECT * FROM pa",
    "cue_offsets": f"WITH RECURSIVE {PARSED}, {OFFSETS} SELECT file_id, cue, starts_at FROM os",
    "cue_fold": f"WITH RECURSIVE {PARSED}, {FOLD} SELECT file_id, cue // {U.BLOCK} AS block, string_agg(joint || text, '' ORDER BY cue) AS text FROM jo GROUP BY ALL",
    "cue_fold_greedy": f"WITH RECURSIVE {PARSED}, {FOLD} SELECT file_id, cue, joined FROM jo WHERE file_id IN (SELECT file_id FROM pu WHERE NOT punctuated)",
    "cue_punctuated": f"""WITH {PARSED} SELECT file_id, count(*) AS n_cues, count(*) FILTER (regexp_matches(rtrim(text), '{U.TERMINAL}')) AS n_ends,
        count(*) FILTER (regexp_matches(rtrim(text), '{U.TERMINAL}')) >= CAST({U.PUNCTUATED} AS DOUBLE) * count(*) AS punctuated FROM pa GROUP BY file_id""",
    "cue_pause": f'WITH {PARSED} SELECT file_id, cue, start - lag("end") OVER (PARTITION BY file_id ORDER BY cue) AS silence FROM pa',
    "asof_times": f"WITH RECURSIVE {CLOCKED} SELECT * FROM cl",
    "timeline": f"""WITH RECURSIVE {CLOCKED}, {PLACES}, me AS (SELECT cl.file_id, cl.t, ps.position FROM cl LEFT JOIN ps ON ps.source_ord = cl.file_id AND ps.gloss_key = cl.gloss_key),
        en AS (SELECT file_id, max("end") AS e FROM pa GROUP BY file_id),
        cu AS (SELECT file_id, CAST(unnest(range({EVERY}, CAST(floor(e) AS BIGINT) + 1, {EVERY})) AS DOUBLE) AS cutoff FROM en
            UNION SELECT file_id, e FROM en),
        ra AS (SELECT cu.file_id, cutoff, position, row_number() OVER (PARTITION BY cu.file_id, cutoff ORDER BY position NULLS LAST) AS rank,
            ceil(CAST({COVER} AS DOUBLE) * count(*) OVER (PARTITION BY cu.file_id, cutoff)) AS wanted FROM cu JOIN me ON me.file_id = cu.file_id AND me.t <= cu.cutoff),
        pe AS (SELECT file_id, cutoff, count(*) AS n_met, count(*) FILTER (position IS NULL) AS n_untaught, max(CASE WHEN rank = wanted THEN position END) AS cards, max(position) AS furthest FROM ra GROUP BY ALL)
        SELECT cu.file_id, cu.cutoff, coalesce(n_met, 0) AS n_met, coalesce(n_untaught, 0) AS n_untaught, CASE WHEN n_met IS NULL THEN 0 ELSE cards END AS cards,
            CASE WHEN n_met IS NULL THEN 0 ELSE cards END / CAST({RATE} AS DOUBLE) AS days, coalesce(furthest, 0) AS furthest, coalesce(furthest, 0) / CAST({RATE} AS DOUBLE) AS furthest_days
        FROM cu LEFT JOIN pe ON pe.file_id = cu.file_id AND pe.cutoff = cu.cutoff""",
    "timeline_gaps": f"WITH {REC}, {PLACES} SELECT gloss_id FROM g WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.source_ord = g.source_ord AND ps.gloss_key = g.gloss_key)",
}


def ranges_sql() -> str:
    values = ", ".join(f"({a}, {b}, '{n}')" for a, b, n in S.script_ranges())
    return f"sr(low, high, script) AS (VALUES {values}), st AS (SELECT unnest(range(low, high + 1)) AS code, script FROM sr)"


DOC_CHARS = "ch AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY doc_id, c)"
WORD_CHARS = """wd AS (SELECT DISTINCT gloss_id, surface FROM glosses), wc AS (SELECT gloss_id, CAST(i - 1 AS INTEGER) AS "at", v[i] AS c FROM (
    SELECT gloss_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT gloss_id, string_split(surface, '') AS v FROM wd)))"""
DOC_COUNTS = f"WITH {ranges_sql()}, {DOC_CHARS}, k AS (SELECT doc_id, script, CAST(sum(n) AS BIGINT) AS n FROM ch JOIN st ON unicode(c) = code GROUP BY doc_id, script)"
FOREIGN = f"""WITH {ranges_sql()}, {WORD_CHARS}, pc AS (SELECT *, lag(c) OVER (PARTITION BY gloss_id ORDER BY "at") AS b FROM wc WHERE c <> ''),
    nc AS (SELECT gloss_id, c, "at", coalesce(o.script, i.script) AS script FROM pc LEFT JOIN st o ON unicode(c) = o.code
        LEFT JOIN st i ON regexp_matches(c, '^\\p{{M}}$') AND unicode(b) = i.code),
    fc AS (SELECT gloss_id, c AS "char", arg_min(script, "at") AS script, min("at") AS "at" FROM nc WHERE script <> 'LATIN' GROUP BY gloss_id, c)"""
SQL |= {
    "script_of": f"WITH {ranges_sql()}, {WORD_CHARS} SELECT script, count(*) AS n FROM wc JOIN st ON unicode(c) = code GROUP BY script",
    "script_counts": DOC_COUNTS + " SELECT * FROM k",
    "unreadable": DOC_COUNTS + f""", w AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS written, sum(CASE WHEN script = 'LATIN' THEN 0 ELSE n END) OVER (PARTITION BY doc_id) AS other FROM k)
        SELECT doc_id, script, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, script) AS INTEGER) AS rank FROM w
        WHERE script <> 'LATIN' AND other >= CAST({S.ENOUGH} AS DOUBLE) * written AND n >= CAST({S.WORTH_NAMING} AS DOUBLE) * written""",
    "foreign_chars": FOREIGN + " SELECT * FROM fc",
    "symbol_glosses": FOREIGN + ' SELECT "char", script, min(gloss_id) AS first_gloss FROM fc GROUP BY "char", script',
}
