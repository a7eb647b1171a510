"""Queries over sentences, tokens and terms of the documents, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import gloss_key
from lexiloom.operators import terms as M
from lexiloom.operators.sequence import ordered_scan


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(spark: SparkSession, folder: str) -> DataFrame:
    return M.tokens(M.sentences(read(spark, folder, "documents")))


def titles_of(spark: SparkSession, folder: str) -> DataFrame:
    """The title list: entries, and pairs of words from the entries' example sentences."""
    glosses = read(spark, folder, "glosses")
    pair = F.regexp_extract(F.lower(F.col("e.rendering")), r"^(?:[\p{L}]+ )?([\p{L}]+ [\p{L}]+)", 1)
    phrases = glosses.select(F.explode("examples").alias("e")).select(pair.alias("title")).where("title <> ''")
    return glosses.select(F.col("entry").alias("title")).unionAll(phrases).where("title is not null").distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    return M.matches(M.sentences(read(spark, folder, "documents")), titles_of(spark, folder))


def doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's dictionary terms: maximal matches, the first of each title, with a key, known keys left out."""
    best = M.maximal(found(spark, folder))
    once = M.first_by_surface(best, ["doc_id"], "title", ["sent", "first"])
    keyed = once.select("doc_id", "title", "sent", "first", "last", gloss_key(F.col("title"), F.lit("term")).alias("key"))
    known = read(spark, folder, "deck").where("gloss_key is not null").select(F.col("gloss_key").alias("key")).distinct()
    return keyed.join(known, "key", "left_anti").select("doc_id", "title", "sent", "first", "last", "key")


QUERIES = {
    "src_lines": lambda s, d: read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")),
    "src_concat": lambda s, d: ordered_scan(
        read(s, d, "documents").where("text is not null").select("source", "doc_id", (F.length(F.trim("text")) + 2).cast("long").alias("room"), F.floor(F.col("doc_id") / 512).alias("block")),
        ["source"], "block", ["doc_id"], total={"upto": "room"},
    ).select("source", "doc_id", (F.col("upto") - F.col("room")).alias("starts_at")),
    "doc_sentences": lambda s, d: M.sentences(read(s, d, "documents")),
    "vocabulary": lambda s, d: M.vocabulary(words_of(s, d)),
    "title_scan": lambda s, d: titles_of(s, d).select(F.translate(F.trim("title"), "_", " ").alias("title")).where("title <> ''").distinct(),
    "title_words": lambda s, d: M.title_words(titles_of(s, d), M.vocabulary(words_of(s, d))),
    "title_reachable": lambda s, d: M.reachable_titles(titles_of(s, d), M.vocabulary(words_of(s, d))),
    "title_runs": lambda s, d: M.spelled_titles(titles_of(s, d), M.token_runs(M.tokens(M.sentences(read(s, d, "documents").where("lang in ('ja', 'zh')"))))),
    "runs": lambda s, d: M.token_runs(M.tokens(M.sentences(read(s, d, "documents").where("lang in ('ja', 'zh')")))).groupBy("doc_id").agg(
        F.count_distinct("run").alias("n_runs")
    ),
    "match_words": lambda s, d: found(s, d).where("first = last"),
    "match_roots": lambda s, d: words_of(s, d).join(M.title_tokens(titles_of(s, d)).where("n > 1").select("title", F.element_at("words", 1).alias("word")), "word").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_candidates")
    ),
    "match_chain": lambda s, d: found(s, d).where("first < last"),
    "maximal_match": lambda s, d: M.maximal(found(s, d)),
    "term_groups": lambda s, d: M.term_groups(found(s, d)).withColumn("titles", F.array_join("titles", "|")),
    "uncovered_runs": lambda s, d: M.uncovered_runs(words_of(s, d), found(s, d)),
    "doc_terms": doc_terms,
}

SENTENCES = r"""s AS (
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n[ \t]*\n', chr(1), 'g'),
            '([.!?。！？…]+)[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE {where})))"""
ALL = SENTENCES.replace("{where}", "text IS NOT NULL")
TOKENS = r""", t AS (
    SELECT doc_id, sent, CAST(i - 1 AS INTEGER) AS tok, words[i] AS word FROM (SELECT doc_id, sent, words, unnest(range(1, len(words) + 1)) AS i FROM (
        SELECT doc_id, sent, list_filter(string_split_regex(lower(sentence), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS words FROM s)))"""
TITLES = r""", titles AS (
    SELECT DISTINCT entry AS title FROM glosses WHERE entry IS NOT NULL
    UNION SELECT x FROM (SELECT regexp_extract(lower(e.rendering), '^(?:[\p{L}]+ )?([\p{L}]+ [\p{L}]+)', 1) AS x
        FROM (SELECT unnest(examples) AS e FROM glosses)) WHERE x <> '')"""
FOUND = r""", tw AS (
    SELECT title, list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS words FROM titles
), sw AS (
    SELECT doc_id, sent, list_filter(string_split_regex(lower(sentence), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS all_words FROM s
), f AS (
    SELECT t.doc_id, t.sent, tok AS first, CAST(tok + len(words) - 1 AS INTEGER) AS last, title
    FROM t JOIN sw ON t.doc_id = sw.doc_id AND t.sent = sw.sent JOIN tw ON t.word = tw.words[1]
    WHERE all_words[tok + 1:tok + len(words)] = words
)"""
BASE = "WITH " + ALL + TOKENS
MATCHED = BASE + TITLES + FOUND
UNSPACED = "WITH " + SENTENCES.replace("{where}", "lang IN ('ja', 'zh') AND text IS NOT NULL") + TOKENS
RUNS = """, r AS (
    SELECT a.doc_id, a.sent, a.tok, n, array_to_string(ahead[1:n], '') AS run FROM (
        SELECT *, unnest(range(2, 9)) AS n FROM (SELECT doc_id, sent, tok, list(word) OVER (PARTITION BY doc_id, sent ORDER BY tok
            ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead FROM t)) a WHERE n <= len(ahead))"""
MAXIMAL = """, m AS (
    SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.sent = f.sent AND g.first <= f.first AND g.last >= f.last
        AND g.last - g.first > f.last - f.first))"""
SQL = {
    "src_lines": """SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""",
    "src_concat": """SELECT source, doc_id, CAST(sum(length(trim(text)) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)
        - length(trim(text)) - 2 AS BIGINT) AS starts_at FROM documents WHERE text IS NOT NULL""",
    "doc_sentences": f"WITH {ALL} SELECT * FROM s",
    "vocabulary": BASE + " SELECT DISTINCT word FROM t",
    "title_scan": BASE + TITLES + " SELECT DISTINCT replace(trim(title), '_', ' ') AS title FROM titles WHERE trim(title) <> ''",
    "title_words": BASE + TITLES + " SELECT DISTINCT title FROM titles WHERE lower(rtrim(title, '־')) IN (SELECT word FROM t)",
    "title_reachable": BASE + TITLES + r""", v AS (SELECT DISTINCT word FROM t),
        p AS (SELECT title, unnest(list_filter(string_split_regex(lower(title), '[\s\p{Z}]+'), lambda x: x <> '')) AS part FROM titles),
        c AS (SELECT title, part, list_filter(string_split_regex(part, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS chunks FROM p),
        k AS (SELECT title, part, part IN (SELECT word FROM v) AS whole, chunks, list_filter(chunks, lambda x: x <> part) AS other FROM c),
        o AS (SELECT title, part, whole, len(other) AS n, (SELECT count(*) FROM (SELECT unnest(k.other) AS x) WHERE x IN (SELECT word FROM v)) AS hits FROM k)
        SELECT title FROM o GROUP BY title HAVING bool_and(whole OR (n > 0 AND hits = n))""",
    "title_runs": UNSPACED + TITLES + RUNS + " SELECT title FROM titles WHERE title IN (SELECT run FROM r)",
    "runs": UNSPACED + RUNS + " SELECT doc_id, count(DISTINCT run) AS n_runs FROM r GROUP BY doc_id",
    "match_words": MATCHED + " SELECT * FROM f WHERE first = last",
    "match_roots": MATCHED + " SELECT doc_id, count(*) AS n_candidates FROM t JOIN tw ON t.word = tw.words[1] WHERE len(words) > 1 GROUP BY doc_id",
    "match_chain": MATCHED + " SELECT * FROM f WHERE first < last",
    "maximal_match": MATCHED + MAXIMAL + " SELECT * FROM m",
    "term_groups": MATCHED + " SELECT doc_id, sent, first, last, array_to_string(list_sort(list(DISTINCT title)), '|') AS titles FROM f GROUP BY doc_id, sent, first, last",
    "uncovered_runs": MATCHED + r""", u AS (
        SELECT *, tok - row_number() OVER (PARTITION BY doc_id, sent ORDER BY tok) AS k FROM t
        WHERE NOT regexp_matches(word, '^\p{Nd}+$') AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = t.doc_id AND f.sent = t.sent AND t.tok BETWEEN f.first AND f.last))
        SELECT doc_id, sent, min(tok) AS first, max(tok) AS last, string_agg(word, ' ' ORDER BY tok) AS run FROM u GROUP BY doc_id, sent, k""",
    "doc_terms": MATCHED + MAXIMAL + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY sent, first) AS n FROM m)
        SELECT * FROM (SELECT doc_id, title, sent, first, last, substr(sha256(title || chr(10) || 'term'), 1, 16) AS key FROM o WHERE n = 1)
        WHERE key NOT IN (SELECT gloss_key FROM deck WHERE gloss_key IS NOT NULL)""",
}
