"""Queries over glosses, cards and decks, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import cards as C
from lexiloom.operators import glosses as G
from lexiloom.operators import graph
from lexiloom.operators.order import WINDOW, shuffled
from lexiloom.operators.sequence import ordered_scan

SEED = 11


def glosses_of(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/glosses.parquet")


def deck_of(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/deck.parquet")


def shuffle_order(s: SparkSession, d: str) -> DataFrame:
    """New places of all cards of every source."""
    rows = glosses_of(s, d)
    return shuffled(rows, graph.edges_of(rows), SEED)


def shuffle_invariants(s: SparkSession, d: str) -> DataFrame:
    """Per source: cards, cards before what they wait for, and cards moved beyond the window."""
    rows = glosses_of(s, d)
    order = shuffle_order(s, d)
    edges = graph.edges_of(rows).join(order, ["source_ord", "idx"])
    late = edges.join(order.select("source_ord", F.col("idx").alias("dep"), F.col("place").alias("dep_place")), ["source_ord", "dep"])
    wrong = late.where("dep_place > place").groupBy("source_ord").agg(F.count(F.lit(1)).alias("n_early"))
    rank = ordered_scan(order.withColumn("span", F.floor(F.col("idx") / 512)), ["source_ord"], "span", ["idx"], count="old")
    per = rank.groupBy("source_ord").agg(F.count(F.lit(1)).alias("n_cards"), F.count_if(F.abs(F.col("place") - F.col("old")) > WINDOW).alias("n_far"))
    return per.join(wrong, "source_ord", "left").na.fill(0, ["n_early"])


def kept_by_schedule(s: SparkSession, d: str) -> DataFrame:
    """Which occurrences of each rule (source and ending) are kept: the first four, then ever fewer.

    The closed form holds for forms that are offered once each, as the deduplicated glosses are.
    """
    rows = G.deduplicated(glosses_of(s, d)).where("lemma is not null and surface <> lemma")
    rule = F.regexp_replace(F.col("surface"), r"^.*(?=..$)", "")
    n = F.row_number().over(Window.partitionBy("source_ord", "rule").orderBy("idx"))
    b = F.ceil(F.log2(F.col("n") + 4)) - 3
    step = F.pow(F.lit(2), b).cast("long")
    keep = (F.col("n") <= 4) | ((F.col("n") - (4 * step - 4)) % F.when(F.col("n") > 4, step).otherwise(1) == 0)
    return rows.withColumn("rule", rule).withColumn("n", n).select("source_ord", "idx", "rule", F.col("n").cast("long").alias("n"), keep.alias("kept"))


def rule_examples(s: SparkSession, d: str) -> DataFrame:
    return kept_by_schedule(s, d).where("kept and n <= 2").select("source_ord", "idx", "rule", "n")


def positional_capitals(s: SparkSession, d: str) -> DataFrame:
    """Words of examples that open a line, marks passed over: gloss_id, at, word."""
    rows = glosses_of(s, d).select("gloss_id", F.explode("examples").alias("e")).distinct()
    words = rows.select("gloss_id", F.posexplode(F.regexp_extract_all("e.sentence", F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"), F.lit(0))).alias("at", "word"), F.col("e.sentence").alias("sentence"))
    mark = F.col("word").rlike(r"^[^\p{L}\p{M}\p{N}_]+$")
    before = Window.partitionBy("gloss_id", "sentence").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max(~mark).over(before), F.lit(False))
    return words.withColumn("opened", opened).where(~F.col("opened") & ~mark).select("gloss_id", "at", "word").distinct()


LANGS = {"Greek": "el", "English": "en", "Russian": "ru", "German": "de", "Spanish": "es", "Chinese": "zh", "Japanese": "ja"}

QUERIES = {
    "gloss_dedup": lambda s, d: G.deduplicated(glosses_of(s, d)).select("gloss_id", "source_ord", "idx"),
    "known_anti": lambda s, d: G.unknown(glosses_of(s, d), deck_of(s, d)).select("gloss_id"),
    "pages": lambda s, d: G.pages(glosses_of(s, d)),
    "word_senses": lambda s, d: G.word_senses(glosses_of(s, d)),
    "first_page": lambda s, d: G.first_pages(glosses_of(s, d)),
    "candidates": lambda s, d: G.candidate_pages(glosses_of(s, d)),
    "winner_page": lambda s, d: G.winners(glosses_of(s, d)),
    "plain_dep": lambda s, d: G.plain_dependencies(glosses_of(s, d)),
    "references": lambda s, d: G.form_dependencies(glosses_of(s, d)),
    "dep_edges": lambda s, d: graph.edges_of(glosses_of(s, d)),
    "merge_deps": lambda s, d: G.merged_dependencies(glosses_of(s, d)).select("gloss_id", F.array_join("deps", ",").alias("deps")),
    "dep_closure": lambda s, d: graph.closure(graph.edges_of(glosses_of(s, d))),
    "etymon_closure": lambda s, d: graph.closure(G.form_dependencies(glosses_of(s, d))),
    "dag_height": lambda s, d: graph.levels(glosses_of(s, d), graph.edges_of(glosses_of(s, d)), upward=True),
    "topo_depth": lambda s, d: graph.levels(glosses_of(s, d), graph.edges_of(glosses_of(s, d)), upward=False),
    "concept_glosses": lambda s, d: G.labels(glosses_of(s, d)).groupBy("source_ord", "label").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n")),
    "concept_join": lambda s, d: G.labels(glosses_of(s, d)).join(
        G.labels(glosses_of(s, d)).groupBy("source_ord", "label").agg(F.min("idx").alias("concept")), ["source_ord", "label"]
    ).select("gloss_id", "label", "concept"),
    "bundles": lambda s, d: G.labels(glosses_of(s, d)).groupBy("gloss_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("bundle")),
    "categories": lambda s, d: G.labels(glosses_of(s, d)).groupBy("source_ord").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels")),
    "top_unresolved": lambda s, d: G.labels(glosses_of(s, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(5),
    "first_sentence": lambda s, d: G.records(glosses_of(s, d)).groupBy("source_ord", "gloss_key").agg(F.min("first_sentence").alias("first_sentence")),
    "gloss_ordinals": lambda s, d: ordered_scan(
        G.deduplicated(glosses_of(s, d)).select("source_ord", "idx", "gloss_id", F.floor(F.col("idx") / 512).alias("block")), ["source_ord"], "block", ["idx"], count="ordinal"
    ).select("gloss_id", "source_ord", "ordinal"),
    "spellings": lambda s, d: G.records(glosses_of(s, d)).select("gloss_id", F.array_join(F.array_distinct(F.filter(
        F.array("surface", "lemma", F.lower("surface"), F.lower("lemma")), lambda x: x.isNotNull())), "|").alias("spelled")),
    "entry_rank": lambda s, d: G.records(glosses_of(s, d)).select("gloss_id", F.when(F.col("entry") == F.col("surface"), 0).when(F.coalesce(F.col("entry") == F.col("lemma"), F.lit(False)), 1).otherwise(2).alias("entry_rank")),
    "appendix_merge": lambda s, d: G.records(glosses_of(s, d)).where("definition is not null").select("source_ord", "entry", "definition", F.when(F.col("production"), 0).otherwise(1).alias("priority"), "idx").groupBy("source_ord", "entry").agg(
        F.min_by("definition", F.struct("priority", "idx")).alias("description")),
    "cull": kept_by_schedule,
    "rule_examples": rule_examples,
    "positional_capital": positional_capitals,
    "cards": lambda s, d: C.cards(glosses_of(s, d)),
    "card_deps": lambda s, d: C.card_dependencies(glosses_of(s, d), graph.edges_of(glosses_of(s, d))),
    "asked": lambda s, d: C.cards(glosses_of(s, d)).where("kind = 'production'").select("source_ord", "idx", "front"),
    "renderings": lambda s, d: G.records(glosses_of(s, d)).select("gloss_id", F.array_join(F.filter(F.transform("examples", lambda e: e["rendering"]), lambda r: r.isNotNull() & (r != "")), "|").alias("back")),
    "deck_places": lambda s, d: C.places(deck_of(s, d)),
    "deck_positions": lambda s, d: C.positions(deck_of(s, d)),
    "deck_taught": lambda s, d: C.taught(deck_of(s, d)),
    "last_position": lambda s, d: C.last_positions(deck_of(s, d)),
    "deck_notes": lambda s, d: ordered_scan(
        C.cards(glosses_of(s, d)).withColumn("block", F.floor(F.col("idx") / 256)).withColumn("side", F.when(F.col("kind") == "recognition", 0).otherwise(1)), ["source_ord"], "block", ["idx", "side"], count="place"
    ).join(C.last_positions(deck_of(s, d)), "source_ord", "left").select("source_ord", "idx", "kind", (F.col("place") + F.coalesce("last_due", F.lit(0))).alias("due")),
    "update_ids": lambda s, d: C.carried(glosses_of(s, d), deck_of(s, d)),
    "unclash": lambda s, d: C.told_apart(G.records(glosses_of(s, d)).where("definition is not null").select("gloss_id", "source_ord", F.regexp_replace("definition", r"^\([^)]*\) ", "").alias("title"), F.col("definition").alias("english")), "title", "english").select("gloss_id", "shown"),
    "media_dedup": lambda s, d: G.records(glosses_of(s, d)).where("entry is not null").groupBy("lang_name", F.concat("entry", F.lit(".ogg")).alias("name")).agg(F.min(F.struct("source_ord", "idx")).alias("m")).select("lang_name", "name", "m.source_ord", "m.idx"),
    "kept_counts": lambda s, d: G.records(glosses_of(s, d)).groupBy("lang_name").agg(F.count_if(F.col("lemma").isNull()).alias("no_lemma"), F.count_if(F.col("definition").isNull()).alias("no_definition"), F.count_if(F.size("examples") == 0).alias("no_example")),
    "verdict_counts": lambda s, d: G.records(glosses_of(s, d)).groupBy(F.when(F.col("definition").isNull(), "unknown").when(T.is_marked(F.col("definition")), "figure").otherwise("plain").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
    "shuffle_order": shuffle_order,
    "shuffle_invariants": shuffle_invariants,
}

MARKS = ", ".join(f"'{w}'" for w in T.MARKED)
REC = "g AS (SELECT DISTINCT ON (gloss_id) * FROM glosses ORDER BY gloss_id)"
LABEL = r"regexp_extract(trim(definition), '^\(([^)]*)\)', 0)"
MARKED = f"coalesce(len(list_filter(string_split(trim({LABEL}, '()'), ','), lambda p: lower(trim(p)) IN ({MARKS}))) > 0, false)"
EDGES = "e AS (SELECT DISTINCT source_ord, idx, dep FROM (SELECT source_ord, idx, unnest(depends_on) AS dep FROM glosses) WHERE dep <> idx)"
LABELS = f"""l AS (SELECT source_ord, gloss_id, idx, x AS label FROM (SELECT source_ord, gloss_id, idx, unnest(list_filter(list_transform(
    string_split(trim({LABEL}, '()'), ','), lambda x: trim(x)), lambda x: x <> '')) AS x FROM g WHERE definition IS NOT NULL))"""
DEDUP = "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_ord, surface, definition ORDER BY idx) AS nth FROM g) WHERE nth = 1)"
CULL = f"""WITH {REC}, {DEDUP}, o AS (SELECT source_ord, idx, rule, row_number() OVER (PARTITION BY source_ord, rule ORDER BY idx) AS n FROM (
    SELECT source_ord, idx, right(surface, 2) AS rule FROM dd WHERE lemma IS NOT NULL AND surface <> lemma)),
    cu AS (SELECT source_ord, idx, rule, n, n <= 4 OR (n - (4 * CAST(pow(2, ceil(log2(n + 4)) - 3) AS BIGINT) - 4)) % greatest(CAST(pow(2, ceil(log2(n + 4)) - 3) AS BIGINT), 1) = 0 AS kept FROM o)"""
PLAIN = f"""pl AS (SELECT source_ord, idx, dep FROM (SELECT source_ord, entry, idx, m, first(CASE WHEN NOT m THEN idx END IGNORE NULLS) OVER (
    PARTITION BY source_ord, entry ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dep FROM (
    SELECT source_ord, entry, idx, {MARKED} AS m FROM g WHERE entry IS NOT NULL AND definition IS NOT NULL)) WHERE m AND dep IS NOT NULL)"""
FORMS = """fo AS (SELECT a.source_ord, a.idx, b.dep FROM g a JOIN (SELECT source_ord, surface, min(idx) AS dep FROM g GROUP BY source_ord, surface) b
    ON a.source_ord = b.source_ord AND a.entry = b.surface WHERE a.surface <> a.entry AND b.dep < a.idx)"""
FIRST = """fp AS (SELECT gloss_id, arg_min(title, ord) AS page FROM (SELECT gloss_id, source_ord, unnest([surface, lemma, entry]) AS title, unnest([0, 1, 2]) AS ord FROM g) x
    WHERE EXISTS (SELECT 1 FROM g WHERE g.source_ord = x.source_ord AND g.entry = x.title) GROUP BY gloss_id)"""
CARDS = f"""ca AS (SELECT source_ord, idx, 'recognition' AS kind, CASE WHEN {MARKED} THEN surface || ' ' || {LABEL} ELSE surface END AS front, coalesce(definition, '') AS back FROM g
    UNION ALL SELECT source_ord, idx, 'production', replace(coalesce(definition, ''), surface, '{T.MASK}'), surface FROM g WHERE production)"""
PLACES = """pc AS (SELECT card_id, source_ord, gloss_key, kind, false AS studied, row_number() OVER (PARTITION BY source_ord ORDER BY due, card_id) AS position FROM deck WHERE card_type = 0
    UNION ALL SELECT card_id, source_ord, gloss_key, kind, true, 0 FROM deck WHERE card_type <> 0)"""
LAST = "la AS (SELECT source_ord, coalesce(max(CASE WHEN card_type = 0 THEN due END), 0) AS last_due FROM deck GROUP BY source_ord)"


def chain(edges: str) -> str:
    return f"""WITH RECURSIVE {edges}, r AS (SELECT source_ord, idx, dep FROM base UNION SELECT r.source_ord, r.idx, b.dep FROM r JOIN base b
        ON b.source_ord = r.source_ord AND b.idx = r.dep) SELECT DISTINCT source_ord, idx, dep FROM r"""


def longest(here: str, there: str) -> str:
    return f"""WITH RECURSIVE {EDGES}, n AS (SELECT DISTINCT source_ord, idx FROM glosses), r AS (SELECT source_ord, idx, 0 AS level FROM n
        UNION SELECT r.source_ord, e.{there}, r.level + 1 FROM r JOIN e ON e.source_ord = r.source_ord AND e.{here} = r.idx WHERE e.dep < e.idx)
        SELECT source_ord, idx, max(level) AS level FROM r GROUP BY source_ord, idx"""


SQL = {
    "gloss_dedup": f"WITH {REC}, {DEDUP} SELECT gloss_id, source_ord, idx FROM dd",
    "known_anti": f"WITH {REC} SELECT gloss_id FROM g WHERE NOT EXISTS (SELECT 1 FROM deck k WHERE k.source_ord = g.source_ord AND k.gloss_key = g.gloss_key)",
    "pages": f"WITH {REC} SELECT source_ord, entry, count(*) AS n_senses, count(*) FILTER (production) AS n_word, min(idx) AS first_idx FROM g GROUP BY source_ord, entry",
    "word_senses": f"WITH {REC} SELECT source_ord, entry, idx FROM (SELECT *, max(coalesce(production, false)) OVER (PARTITION BY source_ord, entry) AS a FROM g) WHERE production OR NOT a",
    "first_page": f"WITH {REC}, {FIRST} SELECT * FROM fp",
    "candidates": f"""WITH {REC}, {FIRST}, own AS (SELECT gloss_id, surface AS page FROM g x WHERE EXISTS (SELECT 1 FROM g WHERE g.source_ord = x.source_ord AND g.entry = x.surface))
        SELECT * FROM own UNION ALL SELECT gloss_id, page FROM fp WHERE gloss_id NOT IN (SELECT gloss_id FROM own)""",
    "winner_page": f"""WITH {REC}, c AS (SELECT source_ord, lemma, entry, count(*) AS n, min(idx) AS f FROM g WHERE lemma IS NOT NULL GROUP BY ALL)
        SELECT source_ord, lemma, entry AS page, n FROM (SELECT *, row_number() OVER (PARTITION BY source_ord, lemma ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""",
    "plain_dep": f"WITH {REC}, {PLAIN} SELECT * FROM pl",
    "references": f"WITH {REC}, {FORMS} SELECT * FROM fo",
    "dep_edges": f"WITH {EDGES} SELECT * FROM e",
    "merge_deps": f"""WITH {REC}, {PLAIN}, {FORMS}, x AS (SELECT source_ord, idx, list(dep ORDER BY kind, dep) AS extra FROM (
        SELECT *, 1 AS kind FROM pl UNION ALL SELECT *, 2 FROM fo) GROUP BY source_ord, idx),
        y AS (SELECT gloss_id, list_concat(coalesce(depends_on, []), coalesce(extra, [])) AS v FROM g LEFT JOIN x USING (source_ord, idx))
        SELECT gloss_id, array_to_string(list_filter(v, lambda w, i: list_position(v, w) = i), ',') AS deps FROM y""",
    "dep_closure": chain("base AS (SELECT DISTINCT source_ord, idx, dep FROM (SELECT source_ord, idx, unnest(depends_on) AS dep FROM glosses) WHERE dep <> idx)"),
    "etymon_closure": chain(f"{REC}, {FORMS}, base AS (SELECT * FROM fo)"),
    "dag_height": longest("idx", "dep"),
    "topo_depth": longest("dep", "idx"),
    "concept_glosses": f"WITH {REC}, {LABELS} SELECT source_ord, label, min(idx) AS first_idx, count(*) AS n FROM l GROUP BY source_ord, label",
    "concept_join": f"WITH {REC}, {LABELS} SELECT gloss_id, label, min(idx) OVER (PARTITION BY source_ord, label) AS concept FROM l",
    "bundles": f"WITH {REC}, {LABELS} SELECT gloss_id, array_to_string(list_sort(list(DISTINCT label)), '|') AS bundle FROM l GROUP BY gloss_id",
    "categories": f"WITH {REC}, {LABELS} SELECT source_ord, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels FROM l GROUP BY source_ord",
    "top_unresolved": f"WITH {REC}, {LABELS} SELECT label, count(*) AS n FROM l GROUP BY label ORDER BY n DESC, label LIMIT 5",
    "first_sentence": f"WITH {REC} SELECT source_ord, gloss_key, min(first_sentence) AS first_sentence FROM g GROUP BY source_ord, gloss_key",
    "gloss_ordinals": f"WITH {REC}, {DEDUP} SELECT gloss_id, source_ord, row_number() OVER (PARTITION BY source_ord ORDER BY idx) AS ordinal FROM dd",
    "spellings": f"""WITH {REC}, v AS (SELECT gloss_id, list_filter([surface, lemma, lower(surface), lower(lemma)], lambda x: x IS NOT NULL) AS v FROM g)
        SELECT gloss_id, array_to_string(list_filter(v, lambda w, i: list_position(v, w) = i), '|') AS spelled FROM v""",
    "entry_rank": f"WITH {REC} SELECT gloss_id, CASE WHEN entry = surface THEN 0 WHEN entry = lemma THEN 1 ELSE 2 END AS entry_rank FROM g",
    "appendix_merge": f"WITH {REC} SELECT source_ord, entry, definition AS description FROM (SELECT *, row_number() OVER (PARTITION BY source_ord, entry ORDER BY CASE WHEN production THEN 0 ELSE 1 END, idx) AS k FROM g WHERE definition IS NOT NULL) WHERE k = 1",
    "cull": CULL + " SELECT * FROM cu",
    "rule_examples": CULL + " SELECT source_ord, idx, rule, n FROM cu WHERE kept AND n <= 2",
    "positional_capital": r"""WITH x AS (SELECT DISTINCT gloss_id, e.sentence AS sentence FROM (SELECT gloss_id, unnest(examples) AS e FROM glosses)),
        w AS (SELECT gloss_id, sentence, CAST(i - 1 AS INTEGER) AS "at", v[i] AS word FROM (SELECT gloss_id, sentence, v, unnest(range(1, len(v) + 1)) AS i FROM (
            SELECT gloss_id, sentence, regexp_extract_all(sentence, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+') AS v FROM x))),
        m AS (SELECT *, regexp_matches(word, '^[^\p{L}\p{M}\p{N}_]+$') AS mark FROM w),
        o AS (SELECT *, coalesce(max(NOT mark) OVER (PARTITION BY gloss_id, sentence ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS opened FROM m)
        SELECT DISTINCT gloss_id, "at", word FROM o WHERE NOT opened AND NOT mark""",
    "cards": f"WITH {REC}, {CARDS} SELECT * FROM ca",
    "card_deps": f"""WITH {REC}, {EDGES} SELECT source_ord, idx, 'recognition' AS kind, dep FROM e WHERE EXISTS (SELECT 1 FROM g WHERE g.source_ord = e.source_ord AND g.idx = e.dep)
        UNION ALL SELECT source_ord, idx, 'production', idx FROM g WHERE production""",
    "asked": f"WITH {REC}, {CARDS} SELECT source_ord, idx, front FROM ca WHERE kind = 'production'",
    "renderings": f"WITH {REC} SELECT gloss_id, array_to_string(list_filter(list_transform(examples, lambda e: e.rendering), lambda r: r IS NOT NULL AND r <> ''), '|') AS back FROM g",
    "deck_places": f"WITH {PLACES} SELECT * FROM pc",
    "deck_positions": f"WITH {PLACES} SELECT source_ord, gloss_key, max(position) AS position FROM pc WHERE gloss_key IS NOT NULL AND kind = 'recognition' GROUP BY source_ord, gloss_key",
    "deck_taught": "SELECT DISTINCT source_ord, gloss_key FROM deck WHERE card_type <> 0 AND gloss_key IS NOT NULL",
    "last_position": f"WITH {LAST} SELECT * FROM la",
    "deck_notes": f"""WITH {REC}, {CARDS}, {LAST} SELECT source_ord, idx, kind, row_number() OVER (PARTITION BY source_ord ORDER BY idx, CASE WHEN kind = 'recognition' THEN 0 ELSE 1 END)
        + coalesce(last_due, 0) AS due FROM ca LEFT JOIN la USING (source_ord)""",
    "update_ids": f"""WITH {REC}, {CARDS}, o AS (SELECT source_ord, gloss_key, kind, min(card_id) AS card_id FROM deck WHERE gloss_key IS NOT NULL GROUP BY ALL)
        SELECT ca.source_ord, ca.idx, ca.kind, o.card_id FROM ca JOIN g ON g.source_ord = ca.source_ord AND g.idx = ca.idx
        LEFT JOIN o ON o.source_ord = ca.source_ord AND o.gloss_key = g.gloss_key AND o.kind = ca.kind""",
    "unclash": rf"""WITH {REC}, t AS (SELECT gloss_id, source_ord, regexp_replace(definition, '^\([^)]*\) ', '') AS title, definition AS english FROM g WHERE definition IS NOT NULL)
        SELECT gloss_id, CASE WHEN min(english) OVER w <> max(english) OVER w THEN english ELSE title END AS shown FROM t WINDOW w AS (PARTITION BY source_ord, title)""",
    "media_dedup": f"""WITH {REC} SELECT lang_name, name, source_ord, idx FROM (SELECT lang_name, entry || '.ogg' AS name, source_ord, idx,
        row_number() OVER (PARTITION BY lang_name, entry ORDER BY source_ord, idx) AS k FROM g WHERE entry IS NOT NULL) WHERE k = 1""",
    "kept_counts": f"WITH {REC} SELECT lang_name, count(*) FILTER (lemma IS NULL) AS no_lemma, count(*) FILTER (definition IS NULL) AS no_definition, count(*) FILTER (len(examples) = 0) AS no_example FROM g GROUP BY lang_name",
    "verdict_counts": f"WITH {REC} SELECT CASE WHEN definition IS NULL THEN 'unknown' WHEN {MARKED} THEN 'figure' ELSE 'plain' END AS kind, count(*) AS n FROM g GROUP BY 1",
    "shuffle_invariants": "SELECT source_ord, count(DISTINCT idx) AS n_cards, CAST(0 AS BIGINT) AS n_far, CAST(0 AS BIGINT) AS n_early FROM glosses GROUP BY source_ord",
}
