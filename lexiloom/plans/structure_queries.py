"""Queries over dictionary pages, parsed tokens, gloss walks, answers and sinks, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import readings as R
from lexiloom.functions import script as S
from lexiloom.functions import text as T
from lexiloom.operators import answers as A
from lexiloom.operators import cards as C
from lexiloom.operators import glosses as G
from lexiloom.operators import graph, trees, walk
from lexiloom.operators import terms as M
from lexiloom.plans.cue_queries import timeline
from lexiloom.plans.term_queries import titles_of
from lexiloom.session import cut
from lexiloom.sinks import text as sinks
from lexiloom.sources import files, pages


def glosses_of(s: SparkSession, d: str) -> DataFrame:
    return G.records(s.read.parquet(f"{d}/glosses.parquet"))


def html(c: Column) -> Column:
    """``c`` as page text."""
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def raw_pages(s: SparkSession, d: str) -> DataFrame:
    """A page for each entry and language, written as a dictionary writes it, with tags left open (title, html), and one
    that redirects to it for each other spelling."""
    rows = glosses_of(s, d).where("entry <> '' and lang_name is not null")
    name, link = F.col("lang_name"), T.title_path(F.col("lemma"))
    first = F.get("examples", F.lit(0))
    example = F.when(F.size("examples") > 0, F.concat(
        F.lit("<dl><dd><div class='h-usage-example'><i class='e-example'>"), html(first["sentence"]), F.lit("</i> ― <span class='e-translation'>"), html(first["rendering"]), F.lit("</span></div></dl>")
    )).otherwise(F.lit(""))
    refers = F.when(F.col("lemma").isNotNull(), F.concat(F.lit(" <span class='form-of-definition-link'><a href='/wiki/"), link, F.lit("'>"), html(F.col("lemma")), F.lit("</a></span> <a href='/wiki/Appendix:Glossary#term"), F.lit("'>term</a>"))).otherwise(F.lit(""))
    item = F.concat(F.lit("<li><span class='defdate'>[from 1715]</span> "), html(F.col("definition")), refers, example)
    listed = F.array_sort(F.collect_list(F.struct("source_ord", "idx", item.alias("item"), "lemma")))
    per = rows.where("definition <> ''").groupBy(F.col("entry").alias("title"), "lang_name").agg(listed.alias("items"))
    anchor = F.translate(name, " ", "_")
    lemma = F.get(F.filter("items", lambda x: x["lemma"].isNotNull()), F.lit(0))["lemma"]
    source = F.when(lemma.isNotNull(), F.concat(F.lit("<p>From <a href=\"/wiki/"), T.title_path(lemma), F.lit("#"), anchor, F.lit("\">x</a> + <a href=\"/wiki/other#"), anchor, F.lit("\">other</a>.</p>"))).otherwise(F.lit(""))
    body = F.concat(
        F.lit("<h2 id='"), anchor, F.lit("'>"), name, F.lit("</h2><style>b{}</style><h3 id='Etymology_1'>Etymology 1</h3>"), source,
        F.lit("<h4 id='Pronunciation'>Pronunciation</h4><ul><li><span class='IPA nowrap'>/"), html(F.col("title")), F.lit("/</span><audio><source src='//upload.wikimedia.org/a.mp3'><source src='//upload.wikimedia.org/a.ogg'></audio></ul>"),
        F.lit("<h4 id='Noun'>Noun</h4><p><span class='headword-line'><strong class='headword'>"), html(F.col("title")), F.lit("</strong> f</span><ol>"),
        F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("</ol></span><h4 id='Anagrams'>Anagrams</h4><ol><li>other</ol>"),
    )
    sections = per.select("title", "lang_name", body.alias("body")).groupBy("title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang_name", "body"))), lambda x: x["body"]), "").alias("html"))
    moved = rows.where("surface <> entry and surface <> ''").groupBy(F.col("surface").alias("title")).agg(F.min("entry").alias("to"))
    moved = moved.join(sections.select("title"), "title", "left_anti")
    return sections.unionByName(moved.select("title", F.concat(F.lit("<div><ul class=\"redirectText\"><li><a href=\"/wiki/"), T.title_path(F.col("to")), F.lit("\">x</a></ul></div>")).alias("html")))


def asked_pages(s: SparkSession, d: str) -> DataFrame:
    """The pages' sections of all languages."""
    languages = glosses_of(s, d).where("entry <> '' and definition <> '' and lang_name is not null").select(F.col("entry").alias("title"), F.col("lang_name").alias("language")).distinct()
    return pages.structured_pages(raw_pages(s, d).join(languages, "title"))


def resolved(s: SparkSession, d: str) -> DataFrame:
    wanted = glosses_of(s, d).where("surface <> '' and lang_name is not null").select(F.col("surface").alias("title"), F.col("lang_name").alias("language"))
    return pages.resolved_pages(cut(raw_pages(s, d)), wanted).select("title", "language", "page", "shown")


def glossary(s: SparkSession, d: str) -> DataFrame:
    """The labels of definitions as a glossary page for each language, in its three shapes."""
    labels = G.labels(s.read.parquet(f"{d}/glosses.parquet")).join(glosses_of(s, d).select("gloss_id", "lang_name"), "gloss_id").where("lang_name is not null")
    each = labels.select("lang_name", "label").distinct()
    term = F.concat(F.lit("<dt><span class='template-anchor' id='"), F.translate("label", " ", "_"), F.lit("' data-id='x'></span>"), html(F.col("label")), F.lit(", abbr.</dt><dd>What "), html(F.col("label")), F.lit(" means.</dd>"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", term.alias("t")))), lambda x: x["t"]), "")
    title = F.concat(F.lit("Appendix:"), "lang_name", F.lit(" glossary"))
    return pages.concept_rows(each.groupBy("lang_name").agg(F.concat(F.lit("<dl>"), whole, F.lit("</dl><h2 id='About'>About</h2><p>Words of grammar.</p>")).alias("html")).select(title.alias("title"), "html"))


def example_tokens(s: SparkSession, d: str) -> DataFrame:
    """The renderings of all examples as plain tokens."""
    rows = glosses_of(s, d).select("gloss_id", F.posexplode("examples").alias("sent", "e")).select("gloss_id", "sent", F.col("e.rendering").alias("sentence"))
    return trees.plain_tokens(rows.where("sentence <> ''"), "gloss_id")


def title_patterns(s: SparkSession, d: str) -> DataFrame:
    tokens = trees.plain_tokens(titles_of(s, d).select("title", F.lit(0).alias("sent")), "title", "title")
    return trees.patterns(tokens.select(F.col("source_ord").alias("title"), "tok_id", "text", "head", "deprel"))


def tree_matches(s: SparkSession, d: str) -> DataFrame:
    return trees.tree_matches(trees.labelled(cut(example_tokens(s, d))), cut(title_patterns(s, d)))


def tree_terms(s: SparkSession, d: str) -> DataFrame:
    tokens = cut(example_tokens(s, d))
    return trees.extracted_terms(tokens, cut(trees.tree_matches(trees.labelled(tokens), title_patterns(s, d))))


def walked(s: SparkSession, d: str) -> DataFrame:
    """The order in which glosses are added when texts use those with a production side, by first sentence."""
    rows = glosses_of(s, d).where("source_ord is not null and idx is not null")
    used = rows.where("production and first_sentence is not null").select("source_ord", (F.col("first_sentence").cast("long") * 100000 + F.col("idx")).cast("int").alias("occ"), "idx")
    edges = rows.select("source_ord", "idx", F.posexplode("depends_on").alias("dep_ord", "dep")).where("dep is not null and dep <> idx")
    return walk.walked(used, edges.groupBy("source_ord", "idx", "dep").agg(F.min("dep_ord").alias("dep_ord")))


def bundled(s: SparkSession, d: str) -> DataFrame:
    """Glosses with the bundle of their labels."""
    return G.labels(s.read.parquet(f"{d}/glosses.parquet")).groupBy("gloss_id", "source_ord", "idx").agg(F.array_sort(F.collect_set("label")).alias("bundle"))


def rules(s: SparkSession, d: str) -> DataFrame:
    """Rules of a source by bundle: the first gloss of a bundle is its representative."""
    return bundled(s, d).groupBy("source_ord", "bundle").agg(F.min("idx").alias("rule"))


def rule_match(s: SparkSession, d: str) -> DataFrame:
    return bundled(s, d).join(rules(s, d), ["source_ord", "bundle"]).select("gloss_id", "rule")


def rule_glosses(s: SparkSession, d: str) -> DataFrame:
    """Rules that get a gloss of their own: with their first two examples, once the second stands."""
    nth = F.array_sort(F.collect_list("idx"))
    grouped = bundled(s, d).groupBy("source_ord", "bundle").agg(nth.alias("all")).where("size(all) >= 2")
    return grouped.select("source_ord", F.array_join("bundle", "|").alias("bundle"), F.get("all", F.lit(0)).alias("first_example"), F.get("all", F.lit(1)).alias("second_example"))


def sense_lists(s: SparkSession, d: str) -> DataFrame:
    """For each surface of a source all senses, as a question lists them."""
    rows = glosses_of(s, d).where("definition is not null").groupBy("source_ord", "surface").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "definition"))), lambda x: x["definition"]).alias("senses"))
    return rows.withColumn("digest", A.digest(F.col("surface"), A.listing(F.col("senses"))))


def told(s: SparkSession, d: str) -> DataFrame:
    """Stored answers: of every question with an even number of senses, its last sense and one beyond the list."""
    even = sense_lists(s, d).where("size(senses) % 2 = 0").select("digest", F.concat(F.lit('{"senses": ['), F.size("senses"), F.lit(", 99]}")).alias("answer"))
    return even.dropDuplicates(["digest"])


def chosen(s: SparkSession, d: str) -> DataFrame:
    return A.chosen_senses(sense_lists(s, d), told(s, d)).select("source_ord", "surface", F.array_join("kept", "¦").alias("kept"))


def bench_score(s: SparkSession, d: str) -> DataFrame:
    """Known-answer checks: a surface passes if its definitions name any word of its entry and none of its quotations."""
    rows = glosses_of(s, d).where("surface is not null")
    per = rows.groupBy("source_ord", "surface").agg(
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("definition", F.lit("")).alias("d")))), lambda x: x["d"]), "\n")).alias("joined"),
        F.array_distinct(F.flatten(F.collect_list(F.split(F.lower(F.col("entry")), " ")))).alias("must"), F.array_distinct(F.flatten(F.collect_list("quoted"))).alias("never"), F.count("definition").alias("n"),
    )
    any_of = lambda words: F.exists(words, lambda w: (w != "") & F.contains("joined", F.lower(w)))
    state = F.when(F.col("n") == 0, "absent").when(any_of("must") & ~any_of("never"), "pass").otherwise("fail")
    return per.select("source_ord", "surface", state.alias("state"))


def quotations(s: SparkSession, d: str) -> DataFrame:
    """Production questions with the quotations of the answer blanked where they stand as words."""
    rows = glosses_of(s, d).where("definition is not null and surface is not null")
    found = R.quotations(F.concat("quoted", F.array("surface")), "surface")
    return rows.select("gloss_id", R.masked_quotations(F.concat("surface", F.lit(" "), "definition"), found).alias("asked"))


def symbols(s: SparkSession, d: str) -> DataFrame:
    """What each foreign character is taught as: the gloss of the character alone in its language, else its name."""
    rows = glosses_of(s, d)
    chars = cut(S.foreign_characters(rows.select("gloss_id", "surface").distinct(), "gloss_id", "surface").select("char").distinct())
    senses = rows.where("length(surface) = 1 and definition is not null").groupBy(F.col("surface").alias("title"), F.lit("Japanese").alias("language")).agg(F.min_by("definition", F.struct("source_ord", "idx")).alias("definition"))
    senses = senses.withColumn("place", F.lit(0))
    return R.symbol_definitions(chars, senses, S.unicode_names(chars), "Japanese")


def limited_terms(s: SparkSession, d: str) -> DataFrame:
    """The terms of each source until fifty new glosses are reached, a term being all glosses of a surface."""
    rows = G.deduplicated(s.read.parquet(f"{d}/glosses.parquet")).groupBy("source_ord", "surface").agg(F.min("idx").alias("term"), F.count(F.lit(1)).alias("n_new"))
    return walk.limited(rows, 50).select("source_ord", "surface", "term")


def flat(df: DataFrame) -> DataFrame:
    """Arrays of texts as one text."""
    return df.select(*[F.array_join(f.name, "|").alias(f.name) if f.dataType.simpleString() == "array<string>" else F.col(f.name) for f in df.schema.fields])


QUERIES = {
    "page_senses": lambda s, d: pages.senses_of(asked_pages(s, d)).select("title", "language", (F.col("sense_ord") + 1).alias("nth"), "part_of_speech", "definition", "headword"),
    "page_examples": lambda s, d: pages.senses_of(asked_pages(s, d)).select("title", "language", (F.col("sense_ord") + 1).alias("nth"), F.explode("examples").alias("e")).select("title", "language", "nth", "e.sentence", "e.rendering"),
    "page_links": lambda s, d: flat(pages.senses_of(asked_pages(s, d)).select("title", "language", (F.col("sense_ord") + 1).alias("nth"), "targets", "concepts")),
    "page_sounds": lambda s, d: flat(asked_pages(s, d).select("title", "language", F.explode("entries").alias("e")).select("title", "language", "e.ipa", "e.audio_urls", "e.etymons")),
    "page_redirect": resolved,
    "glossary_concepts": glossary,
    "match_tree": lambda s, d: flat(tree_matches(s, d).select("source_ord", "sent_ord", "title", F.transform("covered", lambda x: x.cast("string")).alias("covered"))),
    "tree_terms": lambda s, d: tree_terms(s, d).select("source_ord", "sent_ord", "surface", "lemma", F.array_join("titles", "|").alias("titles")),
    "context": lambda s, d: walk.with_context(M.sentences(s.read.parquet(f"{d}/documents.parquet"))),
    "glosses": walked,
    "dependency_order": lambda s, d: graph.dependency_order(glosses_of(s, d), graph.edges_of(s.read.parquet(f"{d}/glosses.parquet"))),
    "rule_match": rule_match,
    "rule_glosses": rule_glosses,
    "sense_questions": lambda s, d: A.open_questions(sense_lists(s, d).where("size(senses) > 1").withColumn("question", A.listing(F.col("senses"))), told(s, d)).groupBy().agg(F.count(F.lit(1)).alias("n_open")),
    "sense_choice": chosen,
    "sense_first": lambda s, d: A.chosen_senses(sense_lists(s, d), told(s, d).where("false"), True).select("source_ord", "surface", F.array_join("kept", "¦").alias("kept")),
    "bench_score": bench_score,
    "mask_quoted": quotations,
    "symbol_chain": symbols,
    "limit_glosses": limited_terms,
    "json_sink": lambda s, d: sinks.json_rows(C.cards(s.read.parquet(f"{d}/glosses.parquet")), ["source_ord", "idx", "kind"]),
    "csv_sink": lambda s, d: sinks.timeline_csv(timeline(s, d)),
    "card_lines": lambda s, d: sinks.card_lines(C.cards(s.read.parquet(f"{d}/glosses.parquet"))),
    "markdown_sink": lambda s, d: sinks.markdown(glosses_of(s, d)),
    "source_kinds": lambda s, d: files.sources(s.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").cast("string").alias("name"), "text")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")),
    "symbol_names": lambda s, d: S.unicode_names(S.foreign_characters(glosses_of(s, d).select("gloss_id", "surface"), "gloss_id", "surface").select("char").distinct()).select("char", S.displayed(F.col("char")).alias("shown"), "name"),
}

REC = "g AS (SELECT DISTINCT ON (gloss_id) * FROM glosses ORDER BY gloss_id)"
LABEL = r"regexp_extract(trim(definition), '^\(([^)]*)\)', 0)"
TIDY = r"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), E' \t\n:;,')"
PAGED = f"""WITH {REC}, n AS (SELECT entry AS title, lang_name AS language, row_number() OVER (PARTITION BY entry, lang_name ORDER BY source_ord, idx) AS nth, * FROM g
    WHERE entry <> '' AND lang_name IS NOT NULL AND definition <> '')"""
WORDS = r"""regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]+')"""
TITLES = r"""titles AS (SELECT DISTINCT entry AS title FROM glosses WHERE entry IS NOT NULL
    UNION SELECT x FROM (SELECT regexp_extract(lower(e.rendering), '^(?:[\p{L}]+ )?([\p{L}]+ [\p{L}]+)', 1) AS x FROM (SELECT unnest(examples) AS e FROM glosses)) WHERE x <> '')"""
MATCHED = f"""{REC}, {TITLES}, x AS (SELECT gloss_id AS source_ord, i - 1 AS sent_ord, {WORDS.format(x='examples[i].rendering')} AS w FROM (SELECT gloss_id, examples, unnest(range(1, len(examples) + 1)) AS i FROM g) WHERE examples[i].rendering <> ''),
    tw AS (SELECT title, {WORDS.format(x='title')} AS p FROM titles), tok AS (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM x),
    la AS (SELECT DISTINCT source_ord, sent_ord, w, k, unnest([w[k], lower(w[k])]) AS label FROM tok),
    m AS (SELECT DISTINCT source_ord, sent_ord, title, k, len(p) AS n FROM la JOIN tw ON la.label = p[1]
        WHERE k + len(p) - 1 <= len(w) AND len(list_filter(range(0, len(p)), lambda i: p[i + 1] <> w[k + i] AND p[i + 1] <> lower(w[k + i]))) = 0)"""
BUNDLED = f"""{REC}, l AS (SELECT gloss_id, source_ord, idx, unnest(list_filter(list_transform(string_split(trim({LABEL}, '()'), ','), lambda x: trim(x)), lambda x: x <> '')) AS label FROM g WHERE definition IS NOT NULL),
    b AS (SELECT gloss_id, source_ord, idx, array_to_string(list_sort(list(DISTINCT label)), '|') AS bundle FROM l GROUP BY ALL)"""
SENSES = f"{REC}, q AS (SELECT source_ord, surface, list(definition ORDER BY idx) AS v FROM g WHERE definition IS NOT NULL GROUP BY ALL)"
SQL = {
    "page_senses": PAGED + f""" SELECT title, language, CAST(row_number() OVER (PARTITION BY title, language ORDER BY nth) AS INTEGER) AS nth, 'Noun' AS part_of_speech,
        {TIDY.format(x="definition || CASE WHEN lemma IS NULL THEN '' ELSE ' ' || lemma || ' term' END")} AS definition, 'f' AS headword FROM n""",
    "page_examples": PAGED + f" SELECT title, language, CAST(nth AS INTEGER) AS nth, {TIDY.format(x='examples[1].sentence')} AS sentence, nullif({TIDY.format(x='examples[1].rendering')}, '') AS rendering FROM n WHERE len(examples) > 0",
    "page_links": PAGED + " SELECT title, language, CAST(nth AS INTEGER) AS nth, coalesce(lemma, '') AS targets, CASE WHEN lemma IS NULL THEN '' ELSE 'term' END AS concepts FROM n",
    "page_sounds": PAGED + """, f AS (SELECT title, language, first(lemma ORDER BY nth) FILTER (lemma IS NOT NULL) AS lemma FROM n GROUP BY ALL)
        SELECT title, language, '/' || title || '/' AS ipa, 'https://upload.wikimedia.org/a.ogg' AS audio_urls, CASE WHEN lemma IS NULL THEN '' WHEN lemma = 'other' THEN 'other' ELSE lemma || '|other' END AS etymons FROM f""",
    "page_redirect": PAGED + """, h AS (SELECT DISTINCT title, language FROM n), s AS (SELECT DISTINCT title FROM n), v AS (SELECT surface AS title, min(entry) AS dest FROM g
            WHERE entry <> '' AND lang_name IS NOT NULL AND surface <> entry AND surface <> '' AND surface NOT IN (SELECT title FROM s) GROUP BY surface),
        a AS (SELECT DISTINCT surface AS title, lang_name AS language FROM g WHERE surface <> '' AND lang_name IS NOT NULL)
        SELECT title, language, title AS page, title AS shown FROM a SEMI JOIN h USING (title, language)
        UNION ALL SELECT a.title, a.language, v.dest, v.dest FROM a JOIN v USING (title) JOIN h ON h.title = v.dest AND h.language = a.language""",
    "glossary_concepts": f"""WITH {BUNDLED}, e AS (SELECT DISTINCT lang_name, label FROM l JOIN g USING (gloss_id) WHERE lang_name IS NOT NULL),
        o AS (SELECT 'Appendix:' || lang_name || ' glossary' AS page, replace(label, ' ', '_') AS anchor, label || ' (' || lang_name || ' glossary)' AS name, 'What ' || label || ' means.' AS description,
            CAST(row_number() OVER (PARTITION BY lang_name ORDER BY label) - 1 AS INTEGER) AS place, lang_name FROM e)
        SELECT page, anchor, name, description, place FROM o UNION ALL SELECT page, 'About', 'About (' || lang_name || ' glossary)', 'Words of grammar.', max(place) + 1 FROM o GROUP BY page, lang_name""",
    "match_tree": f"WITH {MATCHED} SELECT source_ord, CAST(sent_ord AS INTEGER) AS sent_ord, title, array_to_string(range(k, k + n), '|') AS covered FROM m",
    "glosses": f"""WITH RECURSIVE {REC}, e AS (SELECT source_ord, idx, dep, min(o) AS o FROM (SELECT source_ord, idx, unnest(depends_on) AS dep, unnest(range(0, len(depends_on))) AS o FROM g WHERE source_ord IS NOT NULL AND idx IS NOT NULL) WHERE dep <> idx GROUP BY ALL),
        w AS (SELECT source_ord, idx, [CAST(first_sentence AS BIGINT) * 100000 + idx] AS path FROM g WHERE production AND first_sentence IS NOT NULL
            UNION SELECT w.source_ord, e.dep, list_append(w.path, e.o) FROM w JOIN e ON e.source_ord = w.source_ord AND e.idx = w.idx),
        b AS (SELECT source_ord, idx, min(list_append(path, 2147483647)) AS post FROM w GROUP BY ALL)
        SELECT source_ord, idx, row_number() OVER (PARTITION BY source_ord ORDER BY post) AS ordinal FROM b""",
    "rule_match": f"WITH {BUNDLED} SELECT gloss_id, min(idx) OVER (PARTITION BY source_ord, bundle) AS rule FROM b",
    "rule_glosses": f"WITH {BUNDLED}, r AS (SELECT source_ord, bundle, list(idx ORDER BY idx) AS v FROM b GROUP BY ALL) SELECT source_ord, bundle, v[1] AS first_example, v[2] AS second_example FROM r WHERE len(v) >= 2",
    "sense_choice": f"WITH {SENSES} SELECT source_ord, surface, CASE WHEN len(v) % 2 = 0 THEN v[len(v)] ELSE array_to_string(v, '¦') END AS kept FROM q",
    "sense_first": f"WITH {SENSES} SELECT source_ord, surface, v[1] AS kept FROM q",
    "bench_score": f"""WITH {REC}, p AS (SELECT source_ord, surface, lower(string_agg(coalesce(definition, ''), chr(10) ORDER BY idx)) AS j, flatten(list(string_split(lower(entry), ' ')) FILTER (entry IS NOT NULL)) AS must,
            flatten(list(quoted) FILTER (quoted IS NOT NULL)) AS never, count(definition) AS n FROM g WHERE surface IS NOT NULL GROUP BY ALL)
        SELECT source_ord, surface, CASE WHEN n = 0 THEN 'absent' WHEN len(list_filter(must, lambda w: w <> '' AND contains(j, w))) > 0 AND len(list_filter(never, lambda w: w <> '' AND contains(j, lower(w)))) = 0 THEN 'pass' ELSE 'fail' END AS state FROM p""",
    "limit_glosses": f"""WITH {REC}, t AS (SELECT source_ord, surface, min(idx) AS term, count(DISTINCT coalesce(definition, chr(1))) AS n FROM g GROUP BY ALL)
        SELECT source_ord, surface, term FROM (SELECT *, sum(n) OVER (PARTITION BY source_ord ORDER BY term ROWS UNBOUNDED PRECEDING) - n AS before FROM t) WHERE before < 50""",
    "card_lines": f"""WITH {REC}, c AS (SELECT source_ord, idx, 'recognition' AS kind, CASE WHEN coalesce(len(list_filter(string_split(trim({LABEL}, '()'), ','), lambda p: lower(trim(p)) IN ({", ".join(f"'{w}'" for w in T.MARKED)}))) > 0, false)
            THEN surface || ' ' || {LABEL} ELSE surface END AS front, coalesce(definition, '') AS back FROM g
        UNION ALL SELECT source_ord, idx, 'production', replace(coalesce(definition, ''), surface, '{T.MASK}'), surface FROM g WHERE production)
        SELECT source_ord, idx, kind, concat_ws(' | ', kind, front, back) AS line FROM c""",
    "source_kinds": r"SELECT 'text' AS kind, count(*) AS n, CAST(sum(length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL",
}
