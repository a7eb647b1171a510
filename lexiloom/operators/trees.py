"""Parsed tokens: labels, dependency patterns of titles, and the terms they cover.

Any parser may fill the table of tokens: source_ord, sent_ord, tok_id (1-based in its sentence), text, lemma, upos, xpos,
feats, head (a tok_id, 0 for a root), deprel, start, end (places in the sentence).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import is_number, respellings

# How a verb's particle hangs off it, languages that write both as one word, tags of what belongs to the
# word before or after it, and languages that write words without spaces.
PARTICLE = "compound:prt"
JOINED_PARTICLES = ("af", "de", "hu", "nl")
SUFFIX_TAG, PREFIX_TAG = "接尾辞", "接頭辞"
UNSPACED_LANGS = ("ja", "zh", "th", "lo", "km")
SENTENCE = ["source_ord", "sent_ord"]


def plain_tokens(sentences: DataFrame, key: str, text: str = "sentence") -> DataFrame:
    """The default parse of sentences (key, sent, text): words and marks in a chain, each hanging off the one before."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"), F.lit(0))
    rows = sentences.select(F.col(key).alias("source_ord"), F.col("sent").alias("sent_ord"), F.posexplode(found).alias("at", "text"))
    mark = F.col("text").rlike(r"^[^\p{L}\p{M}\p{N}_]")
    return rows.select(
        *SENTENCE, (F.col("at") + 1).alias("tok_id"), "text", F.lower("text").alias("lemma"), F.when(mark, "PUNCT").otherwise("X").alias("upos"), F.lit("").alias("xpos"),
        F.lit("").alias("feats"), F.col("at").alias("head"), F.lit("next").alias("deprel"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
    )


def positional(tokens: DataFrame) -> DataFrame:
    """``tokens`` with positional: whether a word's capital may be its place's, as the first of a sentence or of a line in
    it, marks passed over. Lines are told by ``line``, a token's line in its sentence, where the table has it."""
    line = "line" if "line" in tokens.columns else None
    segment = Window.partitionBy(*SENTENCE, *([line] if line else [])).orderBy("tok_id").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("positional", ~F.coalesce(F.max(F.col("upos") != "PUNCT").over(segment), F.lit(False)))


def labelled(tokens: DataFrame, lang: str = "") -> DataFrame:
    """``tokens`` with labels: array of (label, extra): what a title may call the token, and the particle that a joined
    spelling takes along (null for others)."""
    rows = positional(tokens)
    lemma = F.coalesce("lemma", "text")
    base = F.array("text", lemma)
    base = F.when(F.col("positional"), F.concat(base, F.transform(base, lambda x: F.lower(x)))).otherwise(base)
    if lang == "ru":
        base = F.concat(base, F.flatten(F.transform(base, respellings)))
    none = F.lit(None).cast("int")
    own = F.transform(F.array_distinct(base), lambda x: F.struct(x.alias("label"), none.alias("extra")))
    if lang not in JOINED_PARTICLES:
        return rows.withColumn("labels", own)
    parts = tokens.where(F.col("deprel") == PARTICLE).select(*SENTENCE, F.col("head").alias("tok_id"), F.struct(F.col("tok_id").alias("id"), lemma.alias("particle")).alias("p"))
    parts = parts.groupBy(*SENTENCE, "tok_id").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    rows = rows.join(parts, [*SENTENCE, "tok_id"], "left")
    joined = F.flatten(F.transform("parts", lambda p: F.transform(F.array(lemma, F.col("text")), lambda stem: F.struct(F.lower(F.concat(p["particle"], stem)).alias("label"), p["id"].cast("int").alias("extra")))))
    return rows.withColumn("labels", F.concat(own, F.coalesce(F.array_distinct(joined), F.array().cast("array<struct<label:string,extra:int>>")))).drop("parts")


def patterns(title_tokens: DataFrame) -> DataFrame:
    """Patterns of parsed titles (title, tok_id, text, head, deprel): title, root (its root's spelling), n, nodes (array of
    tok_id, text, head, deprel, by place). A title that isn't one tree is left out; titles are spelt as they are."""
    rows = title_tokens.withColumn("head", F.coalesce("head", F.lit(0)))
    node = F.struct(F.col("tok_id").cast("int").alias("tok_id"), "text", F.col("head").cast("int").alias("head"), "deprel")
    whole = rows.groupBy("title").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.count(F.lit(1)).cast("int").alias("n"))
    ids = F.transform("nodes", lambda x: x["tok_id"])
    roots = F.filter("nodes", lambda x: ~F.array_contains(ids, x["head"]))
    return whole.withColumn("roots", roots).where("size(roots) = 1").select("title", F.element_at("roots", 1)["text"].alias("root"), "n", "nodes")


def first_fit(options: list[list[tuple[int, frozenset[int]]]]) -> frozenset[int] | None:
    """What the first choice covers that gives each place one of its options, none twice; places in order, options too."""
    for choice in product(*options):
        if len({child for child, _ in choice}) == len(choice):
            return frozenset().union(*[covered for _, covered in choice])
    return None


def covers(nodes: list[dict[str, Any]], sentence: list[dict[str, Any]], at: int) -> frozenset[int] | None:
    """The tokens that a pattern covers with its root at token ``at``, or None if it doesn't fit there.

    Each node of the pattern has a token that bears its spelling as a label, and each of its edges one of the same kind
    below that token, no two the same; further words may hang there. A label that joins a particle covers it too.
    """
    tokens = {t["tok_id"]: t for t in sentence}
    below: dict[int, list[int]] = {}
    for t in sentence:
        below.setdefault(t["head"], []).append(t["tok_id"])
    ids = {n["tok_id"] for n in nodes}
    parts: dict[int, list[dict[str, Any]]] = {}
    for n in nodes:
        parts.setdefault(n["head"] if n["head"] in ids else 0, []).append(n)

    @cache
    def fit(node: int, token: int) -> frozenset[int] | None:
        spelling = next(n["text"] for n in nodes if n["tok_id"] == node)
        hits = [x["extra"] for x in tokens[token]["labels"] if x["label"] == spelling]
        if not hits:
            return None
        own = frozenset([token, *(x for x in hits if x is not None)])
        options = []
        for part in parts.get(node, []):
            found = [(t, c) for t in below.get(token, []) if tokens[t]["deprel"] == part["deprel"] and (c := fit(part["tok_id"], t)) is not None]
            if not found:
                return None
            options.append(found)
        rest = first_fit(options)
        return None if rest is None else own | rest

    return fit(parts[0][0]["tok_id"], at)


def tree_matches(tokens: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles whose pattern is a subtree of a sentence: source_ord, sent_ord, title, covered (sorted tok_ids).

    ``tokens`` have labels (see ``labelled``), ``titles`` patterns. Candidates come from an equi-join of labels with the
    spellings of patterns' roots; a title of one word is a match by then. Sentences travel to the candidates of larger
    patterns only, and each is fitted by itself.
    """
    heads = tokens.select(*SENTENCE, "tok_id", F.explode("labels").alias("x")).select(*SENTENCE, "tok_id", F.col("x.label").alias("root"), "x.extra")
    met = heads.join(titles, "root")
    covered = F.array_sort(F.array_compact(F.array(F.col("tok_id").cast("int"), F.col("extra"))))
    single = met.where("n = 1").select(*SENTENCE, "title", covered.alias("covered"))
    some = met.where("n > 1").select(*SENTENCE, "tok_id", "title", "nodes").dropDuplicates([*SENTENCE, "tok_id", "title"])
    token = F.struct(F.col("tok_id").cast("int").alias("tok_id"), F.col("head").cast("int").alias("head"), "deprel", "labels")
    whole = tokens.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    rows = some.join(whole, SENTENCE)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, (at, nodes, sentence) in enumerate(zip(batch["tok_id"].to_pylist(), batch["nodes"].to_pylist(), batch["tokens"].to_pylist(), strict=True)):
                hit = covers(nodes, sentence, at)
                if hit is not None:
                    keep.append(i)
                    found.append(sorted(hit))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept["source_ord"], kept["sent_ord"], kept["title"], pa.array(found, pa.list_(pa.int32()))], names=[*SENTENCE, "title", "covered"])

    schema = f"source_ord {kinds['source_ord']}, sent_ord {kinds['sent_ord']}, title string, covered array<int>"
    return single.unionByName(rows.mapInArrow(run, schema)).distinct()


def extracted_terms(tokens: DataFrame, found: DataFrame, lang: str = "") -> DataFrame:
    """The terms of sentences: source_ord, sent_ord, place, covered, titles, surface, lemma, features.

    Matches of one set of tokens are one term. Sets of marks or of numbers only are no terms, nor is one that lies in a
    larger match, whichever that is. Tokens that no match covers, marks and numbers left out, are terms without a title,
    neighbours together. In unspaced scripts a phrase has to stand together and at the edges of words. Terms come in order
    of their first token, and each surface once.
    """
    if lang in UNSPACED_LANGS:
        edge = tokens.select(*SENTENCE, F.col("tok_id").alias("edge"), "xpos")
        together = found.where((F.array_max("covered") - F.array_min("covered") + 1) == F.size("covered"))
        left = together.join(edge.withColumnRenamed("edge", "a").withColumnRenamed("xpos", "xa"), [F.array_min("covered") == F.col("a"), *[together[c] == edge[c] for c in SENTENCE]]).select(together["*"], "xa")
        right = left.join(edge, [F.array_max("covered") == F.col("edge"), *[left[c] == edge[c] for c in SENTENCE]]).select(left["*"], "xpos")
        whole = right.where((F.size("covered") == 1) | (~F.coalesce(F.startswith("xa", F.lit(SUFFIX_TAG)), F.lit(False)) & ~F.coalesce(F.startswith("xpos", F.lit(PREFIX_TAG)), F.lit(False))))
        found = whole.select(*SENTENCE, "title", "covered")
    token = F.struct(F.col("tok_id").cast("int").alias("id"), "text", F.coalesce("lemma", "text").alias("lemma"), "upos", "feats")
    sentences = tokens.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    sets = found.groupBy(*SENTENCE, "covered").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    sets = sets.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(F.struct("covered", "titles"))).alias("sets"))
    rows = sentences.join(sets, SENTENCE, "left").withColumn("sets", F.coalesce("sets", F.array().cast("array<struct<covered:array<int>,titles:array<string>>>")))
    ids = lambda p: F.transform(F.filter("tokens", p), lambda t: t["id"])
    rows = rows.withColumns({"marks": ids(lambda t: F.coalesce(t["upos"] == "PUNCT", F.lit(False))), "numbers": ids(lambda t: is_number(t["text"]))})
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    kept = F.filter("sets", lambda s: ~within(s["covered"], F.col("marks")) & ~within(s["covered"], F.col("numbers")) & ~F.exists(
        "sets", lambda o: within(s["covered"], o["covered"]) & (F.size(s["covered"]) < F.size(o["covered"]))))
    everywhere = F.array_distinct(F.flatten(F.transform("sets", lambda s: s["covered"])))
    bare = F.array_except(ids(lambda t: F.lit(True)), F.concat(everywhere, F.col("marks"), F.col("numbers")))
    rows = rows.withColumns({"kept": kept, "bare": F.array_sort(bare)})
    runs = F.transform(F.filter("bare", lambda i: ~F.array_contains("bare", i - 1)), lambda i: F.filter(
        "bare", lambda j: (j >= i) & F.forall(F.sequence(i, F.greatest(i, j)), lambda k: F.array_contains("bare", k))))
    runs = F.transform(runs, lambda r: F.struct(r.alias("covered"), F.array().cast("array<string>").alias("titles")))
    rows = rows.select(*SENTENCE, "tokens", F.posexplode(F.concat("kept", runs)).alias("found", "t"))
    mine = F.filter("tokens", lambda t: F.array_contains("t.covered", t["id"]))
    space = "" if lang in UNSPACED_LANGS else " "
    texts, lemmas = F.transform(mine, lambda t: t["text"]), F.transform(mine, lambda t: t["lemma"])
    lemma = F.array_join(lemmas, space) if space else F.concat(F.array_join(F.slice(texts, F.lit(1), F.size(texts) - 1), ""), F.element_at(lemmas, -1))
    pairs = F.flatten(F.transform(mine, lambda t: F.split(F.coalesce(t["feats"], F.lit("")), r"\|")))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p.rlike("^[^=]+=.+")), lambda p: F.substring_index(p, "=", 1))))
    terms = rows.select(*SENTENCE, "found", F.array_min("t.covered").alias("first"), F.col("t.covered").alias("covered"), F.col("t.titles").alias("titles"), F.array_join(texts, space).alias("surface"), lemma.alias("lemma"), names.alias("features"))
    again = Window.partitionBy(*SENTENCE, "surface").orderBy("first", "found")
    once = terms.withColumn("nth", F.row_number().over(again)).where("nth = 1")
    place = F.row_number().over(Window.partitionBy(*SENTENCE).orderBy("first", "found"))
    return once.withColumn("place", place).drop("nth", "first", "found")


def bound_titles(tokens: DataFrame, titles: DataFrame, joiner: str) -> DataFrame:
    """Titles of bound morphemes, spelt with ``joiner``, of words that a multiword token splits off but for its last one
    (mwt_id, mwt_last): source_ord, sent_ord, tok_id, title."""
    parts = tokens.where("mwt_id is not null and not mwt_last").select(*SENTENCE, "tok_id", F.concat("text", F.lit(joiner)).alias("title"))
    return parts.join(titles.select("title").distinct(), "title", "left_semi").select(*SENTENCE, "tok_id", "title")
