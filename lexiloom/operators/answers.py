"""Questions that a model may answer, and what is done with stored answers or without any.

Answers are a table: digest (of the question), answer (JSON). Whoever runs a model fills it from ``open_questions``; the
operators here only join it, and without an answer give the result that needs none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """The 32 hexadecimal digits that stand for a question."""
    return F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 32)


def listing(senses: Column) -> Column:
    """Senses as a numbered list, one a line."""
    return F.array_join(F.transform(senses, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def sense_question(word: Column, passage: Column, senses: Column) -> Column:
    """The text that asks which senses of a word its occurrence in a passage has."""
    return F.concat(F.lit("Which senses does "), word, F.lit(" have where it is marked?\n\n"), passage, F.lit("\n\n"), listing(senses))


def open_questions(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (digest, question) without an answer, each once."""
    return asked.select("digest", "question").where("digest is not null").dropDuplicates(["digest"]).join(answers.select("digest"), "digest", "left_anti")


def valid_choice(answer: Column, n: Column) -> Column:
    """The chosen places (from 1) of an answer {"senses": [...]}, those that the listing has, in its order, none twice."""
    chosen = F.from_json(answer, "senses array<int>")["senses"]
    return F.array_sort(F.array_distinct(F.filter(chosen, lambda i: i.isNotNull() & (i >= 1) & (i <= n))))


def chosen_senses(occurrences: DataFrame, answers: DataFrame, follow_up: bool = False) -> DataFrame:
    """``occurrences`` (senses: array of strings, digest) with kept: the senses that the stored answer chooses, in the order
    of the listing.

    One sense or none needs no answer. Without one all senses stay, or the first alone for a ``follow_up`` (a word that
    another's definition names); an answer that names no sense of the listing counts as none.
    """
    stored = answers.select("digest", "answer").dropDuplicates(["digest"])
    rows = occurrences.join(stored, "digest", "left").withColumn("_chosen", valid_choice(F.col("answer"), F.size("senses")))
    default = F.slice("senses", 1, 1) if follow_up else F.col("senses")
    kept = F.transform("_chosen", lambda i: F.get("senses", i - 1))
    return rows.withColumn("kept", F.when((F.size("senses") > 1) & (F.size("_chosen") > 0), kept).otherwise(default)).drop("answer", "_chosen")


def rule_question(label: Column, base: Column, surface: Column) -> Column:
    return F.concat(F.lit("Is "), surface, F.lit(" formed regularly as the "), label, F.lit(" of "), base, F.lit("?"))


def rule_verdicts(forms: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """Forms (lang, bundle, base, surface, digest) with the rule they follow: rule (null for none) and whether it is asked.

    Rules (lang, bundle, representative, rule) are looked up by equal bundles. A form that is a rule's representative
    follows it unasked; others follow the first rule that a stored answer {"regular": true} confirms; without an answer, none.
    """
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "\x01")
    known = rules.select("lang", key(F.col("bundle")).alias("_key"), "representative", "rule")
    rows = forms.withColumn("_key", key(F.col("bundle"))).join(known, ["lang", "_key"], "left")
    rows = rows.join(answers.select("digest", "answer").dropDuplicates(["digest"]), "digest", "left")
    own = F.col("surface") == F.col("representative")
    yes = F.coalesce(F.from_json("answer", "regular boolean")["regular"], F.lit(False))
    fits = F.when(own | yes, F.struct((~own).alias("asked"), F.col("rule").alias("rule")))
    return rows.groupBy("lang", "bundle", "base", "surface", "digest").agg(F.min(fits).alias("m")).select("lang", "bundle", "base", "surface", "digest", F.col("m.rule").alias("rule"), F.col("m.asked").alias("asked"))


def inventory(present: Column, every: Column) -> Column:
    """What a question says of the categories a form is marked for and those it isn't; nothing if either is empty."""
    absent = F.array_except(every, present)
    text = F.concat(F.lit("Marked: "), F.array_join(F.array_sort(present), ", "), F.lit(". Not marked: "), F.array_join(F.array_sort(absent), ", "), F.lit("."))
    return F.when((F.size(present) > 0) & (F.size(absent) > 0), text).otherwise(F.lit(""))


VERDICTS = ("misspelling", "native", "name", "foreign", "unknown")


def unknown_verdicts(words: DataFrame, answers: DataFrame, every: bool = False) -> DataFrame:
    """What becomes of words without an entry (surface, digest): surface, kind, correction, explanation, way.

    Answers say {"kind", "correction", "widely_known", "explanation"}. way: 'gloss again' for a misspelling with its
    correction, 'card' for native words, names and foreign words (without a production side), 'drop' for foreign words
    that are widely known unless ``every``, for others, and without an answer. Each surface once.
    """
    told = F.from_json("answer", "kind string, correction string, widely_known boolean, explanation string")
    rows = words.dropDuplicates(["surface"]).join(answers.select("digest", "answer").dropDuplicates(["digest"]), "digest", "left").withColumn("v", told)
    kind, correction = F.col("v.kind"), F.trim(F.coalesce("v.correction", F.lit("")))
    known_foreign = (kind == "foreign") & F.coalesce("v.widely_known", F.lit(False)) & F.lit(not every)
    way = F.when((kind == "misspelling") & (correction != "") & (correction != F.col("surface")), "gloss again").when(known_foreign, "drop").when(kind.isin("native", "name", "foreign"), "card").otherwise("drop")
    return rows.select("surface", F.when(kind.isin(*VERDICTS), kind).alias("kind"), F.when(correction != "", correction).alias("correction"), F.col("v.explanation").alias("explanation"), way.alias("way"))


def translated(glosses: DataFrame, answers: DataFrame) -> DataFrame:
    """Glosses (gloss_id, definition, renderings, digest) in another language where an answer has it.

    Answers say {"definition", "renderings"}. An empty part keeps the original; renderings of another number than asked are
    refused whole. echoed tells an answer that only repeats.
    """
    told = F.from_json("answer", "definition string, renderings array<string>")
    rows = glosses.join(answers.select("digest", "answer").dropDuplicates(["digest"]), "digest", "left").withColumn("v", told)
    said = F.trim(F.coalesce("v.definition", F.lit("")))
    aligned = F.size("v.renderings") == F.size("renderings")
    return rows.select(
        "gloss_id", F.when(said != "", said).otherwise(F.col("definition")).alias("definition"),
        F.when(aligned, F.transform("renderings", lambda r, i: F.when(F.trim(F.coalesce(F.get("v.renderings", i), F.lit(""))) != "", F.get("v.renderings", i)).otherwise(r))).otherwise(F.col("renderings")).alias("renderings"),
        F.coalesce((said != "") & (said == F.col("definition")), F.lit(False)).alias("echoed"),
    )
