import hashlib

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.script import script_of


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("word, expected", [("11", True), ("1758", True), ("17,5", True), ("-3.6", True), ("1 000", True), ("dos", False), ("COVID-19", False), ("x86", False), ("nan", False), ("inf", False), ("5d", False), ("1,000,000", False), ("", False)])
def test_numbers(spark, word, expected):
    assert one(spark, T.is_number(F.col("w")), w=word) is expected


def test_respellings(spark):
    assert one(spark, T.respellings(F.col("w")), w="дом") == []
    assert one(spark, T.respellings(F.col("w")), w="лес") == ["лёс"]
    assert one(spark, T.respellings(F.col("w")), w="мебель") == ["мёбель", "мебёль", "мёбёль"]
    assert one(spark, T.respellings(F.col("w")), w="ееееe") and len(one(spark, T.respellings(F.col("w")), w="ееее")) == 15
    assert one(spark, T.respellings(F.col("w")), w="еееее") == []


def test_masks(spark):
    assert one(spark, T.masked_anywhere(F.col("d"), F.col("t")), d="short for 金玉 (kintama)", t="玉") == "short for 金■ (kintama)"
    assert one(spark, T.masked_words(F.col("d"), F.col("t")), d="in, into; in", t="in") == "■, into; ■"
    assert one(spark, T.masked_words(F.col("d"), F.col("t")), d="a.b a-b", t="a.b") == "■ a-b"
    assert one(spark, T.masked_pieces(F.col("d"), F.col("t")), d="◌ָ and ָ", t="◌ָ") == "■ and ■"


def test_labels_and_targets(spark):
    assert one(spark, T.fronted(F.col("s"), F.col("d")), s="мрак", d="(poetic) gloom") == "мрак (poetic)"
    assert one(spark, T.fronted(F.col("s"), F.col("d")), s="мрак", d="(anatomy) gloom") == "мрак"
    assert one(spark, T.label_of(F.col("p"), F.col("b")), p="first/third-person singular preterite indicative of conocer", b="conocer") == "first/third-person singular preterite indicative"
    assert one(spark, T.targets(F.col("d"), F.col("o")), d="plural of casa; form of casa", o="x") == ["casa"]
    assert one(spark, T.targets(F.col("d"), F.col("o")), d="a kind of bird", o="x") == []
    assert one(spark, T.targets(F.col("d"), F.col("o")), d=None, o="x") is None


def test_small_functions(spark):
    assert one(spark, T.listed(F.col("a")), a=["a", "b", "c"]) == "a, b and c"
    assert one(spark, T.listed(F.col("a")), a=["a"]) == "a" and one(spark, T.listed(F.col("a")), a=[]) == ""
    assert one(spark, T.tidy(F.col("w")), w=" :a   b;, ") == "a b"
    assert one(spark, T.gloss_key(F.col("a"), F.col("b")), a="x", b="y") == hashlib.sha256(b"x\ny").hexdigest()[:16]
    assert one(spark, T.hiragana(F.col("w")), w="カタガナ") == "かたがな"
    assert one(spark, T.slug(F.col("w")), w="Été: a_b — 1") == "été-a_b--1"
    assert one(spark, T.concept_reference(F.col("w")), w="/wiki/Appendix:Swahili_noun_classes#M-wa_class") == "Appendix:Swahili noun classes#M-wa_class"
    assert one(spark, T.concept_reference(F.col("w")), w="/wiki/Appendix:Cyrillic_script") is None
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(2).alias("e")), F.struct(F.lit(2).alias("s"), F.lit(4).alias("e")))
    assert one(spark, T.bracketed(F.col("w"), spans), w="出てくる") == "⟨出てくる⟩"
    assert one(spark, T.bracketed(F.col("w"), spans), w="abc") == "abc"
    assert (script_of("ａ"), script_of("ー"), script_of("1"), script_of("水")) == ("LATIN", "KATAKANA", "", "CJK")
