"""Pages, trees, walks, answers and readings on examples written by hand."""

import json

from pyspark.sql import functions as F

from lexiloom.functions import readings as R
from lexiloom.operators import answers as A
from lexiloom.operators import trees, walk
from lexiloom.operators import terms as M
from lexiloom.sinks import text as sinks
from lexiloom.sources import pages

PAGE = """
<h2 id="English">English</h2><h3 id="Noun">Noun</h3><ol><li>wrong language</li></ol>
<h2 id="Spanish">Spanish</h2><table class="wikitable es-see"><tr><td>For other words, see <a href="/wiki/Category:x">x</a><table><tr><td>see <a href="/wiki/mates#Spanish">mates</a></td></tr></table></td></tr></table>
<h3 id="Pronunciation">Pronunciation</h3><span class="IPA">/ˈmate/</span> <span class="IPA">*mati</span><source src="//upload.wikimedia.org/m.mp3"><source src="//upload.wikimedia.org/m.ogg">
<div class="mw-heading"><h3 id="Etymology_1">Etymology 1</h3></div><p> </p><p>From <a href="/wiki/des-#Spanish">des-</a> +&nbsp;<a href="/wiki/cargar#Spanish">cargar</a>, like <a href="/wiki/charge#French">charge</a>.</p>
<h4 id="Noun_2">Noun<span>[edit]</span></h4><p><span class="headword-line"><strong class="headword">mate</strong> m (plural mates)</span></p>
<ol><li><span class="defdate">[from 1715]</span> a drink; <a class="mw-selflink selflink">mate</a> <a class="mw-selflink-fragment" href="#English">mate</a>
<dl><dd><div class="h-usage-example"><i class="e-example">Toma mate.</i> <span class="e-translation">Drink it.</span></div></dd></dl></li>
<li>inflection of <span class="form-of-definition-link"><a href="/wiki/bichito_de_luz#Spanish">bichito de luz</a></span>:<ol><li><a href="/wiki/Appendix:Glossary#plural">plural</a></li><li>Lua error in Module:x</li></ol></li>
<li>Lua error at line 3</li></ol>
<h4 id="Anagrams">Anagrams</h4><ol><li>team</li></ol>
<h3 id="Etymology_2">Etymology 2</h3><h4 id="Verb">Verb</h4><ol class="references"><li>r</li></ol><ol><li>kill<style>p{}</style></li></ol>
<h4 id="Kanji">Kanji</h4><ol><li>shape</li></ol><h5 id="Readings">Readings</h5><ul><li>Go-on: けち (kechi) ← けち (keti)</li></ul>
"""


def test_a_page_by_hand(spark):
    raw = spark.createDataFrame([("mate", "Spanish", PAGE), ("mate", "Dutch", PAGE), ("none", "Spanish", None)], "title string, language string, html string")
    page = pages.structured_pages(raw).collect()
    assert len(page) == 1
    p = page[0]
    assert (p.see_target, p.ipa, p.audio_urls) == ("mates", ["/ˈmate/"], ["https://upload.wikimedia.org/m.ogg"])
    assert [e.part_of_speech for e in p.entries] == ["Noun", "Verb", "Kanji"]
    noun = p.entries[0]
    assert noun.headword == "m (plural mates)" and noun.etymons == ["des-", "cargar"] and noun.etymology.startswith("From des- + cargar")
    assert [s.definition for s in noun.senses] == ["a drink; mate mate", "inflection of bichito de luz: plural", "inflection of bichito de luz: Lua error in Module:x"]
    assert noun.senses[0].quoted == ["mate"] and [tuple(x) for x in noun.senses[0].examples] == [("Toma mate.", "Drink it.")]
    assert noun.senses[1].targets == ["bichito de luz"] and noun.senses[1].concepts == ["plural"] and p.n_errors == 1
    assert p.entries[1].etymology is None and p.entries[1].senses[0].definition == "kill" and p.entries[2].readings == ["Go-on: けち (kechi)"]
    rows = {r.definition: r for r in pages.senses_of(pages.structured_pages(raw)).collect()}
    assert rows["kill"].ipa == ["/ˈmate/"] and rows["kill"].is_word and not rows["shape"].is_word


def test_redirects_and_boxes(spark):
    noun = '<h2 id="X">X</h2><h3 id="Noun">Noun</h3><ol><li>{}</li></ol>'
    rows = [
        ("a", noun.format("own")), ("b", '<ul class="redirectText"><li><a href="/wiki/a#X">a</a></li></ul>'), ("big", "split"),
        ("big/languages M to Z", noun.format("tail")), ("c", '<h2 id="X">X</h2><table class="ja-see"><tr><td>【<a href="/wiki/a">a</a>】</td></tr></table>'),
    ]
    raw = spark.createDataFrame(rows, "title string, html string")
    wanted = spark.createDataFrame([(t, "X") for t in ("a", "b", "big", "c", "zzz")], "title string, language string")
    got = {r.title: (r.page, r.shown) for r in pages.resolved_pages(raw, wanted).collect()}
    assert got == {"a": ("a", "a"), "b": ("a", "a"), "big": ("big/languages M to Z", "big"), "c": ("a", "c")}


def test_glossaries(spark):
    html = (
        "<dl><dt><span class='template-anchor' id='acc' data-id='acc'></span><span class='template-anchor' id='accusative'></span>accusative case, acc.<div class='noprint'>box</div></dt><dd>a case</dd></dl>"
        "<ul><li><span class='template-anchor' id='ren&amp;#039;y'></span><b>Rendaku</b> – voicing<ul><li>x</li></ul></li></ul>"
        "<div class='mw-heading'><h2 id='Causative'>Causative</h2></div><p>Makes someone do it.</p><p>More.</p><h3 id='Empty'>Empty</h3><ul><li>none</li></ul>"
    )
    raw = spark.createDataFrame([("Appendix:Words", html)], "title string, html string")
    got = {r.anchor: (r.name, r.description) for r in pages.concept_rows(raw).collect()}
    assert got == {
        "acc": ("accusative case (Words)", "a case"), "accusative": ("accusative case (Words)", "a case"), "ren'y": ("Rendaku (Words)", "voicing"),
        "Causative": ("Causative (Words)", "Makes someone do it. More."),
    }


TOKENS = "source_ord long, sent_ord int, tok_id int, text string, lemma string, upos string, xpos string, feats string, head int, deprel string, mwt_id int, mwt_last boolean"


def sentence(*words, sent=0):
    return [(1, sent, i, t, le, u, "", f, h, d, None, None) for i, (t, le, u, f, h, d) in enumerate(words, 1)]


def test_give_up_and_separable_verbs(spark):
    rows = sentence(("He", "he", "PRON", "Case=Nom|Number=Sing", 2, "nsubj"), ("gave", "give", "VERB", "Tense=Past", 0, "root"), ("himself", "himself", "PRON", "", 2, "obj"), ("up", "up", "ADP", "", 2, "compound:prt"), ("Foo", "Foo", "X", "", 2, "obl"), ("Bar", "Bar", "X", "", 5, "flat"), ("12", "12", "NUM", "", 2, "obl"), (".", ".", "PUNCT", "", 2, "punct"))
    tokens = spark.createDataFrame(rows, TOKENS)
    titles = [("give up", 1, "give", 0, "root"), ("give up", 2, "up", 1, "compound:prt"), ("give", 1, "give", 0, "root"), ("up", 1, "up", 0, "root"), ("he", 1, "he", 0, "root"), ("12", 1, "12", 0, "root"), ("up up", 1, "up", 0, "root"), ("up up", 2, "up", 1, "x"), ("two roots", 1, "two", 0, "r"), ("two roots", 2, "roots", 0, "r")]
    patterns = trees.patterns(spark.createDataFrame(titles, "title string, tok_id int, text string, head int, deprel string"))
    assert {r.title for r in patterns.collect()} == {"give up", "give", "up", "he", "12", "up up"}
    found = trees.tree_matches(trees.labelled(tokens), patterns).cache()
    assert {(r.title, tuple(r.covered)) for r in found.collect()} == {("give up", (2, 4)), ("give", (2,)), ("up", (4,)), ("he", (1,)), ("12", (7,))}
    terms = trees.extracted_terms(tokens, found).orderBy("place").collect()
    assert [(r.surface, r.lemma, r.titles) for r in terms] == [("He", "he", ["he"]), ("gave up", "give up", ["give up"]), ("himself", "himself", []), ("Foo Bar", "Foo Bar", [])]
    assert terms[0].features == ["Case", "Number"]
    german = spark.createDataFrame(sentence(("sieht", "sehen", "VERB", "", 0, "root"), ("aus", "aus", "ADP", "", 1, "compound:prt")), TOKENS)
    joined = trees.patterns(spark.createDataFrame([("aussehen", 1, "aussehen", 0, "root")], "title string, tok_id int, text string, head int, deprel string"))
    assert [r.covered for r in trees.tree_matches(trees.labelled(german, "de"), joined).collect()] == [[1, 2]]


def test_branches_take_different_words(spark):
    nodes = [{"tok_id": 1, "text": "a", "head": 0, "deprel": "r"}, {"tok_id": 2, "text": "b", "head": 1, "deprel": "x"}, {"tok_id": 3, "text": "b", "head": 1, "deprel": "x"}]
    token = lambda i, t, h: {"tok_id": i, "head": h, "deprel": "x", "labels": [{"label": t, "extra": None}]}
    assert trees.covers(nodes, [token(1, "a", 0), token(2, "b", 1)], 1) is None
    assert trees.covers(nodes, [token(1, "a", 0), token(2, "b", 1), token(3, "c", 1), token(4, "b", 1)], 1) == {1, 2, 4}


def test_titles_of_one_to_nine_words(spark):
    words = "one two three four five six seven eight nine".split()
    texts = spark.createDataFrame([(1, " ".join(words) + "."), (2, "two two three. Nine!"), (3, None), (4, "")], "doc_id long, text string")
    titles = spark.createDataFrame([(" ".join(words[:n]),) for n in range(1, 10)] + [("Two-Three",), ("!?",), (None,)], "title string")
    found = M.matches(M.sentences(texts), titles).cache()
    assert {(r.doc_id, r["first"], r["last"], r.title) for r in found.collect()} == {(1, 0, n - 1, " ".join(words[:n])) for n in range(1, 10)} | {(1, 1, 2, "Two-Three"), (2, 1, 2, "Two-Three")}
    assert [(r.doc_id, r.title) for r in M.maximal(found).orderBy("doc_id").collect()] == [(1, " ".join(words)), (2, "Two-Three")]
    assert M.matches(M.sentences(texts), titles.where("false")).count() == 0


def test_walk_in_depth(spark):
    edges = {5: [3, 4], 4: [1, 3], 3: [2], 2: [4], 9: [5]}
    occurrences, order, seen = [9, 4, 7], [], set()

    def add(i, path):
        for d in edges.get(i, []):
            if d not in path and d not in seen:
                add(d, path | {d})
        if i not in seen:
            seen.add(i)
            order.append(i)

    acyclic = {k: [d for d in v if (k, d) != (2, 4)] for k, v in edges.items()}
    edges = acyclic
    for i in occurrences:
        add(i, {i})
    rows = [(1, i, d, k) for i, deps in acyclic.items() for k, d in enumerate(deps)]
    got = walk.walked(spark.createDataFrame([(1, k, i) for k, i in enumerate(occurrences)], "source_ord long, occ int, idx int"), spark.createDataFrame(rows, "source_ord long, idx int, dep int, dep_ord int"))
    assert [r.idx for r in got.orderBy("ordinal").collect()] == order


def test_context_against_a_loop(spark):
    texts = ["one two.", "three.", " ".join("w" * 25), "four five six.", "seven.", "eight nine ten."]
    got = {r.sent: (r.before, r.after) for r in walk.with_context(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, sent int, sentence string"), least=9).collect()}
    for at, text in enumerate(texts):
        words, before, after, back, ahead = len(text.split()), [], [], at - 1, at + 1
        while words < 9 and (back >= 0 or ahead < len(texts)):
            if back >= 0 and (len(before) <= len(after) or ahead >= len(texts)):
                before, words, back = [texts[back], *before], words + len(texts[back].split()), back - 1
            else:
                after, words, ahead = [*after, texts[ahead]], words + len(texts[ahead].split()), ahead + 1
        assert got[at] == (" ".join(before), " ".join(after))


def test_answers(spark):
    asked = spark.createDataFrame([("a", ["x", "y", "z"], "1"), ("b", ["x"], "2"), ("c", ["x", "y"], "3"), ("d", ["x", "y"], "4"), ("e", [], "5")], "surface string, senses array<string>, digest string")
    stored = spark.createDataFrame([("1", json.dumps({"senses": [3, 1, 9, 3]})), ("2", "{}"), ("3", "not json"), ("3", "not json")], "digest string, answer string")
    assert {r.surface: r.kept for r in A.chosen_senses(asked, stored).collect()} == {"a": ["x", "z"], "b": ["x"], "c": ["x", "y"], "d": ["x", "y"], "e": []}
    assert {r.surface: r.kept for r in A.chosen_senses(asked, stored, True).collect()} == {"a": ["x", "z"], "b": ["x"], "c": ["x"], "d": ["x"], "e": []}
    assert {r.digest for r in A.open_questions(asked.withColumn("question", F.lit("?")), stored).collect()} == {"4", "5"}
    forms = spark.createDataFrame([("es", ["p", "q"], "ir", "fui", "f1"), ("es", ["q", "p"], "ser", "era", "f2"), ("es", ["z"], "a", "b", "f3")], "lang string, bundle array<string>, base string, surface string, digest string")
    known = spark.createDataFrame([("es", ["p", "q"], "fui", 7)], "lang string, bundle array<string>, representative string, rule int")
    told = spark.createDataFrame([("f2", '{"regular": true}')], "digest string, answer string")
    assert {r.surface: (r.rule, r.asked) for r in A.rule_verdicts(forms, known, told).collect()} == {"fui": (7, False), "era": (7, True), "b": (None, None)}
    words = spark.createDataFrame([("teh", "1"), ("Bo", "2"), ("hotel", "3"), ("zz", "4"), ("Bo", "2")], "surface string, digest string")
    verdicts = [("1", {"kind": "misspelling", "correction": "the"}), ("2", {"kind": "name"}), ("3", {"kind": "foreign", "widely_known": True})]
    stored = spark.createDataFrame([(d, json.dumps(v)) for d, v in verdicts], "digest string, answer string")
    assert {r.surface: r.way for r in A.unknown_verdicts(words, stored).collect()} == {"teh": "gloss again", "Bo": "card", "hotel": "drop", "zz": "drop"}
    glosses = spark.createDataFrame([(1, "dog", ["a", "b"], "1"), (2, "cat", ["a"], "2")], "gloss_id long, definition string, renderings array<string>, digest string")
    stored = spark.createDataFrame([("1", json.dumps({"definition": "perro", "renderings": ["x"]})), ("2", json.dumps({"definition": "cat", "renderings": ["y"]}))], "digest string, answer string")
    assert {r.gloss_id: (r.definition, r.renderings, r.echoed) for r in A.translated(glosses, stored).collect()} == {1: ("perro", ["a", "b"], False), 2: ("cat", ["y"], True)}


def test_readings():
    assert R.contains_sound("çito", "çitoɾi", R.AT_START) and not R.contains_sound("çito", "çitoɾi", R.AT_END)
    assert R.contains_sound("ɾi", "çitoɾi", R.AT_END) and not R.contains_sound("bɯ̟", "bɯ̟̃ɰ̃", R.ANYWHERE)
    assert R.contains_sound("a", "a", R.WHOLE) and not R.contains_sound("a", "ab", R.WHOLE)


def test_readings_in_tables(spark):
    blocks = spark.createDataFrame([("分", 0, ["[bɯ]"]), ("分", 1, ["/bɯɴ/"])], "title string, entry_ord int, ipa array<string>")
    asked = spark.createDataFrame([(1, "分", ["[bɯɴˈseki]"], "start")], "ask_id int, title string, readings array<string>, place string")
    assert [tuple(r) for r in R.read_as(asked, blocks).collect()] == [(1, 1, "bɯɴ")]
    row = spark.createDataFrame([(["Go-on: ごく (goku, Jōyō)", "Kun: きわ (kiwa), きわめる (kiwameru)"], "• (kiwa)", ["ру́сский", "рус"], "русский", "ру́сский is рус", "deck/0001.mbz.zip")], "lines array<string>, head string, quoted array<string>, answer string, definition string, name string")
    out = row.select(R.as_used(F.col("lines"), F.col("head")).alias("used"), R.quotations("quoted", "answer").alias("q"), R.document_name(F.col("name"), F.lit(2)).alias("n"), R.utterances(F.array(F.lit("a"), F.lit(""), F.lit("b"))).alias("u")).first()
    assert out.used == ["Kun: きわ (kiwa)"] and out.q == ["ру́сский"] and out.n == "0001+2" and out.u == "a\nb"
    masked = row.select(R.masked_quotations(F.col("definition"), R.quotations("quoted", "answer")).alias("m")).first().m
    assert masked == "■ is рус"
    titles = spark.createDataFrame([("いいん",), ("かも",), ("そうだ",), ("word",)], "title string")
    spelt = spark.createDataFrame([("いいん", 0, "委員"), ("かも", 0, "鴨"), ("かも", 1, None), ("そうだ", 0, "操舵")], "title string, sense_ord int, spelling string")
    ends = spark.createDataFrame([("いいん", [3]), ("委員", [3]), ("操舵", [3]), ("そうだ", [2, 3])], "text string, read array<int>")
    assert {tuple(r) for r in R.rejected_kana(titles, spelt, ends).select("title", "spelling").collect()} == {("そうだ", "操舵")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a*b", "what", [("s_1", None)], [2]), (1, 2, "c", None, [], [])], "source_ord long, idx int, surface string, definition string, examples array<struct<sentence:string,rendering:string>>, depends_on array<int>")
    got = {r.idx: r.block for r in sinks.markdown(rows).collect()}
    assert got[1] == "## a\\*b\n\nwhat\n\n- s\\_1\n\nSee [c](#c)" and got[2].startswith("## c")
    line = spark.createDataFrame([(1, 300.0, 5, 1, None, None, 7, 0.35)], "file_id int, cutoff double, n_met long, n_untaught long, cards long, days double, furthest long, furthest_days double")
    assert sinks.timeline_csv(line).first().line == "00:05:00,5,1,,,7,0.4" or sinks.timeline_csv(line).first().line == "00:05:00,5,1,,,7,0.3"
    assert json.loads(sinks.json_rows(line, ["file_id"]).first().line)["cards"] is None
    sinks.write_lines(sinks.timeline_csv(line), str(tmp_path / "out"), ["file_id", "cutoff"], header=sinks.CSV_HEADER)
    assert spark.read.text(str(tmp_path / "out" / "header")).first().value == sinks.CSV_HEADER
