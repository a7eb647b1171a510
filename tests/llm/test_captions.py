import numpy as np
import pytest

from lexiloom.llm import lookalike as L
from lexiloom.llm.clocks import isotonic
from lexiloom.llm.runs import runs
from lexiloom.llm.sentences import sentence_ends
from lexiloom.llm.turns import cast_of, pieces, turns

CUES = "cue_id long, file_id long, series string, cue_ord int, start_s double, end_s double, text string, loaded_at timestamp, span long, words string"
FILES = "file_id long, series string, title string, lang string, track string, dialect string, cue_id long, span int"
SPEAKERS = "speaker_id long, file_id long, full_name string, role_name string, lang string"


def cues(spark, *texts, file_id=1, first=1, repeat=True):
    """Cues of one file, two seconds each; the last one is delivered twice."""
    rows = [(first + i, file_id, None, i + 1, 2.0 * i, 2.0 * i + 1.5, t, None, 9, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:] * repeat, CUES)


def files(spark, lang, track, file_id=1):
    return spark.createDataFrame([(file_id, None, None, lang, track, "srt", 5, 5)], FILES)


def pairs(spark, *values, field="surface"):
    rows = spark.createDataFrame([(field, 1, i, v) for i, v in enumerate(values)], "field string, scope long, id long, value string")
    return {(r.id_a, r.id_b) for r in L.look_same_pairs(rows).collect()}


SAME = [("café", "café"), ("ｗｏｒｄ", "word"), ("ﬁn", "fin"), ("a b", "a b"), ("wo​rd", "word"), ("ѕеа", "sea"), ("дёнceфы", "дёнсефы"), ("⽕水", "火水"), ("ガメ", "ｶﾞﾒ"), ("火口ボ", "火ロボ"), ("へパト", "ヘパト"), ("δένoστ", "δένοστ"), ("Gӓrtner", "Gärtner"), ("о́с", "óc")]
OTHER = [("cafe", "café"), ("Word", "word"), ("m²", "m2"), ("①", "1"), ("a-b", "ab"), ("a...", "a…"), ("a  b", "a b"), ("е", "ё"), ("“a”", '"a"')]


@pytest.mark.parametrize("a, b", SAME)
def test_values_that_look_the_same(spark, a, b):
    assert pairs(spark, a, b, a) == {(0, 1), (1, 2)}


def test_values_that_do_not(spark):
    for a, b in OTHER:
        assert pairs(spark, a, b) == set()


def test_forms_of_long_null_and_blank_values(spark):
    long = "ｗord " * 40_000
    assert pairs(spark, long, "word " * 40_000, None) == {(0, 1)}
    glosses = spark.createDataFrame([(1, 1, "a", None, "z"), (1, 1, "a", None, "z"), (2, 1, "а", " ", "z")], "gloss_id long, source_ord long, surface string, lemma string, value string")
    rows = L.values(glosses, cues(spark, None, "", "x"))
    assert rows.where("field = 'lemma'").count() == 0
    assert {(r.id_a, r.id_b) for r in L.look_same_pairs(rows).collect()} == {(1, 2)}
    assert {r.form for r in L.consistent_values(rows).where("field = 'surface'").collect()} == {"a"}
    assert L.look_same_pairs(rows.where("false")).count() == 0


def test_python_twin(spark):
    assert L.settled("ｗﬁ​ é") == "wfi é" and L.capitals("straße Ѕ") == "STRAßE S"


def found_runs(spark, *texts, track="auto"):
    got = runs(cues(spark, *texts), files(spark, "en", track)).collect()
    return sorted((r.first_cue_id, r.last_cue_id, r.n_cues) for r in got)


def test_runs(spark):
    assert found_runs(spark, "Why not?", "<i>why</i>  NOT", "{\\an8}- Why not...", "other", "[Music]", "[music]", None, " ", "[music]") == [(1, 3, 3), (5, 9, 3)]
    assert found_runs(spark, "the carpenter sold", "the carpentr sold", "the carppenter sold", "the carpenter solt") == [(1, 3, 3)]
    assert found_runs(spark, "Step 11 of 40", "Step 12 of 40", "the old ferry", "the old ferry man", "a step", "step") == []
    assert found_runs(spark, "a", "a", track="talk") == []
    assert runs(cues(spark, "x").where("false"), files(spark, "en", "sub")).count() == 0


def test_runs_of_any_length_and_ties(spark):
    assert found_runs(spark, *["line"] * 101, "end") == [(1, 101, 101)]
    tied = spark.createDataFrame([(i, 1, None, 9 - i, 5.0, None, t, None, 1, "") for i, t in ((1, "b"), (2, "a"), (3, "a"))], CUES)
    assert [(r.first_cue_id, r.last_cue_id) for r in runs(tied, files(spark, "en", "sub")).collect()] == [(3, 2)]


CAST = [(1, 1, "Selel Hestnov", "Host", "x"), (2, 1, "Vosan Zandoty", None, "x"), (3, 2, None, None, "x")]


def test_turns(spark):
    texts = [
        "before any label.", ">> SELEL: Good, um, morning.", "more words.", "[laughs]", "Vosan: Erm...", "still his?", "HESTNOV, SELEL : Note: yes. - Zandoty: no.",
        "[Selel] back (00:10) again", "00:01:02 - Vsoan: ♪♪ So.", "Vosan, thanks. Host: right.", "VZ: (sighs)", "S. Hestnov: — on.", "At 10:30: we go.",
    ]
    got = turns(cues(spark, *texts), files(spark, "en", "talk"), spark.createDataFrame(CAST, SPEAKERS)).orderBy("turn").collect()
    assert [(r.speaker_id, r.first_cue_id, r.last_cue_id) for r in got] == [(1, 2, 3), (2, 6, 6), (1, 7, 7), (2, 7, 7), (1, 8, 8), (2, 9, 10), (1, 10, 13)]
    assert got[0].words == "Good morning. more words." and got[-1].words == "right. on. At 10:30: we go."
    assert turns(cues(spark, "a").where("false"), files(spark, "en", "talk"), spark.createDataFrame(CAST, SPEAKERS)).count() == 0


def test_turns_across_spans(spark):
    rows = [(i, 1, None, i, 700.0 * i, None, t, None, 0, "") for i, t in enumerate(["Selel: a.", "b.", "Vosan: (sighs)", "c.", "Selel: [laughs]", "Vosan: d."])]
    got = turns(spark.createDataFrame(rows, CUES), files(spark, None, "talk"), spark.createDataFrame(CAST, SPEAKERS)).orderBy("turn").collect()
    assert [(r.speaker_id, r.first_cue_id, r.last_cue_id) for r in got] == [(1, 0, 1), (2, 3, 5)]


def test_labels_and_times():
    cast = cast_of("1\tSelel Hestnov\tHost\n2\tVosan Zandoty\t")
    assert list(pieces("the clock says 10:30, so Selel: x", cast, "en")) == [(None, "the clock says 10:30, so Selel: x")]
    assert list(pieces("Selel (off screen): at 6 p.m.", cast, "en")) == [(1, "at 6 p.m.")]
    assert list(isotonic(np.array([1.0, 3.0, 2.0, 4.0]))) == [1.0, 2.5, 2.5, 4.0]


def ends(spark, lang, *texts):
    found = sentence_ends(cues(spark, *texts, repeat=False), files(spark, lang, "sub")).collect()
    return sorted((r.cue_id, r.end_char) for r in found)


def test_plain_ends_and_stored_places(spark):
    assert ends(spark, "en", "One. Two", "goes on! “Wait here!” said", "he. - Yes. - No", "{\\an8}Thr​ee? tail ") == [(1, 4), (2, 8), (3, 3), (3, 10), (4, 13), (4, 18)]
    assert ends(spark, "de", "Er rief: „Es ist", "offen!“ Der Lehrling kam (welch ein Glück!) heim…", "…und ging!", "Also… mein Nachbar") == [(2, 7), (3, 10), (4, 18)]
    assert ends(spark, "el", "Τι; Ναι! «Στάσου!» είπε ο φίλος.") == [(1, 3), (1, 8), (1, 32)]


def test_unspaced_scripts(spark):
    assert ends(spark, "ja", "「待て！」と言いました。Ｄｒ．ベルコは", "来ました。") == [(1, 12), (2, 5)]
    assert ends(spark, "zh", "学徒喊道：“门开着！”我的邻居说话", "你好 再见") == [(1, 11), (1, 17), (2, 2), (2, 5)]


def test_learnt_abbreviations(spark):
    people = ["Belkor", "Tamsin", "Orvin", "Sarrow"]
    texts = []
    for i in range(60):
        texts += [f"The baker met Dr. {people[i % 4]} at noon today!", f"Dr. {people[i % 4]} sold salt, rope, etc.", "The miller waited near the canal."]
    got = ends(spark, "en", *texts)
    assert got == sorted((i + 1, len(t)) for i, t in enumerate(texts))


def test_no_sentences(spark):
    assert ends(spark, "en", None, " ") == []
