"""That the named methods make the rows: taken out, rows that count change."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import clocks, lookalike, mixing, packing, truncation
from lexiloom.llm.turns import cast_of, pieces, turns

DOCUMENTS = "doc_id long, text string, lang string, source string, series string"
WORDS = "the baker sold a lamp near canal at dusk behind mill with care under stairs until noon across pond".split()


def line(rng):
    return " ".join(rng.choices(WORDS, k=rng.randint(5, 12)))


def test_limits_decide_where_no_stops_are_written(spark):
    # Lines of two or three words, of which each may end one: only the limit tells that a line of one word was cut.
    rng, rows, cut = random.Random(3), [], set()
    for i in range(600):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(2, 3))) for _ in range(rng.randint(4, 24))]
        text = "\n".join(lines)
        if i % 2 and len(text) > 150:
            text = text[:150]
            text = text[: max(text.rfind(" "), text.rfind("\n"))]
            if " " not in text.split("\n")[-1]:
                cut.add(i)
        rows.append((i, text, "en", ("whole", "short")[i % 2], None))
    features = truncation.features(spark.createDataFrame(rows, DOCUMENTS)).cache()
    limits = truncation.limits_of(features.where("kind = 'text'"))
    assert {r.source for r in limits.collect()} == {"short"}
    found = lambda lim: {r.doc_id for r in truncation.judged(features, lim).where("cut").collect()}
    with_limits, without = found(limits) & cut, found(limits.where("false")) & cut
    assert len(with_limits) >= 0.9 * len(cut) and len(without) < 0.5 * len(cut), (len(cut), len(with_limits), len(without))


def test_every_planted_limit_is_found(spark):
    rng, rows = random.Random(5), []
    encoded = {"a": lambda t: t, "b": lambda t: t.encode(), "c": lambda t: t.replace("&", "&amp;").replace('"', "&quot;")}
    for i in range(900):
        source = "abc"[i % 3]
        text = " ".join(rng.choices(["лампа", "lamp", '"a" & "b"', "канал", "pond"], k=rng.randint(10, 90)))
        limit = 300 if source != "a" or i % 2 else 120
        if source == "b":
            text = text.encode()[:limit].decode(errors="ignore")
        elif source == "c":
            while len(encoded["c"](text)) > limit:
                text = text[:-1]
        elif i % 2 == 0 or len(text) > 300:
            text = text[:limit]
        rows.append((i, text, "ru", source, None))
    got = {(r.source, r.encoding, r.length) for r in truncation.hidden_limits(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert {("a", "characters", 120), ("a", "characters", 300), ("b", "utf-8 bytes", 300), ("c", "characters, entities", 300)} <= got
    assert len(got) <= 6


def test_short_fragments_of_lines_are_cut(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(line(rng) for _ in range(6)), "en", "s", None) for i in range(200)]
    rows += [(900, rows[0][1] + "\nthe baker sold a lamp near the ca", "en", "s", None), (901, rows[1][1] + "\nthe baker s", "en", "s", None)]
    got = {r.doc_id for r in truncation.cut_documents(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert {900, 901} <= got


def mixed(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randint(5, 60)), rng.choices(["en", "de", None], (8, 2, 1))[0], rng.choice("aaaaaabbc"), rng.choices("xyz", (6, 3, 1))[0]) for i in range(1500)]
    weights = spark.createDataFrame([("a", 0.4, 2), ("b", 0.4, 3), ("c", 0.2, 6)], "source string, target_share double, max_repeats int")
    return spark.createDataFrame(rows, DOCUMENTS), weights


def test_raking_meets_three_marginals_that_scaling_misses(spark):
    documents, weights = mixed(spark)
    raked = {(r.axis, r.category): (r.target, r.actual) for r in mixing.marginals(documents, weights).collect()}
    scaled = {(r.axis, r.category): r.actual for r in mixing.marginals(documents, weights, scaling_only=True).collect()}
    for axis, near in (("source", 0.005), ("lang", 0.01), ("topic", 0.03)):
        off = max(abs(t - a) for (x, _), (t, a) in raked.items() if x == axis)
        assert off < near, (axis, off)
    assert max(abs(raked[k][0] - scaled[k]) for k in raked if k[0] == "lang") > 0.05
    assert max(abs(raked[k][0] - scaled[k]) for k in raked if k[0] == "topic") > 0.05


def test_cells_are_raked_alike_in_memory_and_as_a_table(spark):
    rows = [("a", "x", "1", 4.0, 3.0), ("a", "y", "1", 2.0, 3.0), ("b", "x", "2", 3.0, 2.0), ("b", "", "1", 1.0, 0.1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, mass double, most double")
    wanted = [{"a": 0.5, "b": 0.5}, {"x": 0.6, "y": 0.3, "": 0.1}, {"1": 0.7, "2": 0.3}]
    targets = [spark.createDataFrame(list(w.items()), f"{axis} string, target double") for axis, w in zip(mixing.AXES, wanted, strict=True)]
    many = {(r.source, r.lang, r.topic): r.share for r in mixing.rake_table(cells, targets, rounds=2).collect()}
    kinds = [sorted(w) for w in wanted]
    axes = [np.array([kinds[k].index(r[k]) for r in rows]) for k in range(3)]
    few = mixing.rake(np.array([r[3] for r in rows]), axes, [np.array([w[x] for x in k]) for w, k in zip(wanted, kinds, strict=True)], np.array([r[4] for r in rows]), rounds=2)
    assert all(abs(many[r[:3]] - x) < 1e-9 for r, x in zip(rows, few.tolist(), strict=True))


def test_bounded_raking():
    mass, axes = np.array([1.0, 9.0, 5.0, 5.0]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    share = mixing.rake(mass, axes, [np.array([0.5, 0.5]), np.array([0.5, 0.5])], np.array([0.2, 1, 1, 1]))
    assert np.allclose([share[0] + share[1], share[0] + share[2]], [0.5, 0.5], atol=1e-4) and share[0] <= 0.2 + 1e-9


TIMES = "file_id long, cue_id long, cue_ord int, start_ms long, end_ms long"


@pytest.mark.parametrize("block", [16, 4096])
def test_regression_in_parts_equals_the_whole(spark, monkeypatch, block):
    monkeypatch.setattr(clocks, "BLOCK", block)
    rng = random.Random(block)
    rows = [(f, 1000 * f + i, i, 1000 * i + rng.randint(-2500, 2500), None) for f in (1, 2) for i in range(200)]
    got = {r.cue_id: r.from_ms for r in clocks.repaired_clocks(spark.createDataFrame(rows, TIMES), reset_ms=10**6).collect()}
    for f in (1, 2):
        fit = np.rint(clocks.isotonic(np.array([r[3] for r in rows if r[0] == f], float)))
        assert [got[1000 * f + i] for i in range(200)] == fit.tolist()


def test_planted_resets_and_jitter(spark):
    rng, rows, truth = random.Random(2), [], {}
    for i in range(300):
        true = 4000 * (i % 100)  # the clock starts anew at each hundredth cue
        truth[i] = (i // 100, true)
        rows.append((1, i, i, true + rng.choice([0, 0, 0, 300, -300]), true + rng.choice([3000, -50, 90_000])))
    got = {r.cue_id: (r.segment, r.from_ms, r.to_ms) for r in clocks.repaired_clocks(spark.createDataFrame(rows, TIMES)).collect()}
    assert all(got[i][0] == truth[i][0] and abs(got[i][1] - truth[i][1]) <= 300 and got[i][2] >= got[i][1] for i in truth)
    ordered = [got[i][1] for i in range(100)]
    assert ordered == sorted(ordered)


CUES = "cue_id long, file_id long, series string, cue_ord int, start_s double, end_s double, text string, loaded_at timestamp"


def test_turns_over_a_clock_that_was_reset(spark):
    texts = ["Selel: a.", "b.", "Vosan: c.", "d.", "Selel: e.", "f."]
    starts = [0.0, 5.0, 10.0, 0.5, 5.5, 5.1]  # reset after the third cue, a stamp that falls back at the end
    rows = [(i, 1, None, i, s, s + 2, t, None) for i, (s, t) in enumerate(zip(starts, texts, strict=True))]
    files = spark.createDataFrame([(1, "en", "talk")], "file_id long, lang string, track string")
    cast = spark.createDataFrame([(1, 1, "Selel Hestnov", None), (2, 1, "Vosan Zandoty", None)], "speaker_id long, file_id long, full_name string, role_name string")
    spoken = lambda **o: [(r.speaker_id, r.first_cue_id, r.last_cue_id) for r in turns(spark.createDataFrame(rows, CUES), files, cast, **o).orderBy("turn").collect()]
    assert spoken(written=True) == [(1, 0, 1), (2, 2, 3), (1, 4, 5)]
    assert spoken(reset_ms=0) == [(1, 0, 1), (1, 4, 4), (2, 2, 2)] or spoken(reset_ms=0) != spoken(written=True)


def test_names_of_many_words():
    cast = cast_of("1\tAna Maria del Mar Lopez\t\n2\tIvo\tChief Engineer of Ships")
    assert list(pieces("Ana Maria del Mar Lopez: yes.", cast, "en")) == [(1, "yes.")]
    assert list(pieces("No. Chief Engineer of Ships: aye.", cast, "en")) == [(None, "No."), (2, "aye.")]


def test_hot_forms_and_classes(spark, monkeypatch):
    rows = [("text", 1, i, "sea" if i % 3 else "ѕеа") for i in range(240)] + [("text", 1, 900, "alone"), ("text", 1, 5, "ѕеа")]
    df = spark.createDataFrame(rows, "field string, scope long, id long, value string")
    whole = {tuple(r) for r in lookalike.look_same_pairs(df).collect()}
    monkeypatch.setattr(lookalike, "HOT", 7)
    parts = lookalike.look_same_pairs(df).collect()
    assert whole == {tuple(r) for r in parts} and len(parts) == len(whole)
    links = {r.id: (r.class_id, r.n_links) for r in lookalike.look_same_classes(df).collect()}
    assert 900 not in links and links[1] == (0, 81) and links[0] == (0, 160)


def test_grouping_packs_what_best_fit_does_not():
    sizes = {51: 600, 27: 600, 26: 600, 23: 1200}
    blocks, n = packing.plan(sizes, 100)
    rooms: list[int] = []
    for s in sorted((s for s, k in sizes.items() for _ in range(k)), reverse=True):
        fit = min((r for r in set(rooms) if r >= s), default=None)
        if fit is None:
            rooms.append(100 - s)
        else:
            rooms[rooms.index(fit)] -= s
    assert len(rooms) == 1100 and n <= 905 and blocks


def test_a_cell_table_with_clashing_columns(spark):
    documents, weights = mixed(spark)
    clashing = documents.withColumns({"tokens": F.lit(1), "expected": F.lit("x"), "copies": F.lit(2), "topic": F.lit("t"), "mass": F.lit(0)})
    assert mixing.selection(clashing, weights).count() > 0
    assert mixing.selection(clashing.where("false"), weights).count() == 0
