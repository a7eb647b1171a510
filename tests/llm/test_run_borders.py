"""Runs of slips are found alike wherever a border of spans falls."""

from lexiloom.llm.runs import runs

CUES = "cue_id long, file_id long, cue_ord int, start_s double, end_s double, text string"
TEXTS = ["the carpentr sold", "the carpenter sold", "other", "the carpentr sold", "the carppenter sold", "the carpenter sold", "other", "the carpenter sold", "the carpentr sold", "the carppenter sold"]


def test_slips_beside_borders(spark):
    starts = [[2.0 * i + 600.0 * (i >= at) for i in range(len(TEXTS))] for at in range(len(TEXTS))] + [[600.0 * i for i in range(len(TEXTS))]]
    rows = [(i + 1, f, i + 1, s, s + 1.5, TEXTS[i]) for f, times in enumerate(starts) for i, s in enumerate(times)]
    files = spark.createDataFrame([(f, "en", "auto") for f in range(len(starts))], "file_id long, lang string, track string")
    got = {}
    for r in runs(spark.createDataFrame(rows, CUES), files).collect():
        got.setdefault(r.file_id, []).append((r.first_cue_id, r.last_cue_id))
    assert {f: sorted(x) for f, x in got.items()} == {f: [(1, 2), (4, 6), (8, 10)] for f in range(len(starts))}
