import random

from lexiloom.operators.sequence import ordered_scan


def test_scan_equals_a_loop(spark):
    random.seed(2)
    rows = [(g, o // 7, o, random.choice([None, random.randint(0, 99)])) for g in (1, 2, 3) for o in random.sample(range(200), 80)]
    df = spark.createDataFrame(rows, "g int, bucket int, o int, v int")
    out = ordered_scan(df, ["g"], "bucket", ["o"], count="n", lag={"before": "v"}, fill={"last": "v"}, peak_before={"peak": "v"}, total={"sum": "v"})
    got = {(r.g, r.o): (r.n, r.before, r.last, r.peak, r["sum"]) for r in out.collect()}
    for g in (1, 2, 3):
        n, before, last, peak, total = 0, None, None, None, 0
        for _, _, o, v in sorted(r for r in rows if r[0] == g):
            n += 1
            last = v if v is not None else last
            total += v or 0
            assert got[g, o] == (n, before, last, peak, total)
            before = v
            peak = v if peak is None else max(peak, v if v is not None else peak)
    assert len(got) == len(rows)


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame([(None, 0, 1, 1), (1, None, 1, 1), (1, 0, 1, 1)], "g int, bucket int, o int, v int")
    assert ordered_scan(df, ["g"], "bucket", ["o"], count="n").count() == 1
