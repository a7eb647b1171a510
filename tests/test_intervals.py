import random

from lexiloom.operators.intervals import coverage, periods_and_gaps

SCHEMA = "file_id long, cue_id long, start_s double, end_s double, kind string, span long, a long"


def brute(rows):
    by = {}
    for f, _, a, b, *_ in rows:
        if f is not None and a is not None and b is not None and a == a and b == b:
            a, b = round(a * 1000), round(b * 1000)
            if b > a:
                by.setdefault(f, []).append((a, b))
    out = set()
    for f, spans in by.items():
        spans.sort()
        low, high = spans[0]
        for a, b in spans[1:]:
            if a > high:
                out |= {(f, "period", low, high), (f, "gap", high, a)}
                low, high = a, b
            high = max(high, b)
        out.add((f, "period", low, high))
    return out


def test_against_brute_force_with_clashing_columns(spark):
    random.seed(1)
    rows = []
    for i in range(600):
        a = random.choice([None, float("nan"), random.randint(0, 3_000_000) / 1000, random.randint(0, 90_000) / 1000])
        b = random.choice([None, (a or 0) + random.randint(-5, 400) / 10, (a or 0.0) + random.randint(0, 9)])
        rows.append((random.choice([1, 1, 2, 3, None]), i, a, b, "x", 5, 7))
    rows += rows[:50]
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_touching_nested_and_noise(spark):
    rows = [(1, 1, 0.0, 5.0, "", 0, 0), (1, 2, 1.0, 2.0, "", 0, 0), (1, 3, 4.9999999, 6.0, "", 0, 0), (1, 4, 6.0000001, 7.0, "", 0, 0), (1, 5, 8.0, 8.0, "", 0, 0), (1, 6, 9000.0, 9001.0, "", 0, 0)]
    got = {tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "period", 0, 7000), (1, "gap", 7000, 9000000), (1, "period", 9000000, 9001000)}


def test_empty_and_coverage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(empty).collect() == []
    row = coverage(spark.createDataFrame([(1, 1, 0.0, 1.0, "", 0, 0), (1, 2, 3.0, 4.5, "", 0, 0)], SCHEMA)).first()
    assert (row.n_periods, row.n_gaps, row.covered_ms, row.silent_ms) == (2, 1, 2500, 2000)


def test_equal_intervals_in_any_order(spark):
    rows = [(1, i, 10.0 * (i % 40), 10.0 * (i % 40) + 4.0, "", 0, 0) for i in range(400)]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
        assert {tuple(r) for r in got} == brute(rows) and len(got) == 79
