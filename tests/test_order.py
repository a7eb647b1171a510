import random

from lexiloom.operators.graph import closure, cycle_edges, dependency_order, levels
from lexiloom.operators.order import shuffled
from lexiloom.operators.timeline import as_of, coverage_rows
from lexiloom.streaming.coverage import culled, kept, windowed_counts


def graph(spark, n=160, seed=3):
    random.seed(seed)
    edges = [(1, i, d) for i in range(1, n) for d in random.sample(range(max(0, i - 40), i), min(i, random.choice([0, 0, 1, 2])))]
    cards = spark.createDataFrame([(1, i) for i in range(n)], "source_ord long, idx int")
    return cards, spark.createDataFrame(edges, "source_ord long, idx int, dep int"), edges


def test_shuffle_keeps_dependencies_and_places(spark):
    cards, edges, plain = graph(spark)
    places = {r.idx: r.place for r in shuffled(cards, edges, 5, window=30).collect()}
    assert sorted(places.values()) == list(range(1, 161))
    assert all(places[d] < places[i] for _, i, d in plain)
    assert max(abs(p - 1 - i) for i, p in places.items()) <= 30
    assert places != {r.idx: r.place for r in shuffled(cards, edges, 6, window=30).collect()}


def test_edges_to_later_cards_and_cycles(spark):
    cards = spark.createDataFrame([(1, i) for i in range(60)], "source_ord long, idx int")
    edges = spark.createDataFrame([(1, 2, 50), (1, 7, 3), (1, 3, 7), (1, 9, 12), (1, 12, 20), (1, 5, 2), (1, 8, 99), (1, 4, 4)], "source_ord long, idx int, dep int").where("idx <> dep")
    assert {(r.idx, r.dep) for r in cycle_edges(edges).collect()} == {(3, 7)}
    places = {r.idx: r.place for r in shuffled(cards, edges, 5, window=10).collect()}
    assert sorted(places.values()) == list(range(1, 61))
    for i, d in ((2, 50), (7, 3), (9, 12), (12, 20), (5, 2)):
        assert places[d] < places[i]
    order = {r.idx: r.place for r in dependency_order(cards, edges.where("dep < 60")).collect()}
    assert all(order[d] < order[i] for i, d in ((2, 50), (7, 3), (9, 12), (12, 20)))


def test_chains_beyond_a_thousand(spark):
    chain = spark.range(1, 1201).selectExpr("1L as source_ord", "cast(id as int) as idx", "cast(id - 1 as int) as dep")
    found = closure(chain)
    assert found.count() == 1200 * 1201 // 2 and found.where("idx = 1200 and dep = 0").count() == 1


def test_closure_and_levels(spark):
    cards, edges, plain = graph(spark, 60)
    needs = {}
    for _, i, d in plain:
        needs.setdefault(i, set()).add(d)
    full, depth = {}, {}
    for i in range(60):
        full[i] = set().union(*[{d} | full[d] for d in needs.get(i, ())]) if needs.get(i) else set()
        depth[i] = max((depth[d] + 1 for d in needs.get(i, ())), default=0)
    got = {(r.idx, r.dep) for r in closure(edges).collect()}
    assert got == {(i, d) for i, ds in full.items() for d in ds}
    assert {r.idx: r.level for r in levels(cards, edges, upward=False).collect()} == depth


def test_as_of_and_coverage(spark):
    marks = spark.createDataFrame([(1, 0, 5.0), (1, 10, 7.0)], "g long, x long, t double")
    points = spark.createDataFrame([(1, -3, "a"), (1, 10, "b"), (1, 9, "c"), (2, 1, "d")], "g long, x long, name string")
    assert {r.name: r.t for r in as_of(points, marks, "g", "x", "t").collect()} == {"a": 5.0, "b": 7.0, "c": 5.0, "d": None}
    met = spark.createDataFrame([(1, 0.0, 10)] * 18 + [(1, 0.0, 99), (1, 301.0, None), (1, 302.0, None)], "g long, t double, position long")
    ends = spark.createDataFrame([(1, 400.0), (2, 10.0)], "g long, end double")
    rows = {(r.g, r.cutoff): (r.n_met, r.n_untaught, r.cards, r.furthest) for r in coverage_rows(met, ends, "g").collect()}
    assert rows == {(1, 300.0): (19, 0, 99, 99), (1, 400.0): (21, 2, None, 99), (2, 10.0): (0, 0, 0, 0)}


def test_schedule_and_streams(spark, tmp_path):
    assert [n for n in range(1, 37) if kept(n)] == [1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 28, 36]
    spark.createDataFrame([("r", i, f"s{i}") for i in range(12)] + [("r", 12, "s4"), ("r", 13, "s0")], "rule string, ord long, surface string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = culled(spark.readStream.schema("rule string, ord long, surface string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("culled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    flags = {r.ord: r.kept for r in spark.table("culled").collect()}
    assert [i for i in range(12) if flags[i]] == [0, 1, 2, 3, 5, 7, 9, 11] and flags[13] and not flags[12]
    events = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'a' event_type union all select timestamp'2024-01-01 00:04:59', 'a'")
    assert windowed_counts(events).first().n == 2
