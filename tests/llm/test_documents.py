import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import mixing, packing, truncation

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, series string, loaded_at timestamp, encoding string, limit int, topic string, tokens long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None, None, None, "x", 1, "y", 3) for i, t, la, s in rows], DOCUMENTS)


def first_fit(sizes, capacity):
    """Containers that first fit takes, largest items first."""
    rooms = []
    for s in sorted((s for s, k in sizes.items() for _ in range(k) if s), reverse=True):
        i = next((i for i, room in enumerate(rooms) if room >= s), None)
        if i is None:
            rooms.append(capacity)
            i = len(rooms) - 1
        rooms[i] -= s
    return len(rooms)


@pytest.mark.parametrize("capacity", [1, 7, 60, 512])
def test_plan_places_every_item_once(capacity):
    random.seed(capacity)
    for _ in range(4):
        sizes = {}
        for _ in range(120):
            s = random.choice([0, 1, capacity, capacity // 2 + 1, random.randint(1, capacity)])
            sizes[s] = sizes.get(s, 0) + random.randint(1, 40)
        blocks, n = packing.plan(sizes, capacity)
        load, seen = [0] * n, set()
        for b in blocks:
            for r in range(b.lo, b.hi):
                load[b.base + ((r - b.lo + b.shift) // b.div) % b.mod] += b.size
                seen.add((b.size, r))
        assert max(load) <= capacity and len(seen) == sum(sizes.values()) and min(load) >= 0
        assert n <= first_fit(sizes, capacity) * 1.01 + 8
    assert packing.plan({}, 5) == ([], 0)


def test_assignment(spark):
    random.seed(4)
    rows = [(i, " ".join(random.choices(["salt", "rope", "лодка", "水"], k=random.choice([0, 1, 5, 30, 200]))), "en", "s") for i in range(150)]
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, "word " * 30_000, "en", "s"), rows[3]]
    limits = spark.createDataFrame([(1, 64, 0), (2, 512, 0), (2, 512, 1), (3, None, 0), (4, 0, 0)], "limit_id int, capacity_tokens int, n_tokens int")
    out = packing.assignment(docs(spark, rows), limits).cache()
    assert {r.limit_id for r in out.select("limit_id").distinct().collect()} == {1, 2}
    fill = out.groupBy("limit_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(r.n <= r.capacity_tokens for r in fill)
    from lexiloom.llm.tokens import encoding, RANKS

    size = {i: len(encoding(RANKS).encode_ordinary(t or "")) for i, t, *_ in rows}
    for limit, capacity in ((1, 64), (2, 512)):
        parts = out.where(F.col("limit_id") == limit).collect()
        total = {}
        for r in parts:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            assert r.part == 0 or size[r.doc_id] > capacity
            assert r.from_token == r.part * capacity
        assert total == size | {3: 2 * size[3]}
    assert packing.assignment(docs(spark, rows).where("false"), limits).count() == 0
    assert packing.assignment(docs(spark, rows), limits.where("false")).count() == 0


def test_rake():
    mass = np.array([4.0, 1.0, 2.0, 3.0])
    share = mixing.rake(mass, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.5, 0.5]), np.array([0.7, 0.3])])
    assert np.allclose([share[0] + share[1], share[0] + share[2]], [0.5, 0.7])


def test_mixing(spark):
    random.seed(5)
    rows = [(i, " ".join(["word"] * random.randint(5, 60)), random.choice(["en", "de", None]), random.choice("aaaaaabbc")) for i in range(800)]
    rows += [(9001, None, "en", "a"), (9002, "", "en", "b"), (9003, "x", "en", None), (9004, "x", "en", "unlisted")]
    weights = spark.createDataFrame([("a", 0.4, 1, 7), ("b", 0.4, 3, 7), ("c", 0.2, 4, 7), ("gone", 0.1, 2, 7)], "source string, target_share double, max_repeats int, n_tokens int")
    got = {r.source: r for r in mixing.shares(docs(spark, rows), weights).collect()}
    for name, share in (("a", 0.4), ("b", 0.4), ("c", 0.2)):
        assert abs(got[name].actual_share - share) < 0.01 and got[name].most_copies <= got[name].max_repeats
    assert got["gone"].n_tokens == 0
    tilted = mixing.selection(docs(spark, rows), weights, language_targets={"en": 0.6, "de": 0.3, "": 0.1}).join(docs(spark, rows).select("doc_id", "lang"), "doc_id")
    by = {r.lang: r.n for r in tilted.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    assert abs(by["en"] / sum(by.values()) - 0.6) < 0.03
    assert mixing.selection(docs(spark, rows).where("false"), weights).count() == 0
    assert mixing.selection(docs(spark, rows), weights.where("false")).count() == 0


SUBJECTS, VERBS = ["The baker", "A weaver", "Dr. Belkor", "My neighbour"], ["sold", "painted", "repaired", "counted"]
THINGS, PLACES = ["a lamp", "the kettle", "three jars", "an empty cage"], ["near the canal", "at dusk", "behind the mill", "on p. 14"]


def sentence():
    return " ".join(map(random.choice, (SUBJECTS, VERBS, THINGS, PLACES)))


def test_truncation(spark):
    random.seed(6)
    rows, cut = [], set()
    for i in range(900):
        source = ("full", "short", "loose")[i % 3]
        if source == "loose":
            text = "\n".join(sentence().lower() for _ in range(random.randint(3, 9)))
            if i % 30 == 2:
                text, _ = text[: text.rfind(" ") - 3], cut.add(i)
        else:
            text = " ".join(sentence() + "." for _ in range(random.randint(1, 9))) + random.choice(["", "", "\nTags: verbs, travel", "\n— notes"])
        if source == "short" and len(text) > 200:
            text = text[:200]
            if not text.rstrip().endswith((".", "Tags: verbs, travel", "— notes")) or text.rstrip().endswith((" p.", "Dr.")):
                cut.add(i)
        if source == "full" and i % 60 == 0:
            text, _ = text[:40] + random.choice(["�", " &quo", " <i"]), cut.add(i)
        rows.append((i, text, "en" if i % 7 else None, source))
    rows += [(2001, None, "en", "full"), (2002, "", "en", "full"), (2003, " \n", None, None), (2004, "Fine.", None, None), (2005, "word " * 20_000 + "end.", "en", "full")]
    got = {r.doc_id for r in truncation.cut_documents(docs(spark, rows)).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(got), (sorted(got - cut)[:9], sorted(cut - got)[:9])
    limit = truncation.hidden_limits(docs(spark, rows)).collect()
    assert [(r.source, r.encoding, r.length) for r in limit] == [("short", "characters", 200)]
    shares = {r.source: r for r in truncation.cut_shares(docs(spark, rows)).collect()}
    assert shares["short"].limit_length == 200 and shares["full"].limit_length is None
    assert truncation.cut_documents(docs(spark, rows).where("false")).count() == 0


def test_hidden_limit_in_bytes(spark):
    random.seed(7)
    texts = ["".join(random.choices("абвгд ", k=random.randint(50, 400))) for _ in range(300)]
    rows = [(i, t.encode()[:512].decode(errors="ignore"), "ru", "s") for i, t in enumerate(texts)]
    row = truncation.hidden_limits(docs(spark, rows)).first()
    assert row.encoding == "utf-8 bytes" and row.length == 512
