"""Filling containers of fixed capacity with documents."""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.tokens import RANKS, with_tokens
from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

#: Roundings that are tried: sizes above capacity / first are put into second groups of equal numbers of items. Few
#: groups allow patterns of many items, many groups round little.
ROUNDINGS = ((6, 14), (4, 30), (3, 90), (2, 400))
#: Items of one size, or documents that exceed a capacity, that a task ranks: they are spread over as many buckets as they
#: have times as many, and over FEWEST at least.
BUCKET, FEWEST = 50_000, 64


class Block(NamedTuple):
    """Items of one size with ranks lo to hi; the item of rank r goes to base + ((r - lo + shift) // div) % mod."""

    size: int
    lo: int
    hi: int
    base: int
    shift: int
    div: int
    mod: int


def patterns(sizes: list[int], capacity: int) -> np.ndarray:
    """All ways to fill a container with items of a few sizes to which no further item can be added."""
    found: list[list[int]] = []

    def extend(at: int, room: int, counts: list[int]) -> None:
        if at == len(sizes):
            if room < min(sizes):
                found.append(counts)
            return
        for n in range(room // sizes[at], -1, -1):
            extend(at + 1, room - n * sizes[at], [*counts, n])

    extend(0, capacity, [])
    return np.array(found, float)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, by the linear program that covers ``demand`` with the fewest containers.

    Column generation over the enumerated patterns; the program's solution is rounded down, so that a few items stay.
    """
    every = patterns(sizes, capacity)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        gain = every @ price
        enter = every[int(np.argmax(gain))]
        if gain.max() <= 1 + 1e-9:
            break
        level, direction = np.linalg.solve(basis, need), np.linalg.solve(basis, enter)
        ratio = np.where(direction > 1e-12, np.maximum(level, 0) / np.where(direction > 1e-12, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = enter
    level = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(int)
    return [(basis[:, i].astype(int), int(n)) for i, n in enumerate(level) if n > 0]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Block], int]:
    """The plan with the fewest containers over the roundings (see ``grouped_plan``), the first of several such."""
    return min((grouped_plan(histogram, capacity, *r) for r in ROUNDINGS), key=lambda p: p[1])


def grouped_plan(histogram: dict[int, int], capacity: int, large_from: int, n_groups: int) -> tuple[list[Block], int]:
    """Blocks that place every item of ``histogram`` (size up to ``capacity`` -> number), and the number of containers.

    Linear grouping: large items in descending order are cut into groups of equal number, each group is rounded up to
    its largest size, and configurations of these few sizes are optimised. The actual items take the places of the
    rounded ones, which leaves room; the items left over and the small ones go, in descending order, where they fit
    best. All work is on numbers of items of a size: its amount depends on the capacity, not on the number of items.
    """
    blocks: list[Block] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    n_containers = 0

    def add(room: int, start: int, count: int) -> None:
        if count > 0:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((start, count))

    large = sorted((s for s, n in histogram.items() if s * large_from > capacity and n), reverse=True)
    total = sum(histogram[s] for s in large)
    if large:
        # Pieces (size, lo, hi) of each group, in descending order of size.
        exact = len(large) <= n_groups
        quota = -(-total // n_groups)
        groups: list[list[tuple[int, int, int]]] = [[]]
        filled = 0
        for s in large:
            at = 0
            while at < histogram[s]:
                if filled == quota or exact and at == 0 and groups[-1]:
                    groups.append([])
                    filled = 0
                n = histogram[s] if exact else min(quota - filled, histogram[s] - at)
                groups[-1].append((s, at, at + n))
                at, filled = at + n, filled + n
        merged: dict[int, list[tuple[int, int, int]]] = {}
        for g in groups:
            merged.setdefault(g[0][0], []).extend(g)
        tops = list(merged)
        pieces = [merged[t] for t in tops]
        demand = [sum(hi - lo for _, lo, hi in g) for g in pieces]
        queues = [list(g) for g in pieces]
        for pattern, times in configurations(tops, demand, capacity):
            base = n_containers
            edges = {0}
            slots: list[list[tuple[int, int, int]]] = []
            for g, per in enumerate(pattern):
                for _ in range(int(per)):
                    slot, need = [], times
                    while need and queues[g]:
                        s, lo, hi = queues[g].pop(0)
                        n = min(need, hi - lo)
                        if n < hi - lo:
                            queues[g].insert(0, (s, lo + n, hi))
                        first = times - need
                        blocks.append(Block(s, lo, lo + n, base + first, 0, 1, n))
                        slot.append((first, first + n, s))
                        edges |= {first, first + n}
                        need -= n
                    slots.append(slot)
            cuts = sorted(edges | {times})
            for a, b in zip(cuts, cuts[1:]):
                used = sum(s for slot in slots for x, y, s in slot if x <= a < y)
                add(capacity - used, base + a, b - a)
            n_containers += times
        left: dict[int, list[tuple[int, int]]] = {}
        for q in queues:
            for s, lo, hi in q:
                left.setdefault(s, []).append((lo, hi))
    else:
        left = {}
    for s in sorted((s for s, n in histogram.items() if s > 0 and n and s * large_from <= capacity), reverse=True):
        left[s] = [(0, histogram[s])]
    for s in sorted(left, reverse=True):
        for lo, hi in left[s]:
            while lo < hi:
                i = bisect_left(rooms, s)
                if i == len(rooms):
                    per = capacity // s
                    fresh = -(-(hi - lo) // per)
                    add(capacity, n_containers, fresh)
                    n_containers += fresh
                    continue
                room = rooms[i]
                start, count = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(i)
                per = room // s
                whole = min(count, (hi - lo) // per)
                if whole:
                    blocks.append(Block(s, lo, lo + whole * per, start, 0, per, whole))
                    add(room - per * s, start, whole)
                    lo += whole * per
                if whole < count:
                    rest = hi - lo if hi - lo < per else 0
                    if rest:
                        blocks.append(Block(s, lo, hi, start + whole, 0, per, 1))
                        add(room - rest * s, start + whole, 1)
                        lo, whole = hi, whole + 1
                    add(room, start + whole, count - whole)
    if histogram.get(0):
        n_containers = max(n_containers, 1)
        blocks.append(Block(0, 0, histogram[0], 0, 0, histogram[0], 1))
    return blocks, n_containers


def assignment(documents: DataFrame, limits: DataFrame, path: str = RANKS) -> DataFrame:
    """Containers of all documents for each capacity: limit_id, capacity_tokens, container_id, doc_id, part, from_token,
    n_tokens.

    A document larger than the capacity, and no other, is split: into parts that fill containers of their own and a rest
    that is packed like any item. A null or empty text takes no room and has its place in container 0. Capacities that
    are null or below 1 are left out; repeated document rows are items of their own. Only numbers of items per size are
    gathered, at most capacity + 1 of them; the documents get their containers by rank among those of their size.
    """
    sized = cut(with_tokens(documents.where("doc_id is not null"), "doc_id bigint", path))
    wanted = [(r.limit_id, r.capacity_tokens) for r in limits.select("limit_id", "capacity_tokens").where("capacity_tokens > 0 and limit_id is not null").distinct().orderBy("limit_id").collect()]
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity_tokens")) for i, c in wanted])) if wanted else None
    if each is None:
        return documents.sparkSession.createDataFrame([], "limit_id int, capacity_tokens int, container_id bigint, doc_id bigint, part int, from_token bigint, n_tokens bigint")
    items = sized.select("doc_id", "tokens", each.alias("x")).select("x.*", "doc_id", "tokens").withColumns(
        {
            "full": F.when(F.col("tokens") > F.col("capacity_tokens"), F.floor(F.col("tokens") / F.col("capacity_tokens"))).otherwise(0),
        }
    )
    items = items.withColumn("size", F.col("tokens") - F.col("full") * F.col("capacity_tokens"))
    packed = (F.col("size") > 0) | (F.col("full") == 0)
    counted = items.groupBy("limit_id", "capacity_tokens", "size").agg(F.count_if(packed).alias("n"), F.count_if(F.col("full") > 0).alias("n_split")).collect()
    n_split: dict[int, int] = {}
    for c in counted:
        n_split[c.limit_id] = n_split.get(c.limit_id, 0) + c.n_split
    most = max([c.n for c in counted] + [*n_split.values()], default=0)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(FEWEST, -(-most // BUCKET)))))
    rows: list[tuple[int, ...]] = []
    used: list[tuple[int, int]] = []
    for limit_id, capacity in wanted:
        blocks, n = plan({r["size"]: r["n"] for r in counted if r.limit_id == limit_id and r["n"]}, capacity)
        rows += [(limit_id, *b) for b in blocks]
        used.append((limit_id, n))
    session = documents.sparkSession
    table = session.createDataFrame(rows, "limit_id int, size bigint, lo bigint, hi bigint, base bigint, shift bigint, div bigint, mod bigint")
    by_size = table.groupBy("limit_id", "size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "shift", "div", "mod"))).alias("blocks"))
    ranked = ordered_scan(items.where("size > 0 or full = 0"), ["limit_id", "size"], "bucket", ["doc_id"], count="rank")
    r = F.col("rank") - 1
    block = F.element_at(F.filter("blocks", lambda b: (b["lo"] <= r) & (r < b["hi"])), 1)
    ends = ranked.join(by_size, ["limit_id", "size"]).withColumn("b", block)
    ends = ends.select(
        "limit_id", "capacity_tokens",
        (F.col("b.base") + F.floor((r - F.col("b.lo") + F.col("b.shift")) / F.col("b.div")) % F.col("b.mod")).alias("container_id"),
        "doc_id", F.col("full").cast("int").alias("part"), (F.col("full") * F.col("capacity_tokens")).alias("from_token"),
        F.col("size").alias("n_tokens"),
    )
    offsets = session.createDataFrame(used, "limit_id int, packed bigint")
    split = ordered_scan(items.where("full > 0"), ["limit_id"], "bucket", ["doc_id"], total={"upto": "full"}).join(F.broadcast(offsets), "limit_id")
    parts = split.select("*", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("part")).select(
        "limit_id", "capacity_tokens", (F.col("packed") + F.col("upto") - F.col("full") + F.col("part")).alias("container_id"),
        "doc_id", "part", (F.col("part") * F.col("capacity_tokens")).cast("bigint").alias("from_token"),
        F.col("capacity_tokens").cast("bigint").alias("n_tokens"),
    )
    return ends.unionByName(parts)


def summary(documents: DataFrame, limits: DataFrame, path: str = RANKS) -> DataFrame:
    """Per capacity: documents, split documents, containers, tokens, unused share, and the least containers possible by
    the total size."""
    packed = assignment(documents, limits, path)
    filled = packed.groupBy("limit_id", "capacity_tokens", "container_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("part") == 0).alias("begun"), F.count_if(F.col("part") == 1).alias("split")
    )
    out = filled.groupBy("limit_id", "capacity_tokens").agg(
        F.sum("begun").alias("n_documents"), F.sum("split").alias("n_split"), F.count(F.lit(1)).alias("n_containers"),
        F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("fullest"),
    )
    room = F.col("n_containers") * F.col("capacity_tokens")
    return out.withColumn("unused_share", 1 - F.col("n_tokens") / room).withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
