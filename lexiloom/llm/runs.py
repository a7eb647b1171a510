"""Runs of consecutive events that show the same line."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.arrow_sql import map_sql
from lexiloom.llm.cues import ORDER, ordered_cues
from lexiloom.llm.lookalike import CYRILLIC, GREEK, KANA, accented, guarded, replaced, settled_steps, translated
from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

#: A word with a letter missing, doubled or wrong has at least so many letters.
LONG_WORD = 7


@cache
def line_sql(names: str) -> str:
    """The query that adds to ``names`` of table rows the words of ``text`` that make its line.

    Tags, case, punctuation, spacing and look-alike differences are gone. Capitals are compared, since letters that
    differ may have capitals that look alike. A text without any word keeps its marks, after a space.
    """
    pairs = accented(CYRILLIC) | accented(GREEK)
    capitals = {a: b for a, b in pairs.items() if a == a.upper()}
    steps = [
        f"SELECT {names}, regexp_replace(text, '<[^<>]*>|\\{{[^{{}}]*\\}}', '', 'g') AS text FROM rows",
        *settled_steps(names, "text"),
        f"SELECT {names}, wide, replace(replace(upper(c), 'ß', 'SS'), 'ẞ', 'SS') AS u",
        f"SELECT {names}, wide, {guarded('wide', 'u', capitals, translated)} AS u",
        f"SELECT {names}, {guarded('wide', 'u', KANA, translated)} AS u",
        f"SELECT {names}, u, trim(regexp_replace(u, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) AS line",
        f"SELECT {names}, CASE WHEN line = '' THEN concat(' ', replace(u, ' ', '')) ELSE line END AS line",
    ]
    query = steps[0]
    for step in steps[1:]:
        query = f"{step} FROM ({query})"
    return query


def same_line(a: Column, b: Column, unspaced: str = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]") -> Column:
    """Whether two lines are equal but for slips: a letter missing, doubled or wrong in a long word.

    A cue may have one slip, so that two of one run may differ in two words. The distance limit settles nearly all
    pairs before any word is looked at. Digits never slip, nor do scripts without spaces between words.
    """
    pair = F.arrays_zip(F.split(a, " ").alias("a"), F.split(b, " ").alias("b"))
    slips = F.filter(pair, lambda p: p["a"] != p["b"])
    small = F.forall(
        slips,
        lambda p: (F.greatest(F.length(p["a"]), F.length(p["b"])) >= LONG_WORD)
        & (F.levenshtein(p["a"], p["b"]) == 1)
        & ~p["a"].rlike(r"\p{N}")
        & ~p["b"].rlike(r"\p{N}"),
    )
    close = (F.abs(F.length(a) - F.length(b)) <= 2) & (F.levenshtein(a, b, 2).between(1, 2))
    near = close & (F.size(F.split(a, " ")) == F.size(F.split(b, " "))) & ~a.rlike(unspaced) & (F.size(slips) <= 2)
    return F.coalesce((a == b) | (near & small), F.lit(False))


def linked(cues: DataFrame, files: DataFrame, tracks: list[str]) -> DataFrame:
    """The cues that show the same line as the cue before them in their file, each with that cue's id and start.

    Two cues with different slips of one word show the same line if a neighbour of the pair shows it too.
    """
    rows = ordered_cues(cues, files, tracks)
    names = "file_id, span, cue_id, cue_ord, start_ms, end_ms"
    lines = map_sql(
        rows.select(*names.split(", "), "text"),
        line_sql(names),
        "file_id bigint, span bigint, cue_id bigint, cue_ord int, start_ms bigint, end_ms bigint, line string",
    )
    lines = cut(lines)
    scanned = ordered_scan(
        lines, ["file_id"], "span", ORDER, count="place",
        lag={"before_line": "line", "before_id": "cue_id", "before_ms": "start_ms", "before_end": "end_ms"},
    )
    # The cues on both sides of the pair: inside a span in the scan's partitions and order, at its borders from the spans
    # beside it, carried over the few rows that stand for a file's spans.
    edges = scanned.groupBy("file_id", "span").agg(F.max_by("before_line", "place").alias("earlier"), F.min_by("line", "place").alias("later"))
    across = Window.partitionBy("file_id").orderBy("span")
    edges = edges.select("file_id", "span", F.lag("earlier").over(across).alias("_earlier"), F.lead("later").over(across).alias("_later"))
    inside = Window.partitionBy("file_id", "span").orderBy(*ORDER)
    first, last = F.row_number().over(inside) == 1, F.lead("place").over(inside).isNull()
    scanned = scanned.join(edges, ["file_id", "span"]).withColumns({
        "earlier": F.when(first, F.col("_earlier")).otherwise(F.lag("before_line").over(inside)),
        "later": F.when(last, F.col("_later")).otherwise(F.lead("line").over(inside)),
    }).drop("_earlier", "_later")
    line, before = F.col("line"), F.col("before_line")
    between = [same_line(F.col(w), before) & same_line(F.col(w), line) for w in ("earlier", "later")]
    twice = F.coalesce(F.levenshtein(line, before, 2).between(1, 2), F.lit(False)) & (between[0] | between[1])
    return scanned.where(same_line(line, before) | twice).drop("earlier", "later")


def pointer_doubling(links: DataFrame, group: str, place: str) -> DataFrame:
    """Add ``head``, the place where the run of each linked row starts.

    Every row of ``links`` points to the place before its own. Each round replaces pointers by their targets' pointers,
    so that a run of n takes log2(n) rounds; the rounds end when no pointer moves. Each round's rows are written to the
    checkpoint folder. A run of any length is spread over all tasks. No links, no rows.
    """
    at = cut(links.withColumn("head", F.col(place) - 1))
    while True:
        to = at.select(F.col(group), F.col(place).alias("head"), F.col("head").alias("further"))
        moved = at.join(to, [group, "head"], "left")
        at = cut(
            moved.select(
                *links.columns,
                F.coalesce("further", "head").alias("head"),
                F.col("further").isNotNull().alias("moved"),
            )
        )
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def runs(cues: DataFrame, files: DataFrame, tracks: tuple[str, ...] = ("auto", "sub")) -> DataFrame:
    """Each longest run of two or more consecutive cues that show the same line.

    Result: file_id, first_cue_id, last_cue_id, n_cues, from_ms, to_ms (the latest end that is known, else the last
    start) and line. Cues without start or with a blank text belong to no run; repeated deliveries count once; cues that
    start at once are in the order as written. An empty table gives no rows.
    """
    headed = pointer_doubling(linked(cues, files, list(tracks)), "file_id", "place")
    return headed.groupBy("file_id", "head").agg(
        F.min_by("before_id", "place").alias("first_cue_id"),
        F.max_by("cue_id", "place").alias("last_cue_id"),
        (F.count(F.lit(1)) + 1).alias("n_cues"),
        F.min("before_ms").alias("from_ms"),
        F.greatest(F.max("end_ms"), F.max("before_end"), F.max("start_ms")).alias("to_ms"),
        F.min_by("before_line", "place").alias("line"),
    ).drop("head")
