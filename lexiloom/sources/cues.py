"""Cue files: SubRip and WebVTT lines to cues, and cues to running text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

# The lines of cue files and what they carry besides words.
TIMING = r"^\s*(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})\s*-->\s*(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
INDEX = r"^\s*\d+\s*$"
HEADER = r"^\s*(?:WEBVTT|NOTE|STYLE|REGION|Kind:|Language:)"
MARKUP = (
    r"<\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}>|</?[a-zA-Z][^>]*>|\{\\[^}]*\}|\[[^\]]{0,40}\]"
    r"|\((?:music|applause|laughter|laughs|sighs)[^)]*\)"
)
SPEAKER_MARK = r"^\s*(?:>>+|[-–—])\s*"
TERMINAL = r"[.!?。！？…]$"
PUNCTUATED, PAUSE, MAX_WORDS = 0.1, 0.8, 40
#: Lines, or cues, of a bucket.
BLOCK = 2048
#: What lies between the numbers of two cues' lines where these have gaps.
CUE_STEP = 1 << 31


def cleaned(line: Column) -> Column:
    """A line's words: without markup and the mark of a new speaker, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(line, f"(?i){MARKUP}", " "), SPEAKER_MARK, "")
    return F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))


def seconds(line: Column, first: int) -> Column:
    """The clock time of the four groups of a timing line from ``first`` on."""
    part = lambda i: F.regexp_extract(line, TIMING, first + i)
    hours = F.when(part(0) == "", F.lit(0)).otherwise(part(0).try_cast("int"))
    fraction = part(3).try_cast("double") / F.pow(F.lit(10.0), F.length(part(3)))
    return (hours * 3600 + part(1).try_cast("int") * 60 + part(2).try_cast("int")).cast("double") + fraction


def looks_like_cues(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """Whether each file is a cue file: a timing line among its first forty, or a header as its first."""
    head = lines.where("line_no < 40")
    hit = F.col("line").rlike(TIMING) | ((F.col("line_no") == 0) & F.col("line").rlike(HEADER))
    return head.groupBy(key).agg(F.max(hit).alias("is_cues"))


def cues_of(lines: DataFrame, key: str = "file_id", block: int = BLOCK) -> DataFrame:
    """Cues of files given as lines (key, line_no, line): key, cue (1-based place of the timing line), start, end, text.

    A line equal to the one kept before it, in this cue or the one before, is dropped, which unrolls scrolling captions.
    Lines before the first timing line belong to no cue, but count as kept. Lines without words, lines of digits only
    and header lines are dropped; so is a cue that has no line left.
    """
    rows = lines.withColumn("block", F.floor(F.col("line_no") / BLOCK)).withColumn("timing", F.col("line").rlike(TIMING).cast("int"))
    rows = cut(ordered_scan(rows, [key], "block", ["line_no"], total={"cue": "timing"}))
    clocks = rows.where("timing = 1").select(key, "cue", seconds(F.col("line"), 1).alias("start"), seconds(F.col("line"), 5).alias("end"))
    words = rows.where("timing = 0").withColumn("words", cleaned(F.col("line")))
    words = words.where((F.col("words") != "") & ~F.col("words").rlike(INDEX) & ~F.col("words").rlike(HEADER))
    words = ordered_scan(words, [key], "block", ["line_no"], lag={"kept": "words"}).where("cue > 0 and (kept is null or kept <> words)")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "words")))
    texts = words.groupBy(key, "cue").agg(F.array_join(F.transform(ordered, lambda x: x["words"]), " ").alias("text"))
    return clocks.join(texts, [key, "cue"])


def punctuated(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """Whether a file's cues are punctuated: at least a tenth of them end with a closing mark."""
    n, ends = F.count(F.lit(1)), F.count_if(F.rtrim("text").rlike(TERMINAL))
    return cues.groupBy(key).agg(n.alias("n_cues"), ends.alias("n_ends"), (ends >= F.lit(PUNCTUATED) * n).alias("punctuated"))


def pauses(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """Each cue with the silence before it: key, cue, silence (null for a file's first one)."""
    rows = cues.withColumn("block", F.floor(F.col("cue") / BLOCK))
    rows = ordered_scan(rows, [key], "block", ["cue"], lag={"before": "end"})
    return rows.select(key, "cue", (F.col("start") - F.col("before")).alias("silence"))


def greedy_breaks(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """How each cue of an unpunctuated file joins the one before: key, cue, joined 'start' | 'space' | 'break'.

    A pause, or 40 words since the last break, breaks. Stretches between pauses are folded apart from each other, in one
    pass over sorted rows that holds a word count only.
    """
    words = F.size(F.filter(F.split("text", r"[\s\p{Z}]+"), lambda w: w != ""))
    rows = cues.withColumn("block", F.floor(F.col("cue") / BLOCK)).withColumn("n_words", words)
    rows = ordered_scan(rows, [key], "block", ["cue"], lag={"before": "end", "before_cue": "cue"})
    first = F.col("before_cue").isNull()
    rows = rows.withColumns({"first": first, "paused": F.when(first | (F.col("start") - F.col("before") >= PAUSE), 1).otherwise(0)})
    rows = ordered_scan(rows, [key], "block", ["cue"], total={"stretch": "paused"})
    sorted_rows = rows.select(key, "stretch", "cue", "n_words", "first").repartition(key, "stretch").sortWithinPartitions(key, "stretch", "cue")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        words = 0
        for batch in batches:
            joined = []
            for group, stretch, n, first in zip(*(batch[i].to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if (group, stretch) != at:
                    at, words = (group, stretch), 0
                    joined.append("start" if first else "break")
                elif words >= MAX_WORDS:
                    words = 0
                    joined.append("break")
                else:
                    joined.append("space")
                words += n
            yield pa.RecordBatch.from_arrays([batch[0], batch[2], pa.array(joined, pa.string())], names=[key, "cue", "joined"])

    return sorted_rows.mapInArrow(fold, f"{key} bigint, cue bigint, joined string")


def placed(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """Cues in the running text of their file: key, cue, joint (what stands before the cue's text), text, starts_at.

    Punctuated files are joined by spaces; in others a pause or a long run of words is a blank line (``greedy_breaks``).
    starts_at is where a cue's text starts in the text of all joints and texts, in characters.
    """
    flags = punctuated(cues, key).select(key, "punctuated")
    told = cut(cues.join(flags, key))
    plain = told.where("punctuated").withColumn("block", F.floor(F.col("cue") / BLOCK))
    plain = ordered_scan(plain, [key], "block", ["cue"], lag={"before_cue": "cue"})
    plain = plain.select(key, "cue", F.when(F.col("before_cue").isNull(), "start").otherwise("space").alias("joined"))
    joined = plain.unionByName(greedy_breaks(told.where("not punctuated"), key))
    joint = F.when(F.col("joined") == "start", "").when(F.col("joined") == "space", " ").otherwise("\n\n")
    rows = told.select(key, "cue", "text").join(joined.select(key, "cue", joint.alias("joint")), [key, "cue"])
    rows = cut(rows.withColumn("room", (F.length("joint") + F.length("text")).cast("long")).withColumn("block", F.floor(F.col("cue") / BLOCK)))
    rows = ordered_scan(rows, [key], "block", ["cue"], total={"upto": "room"})
    return rows.select(key, "cue", "joint", "text", (F.col("upto") - F.length("text")).alias("starts_at"))


def offsets(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """Where each cue's text starts in the running text of its file: key, cue, starts_at."""
    return placed(cues, key).select(key, "cue", "starts_at")


def folded(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """The running text of each file in stretches of up to ``BLOCK`` cues, which follow each other without more between
    them: key, block, text. A file of any length is never one row."""
    rows = placed(cues, key).withColumn("block", F.floor(F.col("cue") / BLOCK))
    ordered = F.array_sort(F.collect_list(F.struct("cue", F.concat("joint", "text").alias("piece"))))
    return rows.groupBy(key, "block").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


def lines_of(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """Whole cue files as lines: key, line_no, line; all line ends count, and a last one opens no line."""
    split = F.split(F.regexp_replace(text, "\\r\\n?|[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", "\n"), "\n")
    lines = F.when(F.element_at(split, -1) == "", F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)
    return files.where(F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def as_lines(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Stored cues as the lines of cue files: file_id, line_no, line."""
    rows = cue_parts(cues, files).withColumns({"n": F.size("parts").cast("long"), "block": F.floor(F.col("cue_ord") / BLOCK)})
    rows = ordered_scan(rows, ["file_id"], "block", ["cue_ord"], total={"upto": "n"})
    rows = rows.select("file_id", (F.col("upto") - F.col("n")).alias("before"), F.posexplode("parts").alias("at", "line"))
    return rows.select("file_id", (F.col("before") + F.col("at")).alias("line_no"), "line")


def as_ordered_lines(cues: DataFrame, files: DataFrame) -> DataFrame:
    """``as_lines`` where only the order counts: line_no grows along a file, with gaps, and needs no scan. The place of a
    line in its cue has 31 bits, as many as any array has places."""
    rows = cue_parts(cues, files).select("file_id", "cue_ord", F.posexplode("parts").alias("at", "line"))
    return rows.select("file_id", (F.col("cue_ord") * CUE_STEP + F.col("at")).alias("line_no"), "line")


def cue_parts(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Stored cues (file_id, cue_ord) with the lines a cue file has for them."""
    once = cues.where("start_s is not null and end_s is not null and text is not null").dropDuplicates(["file_id", "cue_ord"])
    dots = files.select("file_id", F.when(F.col("dialect") == "vtt", ".").otherwise(",").alias("mark")).dropDuplicates(["file_id"])

    def stamp(s: str) -> Column:
        ms = F.round(F.col(s) * 1000).cast("long")
        part = lambda by, mod: F.floor(ms / by).cast("long") % mod
        return F.concat(F.format_string("%02d:%02d:%02d", part(3_600_000, 1000), part(60_000, 60), part(1000, 60)), F.col("mark"), F.format_string("%03d", ms % 1000))

    timing = F.concat(stamp("start_s"), F.lit(" --> "), stamp("end_s"))
    parts = F.concat(F.array(F.col("cue_ord").cast("string"), timing), F.split("text", "\n"), F.array(F.lit("")))
    return once.join(dots, "file_id").select("file_id", F.col("cue_ord").cast("long").alias("cue_ord"), parts.alias("parts"))
