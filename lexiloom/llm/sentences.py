"""Sentence ends in subtitles of many languages, learnt from the texts themselves."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.arrow_sql import changes, whole_groups
from lexiloom.llm.cues import ORDER, ordered_cues
from lexiloom.llm.lookalike import _settling, capitals
from lexiloom.session import cut

#: Cues of the neighbouring spans that a span also sees.
BEHIND, AHEAD = 40, 4
#: How far, in characters, a quotation may reach.
QUOTE_REACH = 400
#: 99.9 % and 99.5 % points of the chi-squared distribution with one degree of freedom.
SURE, LIKELY = 10.83, 7.88

STOPS = re.compile(r"[.!?…。！？｡।॥;;؟]+")
SINGLE = {code: to for code, to in _settling().items() if to is not None and len(to) == 1}
GONE = {code for code, to in _settling().items() if to is None}
TAG = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
NOTE = re.compile(r"\[[^\[\]\n]*\]|[♪♫#*]+")
OPENERS, CLOSERS = "“„«‹「『\"‚‘", "”“»›」』\"’'）)]】"
OPENS = {"”": "“", "“": "„", "»": "«", "›": "‹", "」": "「", "』": "『", '"': '"', "’": "‘"}
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
TOKEN = re.compile(r"[^\s“”«»„\"()\[\]¿¡—–「」『』{}]+$")
NEXT = re.compile(r"[\ẁ-ͯऀ-ॿ'’-]+(?:\.[\ẁ-ͯ]+)*")
CAPITAL_WORD = re.compile(r"[\ẁ-ͯऀ-ॿ'’-]+")


def aligned(text: str) -> tuple[str, list[int] | None]:
    """``text`` with width forms and spaces settled and invisible characters gone, and where its characters stood."""
    if text.isascii():
        return text, None
    if GONE.isdisjoint(map(ord, text)):
        return text.translate(SINGLE), None
    kept = [i for i, c in enumerate(text) if ord(c) not in GONE]
    return "".join([text[i] for i in kept]).translate(SINGLE), kept


def blanked(match: re.Match[str]) -> str:
    return " " * len(match[0])


def key(token: str) -> str:
    """A token as the statistics count it: look-alikes and case settled, numbers alike."""
    return re.sub(r"\d+", "#", capitals(unicodedata.normalize("NFC", token)))


class Strip:
    """The running text of some neighbouring cues of a file, and the sentence ends in it."""

    def __init__(self, texts: list[str], lang: str | None, ends_file: bool):
        self.lang, self.ends_file = lang, ends_file
        self.texts = texts
        self.maps: list[list[int] | None] = []
        self.starts: list[int] = []
        parts = []
        at = 0
        for text in texts:
            flat, kept = aligned(text)
            flat = flat.replace("\n", " ")
            if "<" in flat or "{" in flat:
                flat = TAG.sub(blanked, flat)
            self.maps.append(kept)
            self.starts.append(at)
            parts.append(flat)
            at += len(flat) + 1
        self.flat = parts
        self.text = "\n".join(parts)
        self.bare = NOTE.sub(blanked, self.text) if re.search(r"[\[♪♫#*]", self.text) else self.text

    def following(self, at: int) -> int:
        """The place of the next character that is no space, tag or note; the text's length if there is none."""
        text = self.bare
        while at < len(text) and text[at] in " \n\t":
            at += 1
        return at

    def opener(self, quote: str, at: int) -> int:
        """Where the quotation that ``quote`` closes at ``at`` opens, or -1."""
        return self.text.rfind(OPENS.get(quote, "“"), max(0, at - QUOTE_REACH), at)

    def inside_quote(self, at: int) -> bool:
        """Whether ``at`` lies in a quotation that closes later."""
        for opens, closes in (("“", "”"), ("„", "“"), ("«", "»"), ("「", "」"), ("『", "』")):
            a = self.text.rfind(opens, max(0, at - QUOTE_REACH), at)
            if a >= 0 and self.text.rfind(closes, a + 1, at) < 0:
                if opens == "“" and self.text.rfind("„", max(0, a - QUOTE_REACH), a) > self.text.rfind("“", max(0, a - QUOTE_REACH), a):
                    continue  # it closes „
                b = self.text.find(closes, at)
                if 0 <= b - at <= QUOTE_REACH and not 0 <= self.text.find(opens, at + 1, b) < b:
                    return True
        return False

    def ends(self) -> Iterator[tuple[int, str, str, str, bool]]:
        """Ends, and periods for the statistics: place after the end, verdict 'yes' or 'ask', token, next word, and
        whether the next word stands in another cue."""
        text, size = self.text, len(self.text)
        for m in STOPS.finditer(text):
            i, j = m.span()
            marks = m[0]
            if ";" in marks or ";" in marks:
                greek = self.lang == "el" or self.lang is None and re.search(r"[Ͱ-Ͽ]", text[max(0, i - 12) : i])
                if not greek and not set(marks) - {";", ";"}:
                    continue
            hard = bool(set(marks) - {".", "…"})
            dots = not hard and (len(marks) > 1 or marks == "…")
            before = text[i - 1] if i else "\n"
            if not hard and before in " \n" and j < size and text[j] not in " \n":
                continue  # the line goes on from one that was broken off
            k = j
            while k < size and text[k] in CLOSERS and not (text[k] in "“\"'’" and k + 1 < size and text[k + 1].isalnum()):
                k += 1
            closers = text[j:k]
            after = text[k] if k < size else "\n"
            if not hard and not dots and after.isalnum():
                continue
            if after in ",;:" and not (hard and CJK.match(after)):
                continue
            unspaced = bool(CJK.search(text[max(0, i - 12) : i + 12]))
            if unspaced and not hard and not dots:
                continue
            n = self.following(k)
            final = n >= size
            nxt = self.bare[n] if n < size else ""
            crossing = "\n" in text[k:n]
            speaker = nxt in "-–" and nxt != "" and n + 1 < size and text[n + 1] == " "
            if any(c in ")）]】" for c in closers):
                a = max(text.rfind("(", max(0, i - 200), i), text.rfind("（", max(0, i - 200), i))
                lead = text[:a].rstrip(" \n")[-1:] if a >= 0 else ""
                if lead and lead not in ".!?…。！？।":
                    continue
            quote = next((c for c in closers if c in OPENS), "")
            if not final and not speaker:
                if quote:
                    a = self.opener(quote, i)
                    lead = self.bare[max(0, a - 60) : a].rstrip(" \n")[-1:] if a >= 0 else ""
                    if nxt in ",;—" or nxt == "–":
                        continue
                    if lead in ",:：，、" and lead:
                        if nxt.islower() and not crossing or unspaced and nxt in "とっ":
                            continue
                    elif nxt.islower() or nxt.isalpha() and not nxt.isupper():
                        continue
                    elif unspaced:
                        continue
                elif self.inside_quote(i):
                    continue
            if hard or final or speaker:
                yield k, "yes", "", "", crossing
                continue
            repeat = crossing and self.repeats(k)
            if dots:
                upper = nxt.isupper() or nxt in OPENERS + "¿¡"
                if upper or repeat:
                    yield k, "yes", "", "", crossing
                elif nxt.isalpha() and not nxt.islower():
                    word = NEXT.match(self.bare, n)
                    yield k, "ask", "…", key(word[0]) if word and not unspaced else "", crossing
                continue
            if quote or repeat or nxt in OPENERS + "¿¡":
                yield k, "yes", "", "", crossing
                continue
            token = TOKEN.search(text, max(0, i - 40), i)
            token = token[0].lstrip(".…-–'’") if token else ""
            if not token:
                yield k, "yes", "", "", crossing
                continue
            word = NEXT.match(self.bare, n)
            cased = nxt.islower() or nxt.isdigit()
            yield k, "ask", key(token), "" if cased or not word else key(word[0]), crossing

    def repeats(self, at: int) -> bool:
        """Whether the cue that ``at`` lies in and the next one with words show the same words."""
        i = next((i for i in range(len(self.starts) - 1, -1, -1) if self.starts[i] < at), 0)
        words = lambda t: CAPITAL_WORD.findall(capitals(TAG.sub("", t)))
        return i + 1 < len(self.flat) and words(self.flat[i]) == words(self.flat[i + 1])

    def at(self, place: int) -> tuple[int, int]:
        """The cue, and the characters of its stored text, up to ``place``."""
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] < place else (lo, mid)
        local, kept = place - self.starts[lo], self.maps[lo]
        return lo, local if kept is None else kept[local - 1] + 1

    def unmarked(self) -> Iterator[int]:
        """Ends in a text that writes no stops: the end of each cue, and of each stretch before a space."""
        for start, flat in zip(self.starts, self.flat, strict=True):
            for m in re.finditer(r"\S+", flat):
                yield start + m.end()

    def counts(self, lo: int, hi: int) -> Counter[tuple[str, bool]]:
        """Capitalised words (any, where letters have no case) of cues lo to hi, after a sure end or elsewhere."""
        out: Counter[tuple[str, bool]] = Counter()
        a, b = self.starts[lo], self.starts[hi] if hi < len(self.starts) else len(self.text)
        for m in CAPITAL_WORD.finditer(self.bare, a, b):
            word = m[0]
            if word[0].islower() or word[0].isdigit() or CJK.match(word):
                continue
            lead = self.bare[max(0, m.start() - 40) : m.start()].rstrip(" \n\t“„«‹「\"'¿¡-–…")
            sure = bool(lead) and (
                lead[-1] in "!?।" or lead[-1] == ";" and self.lang == "el" or lead[-1] == "." and bool(re.search(r"[^\W\d_]{5}\.$", lead)) and "\n" not in lead[-6:]
            )
            out[key(word), sure] += 1
        return out


def neighbourhoods(rows: DataFrame) -> DataFrame:
    """Each span with the last cues of the span before and the first ones of the span after it, as target and core.

    Also has_stop (the file writes 。), and last: whether the span is the file's last one.
    """
    across = Window.partitionBy("file_id").orderBy("span")
    marks = (
        rows.groupBy("file_id", "span")
        .agg(F.max(F.col("text").rlike("[。｡]")).alias("stop"))
        .select(
            "file_id", "span",
            F.lag("span").over(across).alias("earlier"), F.lead("span").over(across).alias("later"),
            F.max("stop").over(Window.partitionBy("file_id")).alias("has_stop"),
        )
    )
    inside = Window.partitionBy("file_id", "span")
    up, down = inside.orderBy(*ORDER), inside.orderBy(*[F.desc(c) for c in ORDER])
    seen = rows.join(marks, ["file_id", "span"]).withColumns({"up": F.row_number().over(up), "down": F.row_number().over(down)})
    targets = F.array_compact(
        F.array(
            F.struct(F.col("span").alias("target"), F.lit(True).alias("core")),
            F.when((F.col("down") <= BEHIND) & F.col("later").isNotNull(), F.struct(F.col("later").alias("target"), F.lit(False).alias("core"))),
            F.when((F.col("up") <= AHEAD) & F.col("earlier").isNotNull(), F.struct(F.col("earlier").alias("target"), F.lit(False).alias("core"))),
        )
    )
    out = seen.withColumn("x", F.explode(targets)).select(
        "file_id", "x.target", "x.core", "span", *ORDER, "text", "lang", "has_stop", F.col("later").isNull().alias("ends"),
    )
    return out.repartition("file_id", "target").sortWithinPartitions("file_id", "target", *ORDER)


def parsed(rows: DataFrame) -> DataFrame:
    """Ends and counts of every span: kind 'end' (cue_id, end_char), 'ask' (also token, follows, and n = 1 where it follows
    in another cue) or 'word' (token, n, n_after)."""
    names = ["kind", "file_id", "cue_id", "end_char", "lang", "token", "follows", "n", "n_after"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def span(table: pa.Table) -> Iterator[tuple]:
        file_id, lang = table["file_id"][0].as_py(), table["lang"][0].as_py()
        core = table["core"].to_pylist()
        lo, hi = core.index(True), len(core) - core[::-1].index(True)
        ids = table["cue_id"].to_pylist()
        last = hi == len(core) and table["ends"][lo].as_py()
        strip = Strip(table["text"].to_pylist(), lang, last)
        found: dict[tuple[int, int], tuple[str, str, str, bool]] = {}
        for place, verdict, token, word, crossing in strip.ends():
            cue, chars = strip.at(place)
            if lo <= cue < hi:
                found[cue, chars] = (verdict, token, word, crossing)
        body = "".join(strip.flat[lo:hi])
        if not table["has_stop"][lo].as_py() and (lang in ("ja", "zh") or lang is None and len(CJK.findall(body)) > len(body) / 3):
            for place in strip.unmarked():
                cue, chars = strip.at(place)
                if lo <= cue < hi:
                    found[cue, chars] = ("yes", "", "", True)
        if last:
            tail = len(strip.flat[hi - 1].rstrip())
            if tail:
                cue, chars = strip.at(strip.starts[hi - 1] + tail)
                found[cue, chars] = ("yes", "", "", True)
        for (cue, chars), (verdict, token, word, crossing) in found.items():
            yield "end" if verdict == "yes" else "ask", file_id, ids[cue], chars, lang, token, word, int(crossing), None
        total: Counter[str] = Counter()
        sure: Counter[str] = Counter()
        for (word, after), n in strip.counts(lo, hi).items():
            total[word] += n
            sure[word] += n * after
        for word, n in total.items():
            yield "word", None, None, None, lang, word, None, n, sure[word]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["file_id", "target"]):
            edge = [*changes(table, ["file_id", "target"]).tolist(), table.num_rows]
            found = [row for i, j in zip(edge, edge[1:]) for row in span(table.slice(i, j - i))]
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return neighbourhoods(rows).mapInArrow(
        run,
        "kind string, file_id bigint, cue_id bigint, end_char bigint, lang string, token string, follows string,"
        " n bigint, n_after bigint",
    )


def likelihood_ratio(k: Column, n: Column, p: Column) -> Column:
    """Dunning's -2 log of the likelihood ratio of k successes in n trials against the rate p."""

    def log_likelihood(rate: Column) -> Column:
        rate = F.greatest(F.least(rate, F.lit(1 - 1e-9)), F.lit(1e-9))
        return k * F.log(rate) + (n - k) * F.log(1 - rate)

    return 2 * (log_likelihood(k / n) - log_likelihood(p))


def models(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentence starters (lang, follows), abbreviations (lang, token) and collocations (lang, token, follows).

    All are learnt per language by log-likelihood ratios over all texts; '' stands for texts of unknown language, which
    are judged by what holds over all languages. A starter follows sure ends far more often than other capitalised words
    do. An abbreviation's period is followed by what starts no sentence far more often than the periods of other words
    are. A collocation's second word follows the first one's period far more often than it follows other periods, and
    starts no sentence.
    """
    known = F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit("")))).alias("lang")
    words = found.where("kind = 'word'").select(known, "token", "n", "n_after")
    words = words.groupBy("lang", "token").agg(F.sum("n").alias("n"), F.sum("n_after").alias("k"))
    base = words.groupBy("lang").agg((F.sum("k") / F.sum("n")).alias("p"))
    starters = (
        words.where("k >= 2").join(base, "lang")
        .where((F.col("k") / F.col("n") > F.col("p")) & ((likelihood_ratio(F.col("k"), F.col("n"), F.col("p")) > LIKELY) | (F.col("k") >= 0.5 * F.col("n"))))
        .select("lang", F.col("token").alias("follows"))
    )
    asked = found.where("kind = 'ask' and token <> '…'").select(known, "token", "follows", "n")
    pairs = asked.groupBy("lang", "token", "follows").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("crossing"))
    # What opens a cue nearly always when it follows a period isn't the rest of what the period stands in.
    opening = pairs.where("follows <> ''").groupBy("lang", "follows").agg(F.sum("crossing").alias("k"), F.sum("c").alias("n"))
    opening = opening.where((F.col("n") >= 4) & (F.col("k") >= 0.9 * F.col("n"))).select("lang", "follows")
    starters = starters.unionAll(opening).distinct()
    pairs = pairs.join(starters.withColumn("starts", F.lit(1)), ["lang", "follows"], "left")
    tokens = pairs.groupBy("lang", "token").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("starts").isNull(), F.col("c")).otherwise(0)).alias("k")
    )
    # The rate of periods that no starter follows, among long words without inner periods or digits.
    rate = (
        tokens.where(r"length(token) >= 5 and not token rlike '[.#]'").groupBy("lang")
        .agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("p"))
    )
    judged = tokens.join(rate, "lang", "left").withColumn("p", F.coalesce("p", F.lit(0.1)))
    abbreviations = judged.where(
        (F.col("k") >= 3) & (F.col("k") / F.col("n") > 2 * F.col("p")) & (F.col("k") >= 0.15 * F.col("n"))
        & (likelihood_ratio(F.col("k"), F.col("n"), F.col("p")) > F.when(F.length("token") <= 4, LIKELY).otherwise(SURE))
    ).select("lang", "token")
    follow = pairs.groupBy("lang", "follows").agg(F.sum("c").alias("m"))
    whole = pairs.groupBy("lang").agg(F.sum("c").alias("total"))
    joint = pairs.where("starts is null and follows <> '' and c >= 3").join(tokens, ["lang", "token"]).join(follow, ["lang", "follows"]).join(whole, "lang")
    collocations = joint.where(
        (F.col("c") / F.col("n") > F.col("m") / F.col("total"))
        & (likelihood_ratio(F.col("c"), F.col("n"), F.col("m") / F.col("total")) > LIKELY)
        & ((F.length("token") <= 4) | F.col("token").contains("#"))
    ).select("lang", "token", "follows")
    return starters, abbreviations, collocations


def sentence_ends(cues: DataFrame, files: DataFrame, tracks: tuple[str, ...] = ("sub",)) -> DataFrame:
    """The end of every sentence: file_id, cue_id (of the cue in which it ends), end_char.

    end_char counts the code points of the stored text up to the end, closing marks and quotes included. Marks that
    can't be anything else end a sentence unless a quotation's report goes on; a period is judged by the models; an
    ellipsis ends a sentence if a new one begins. The last cue of a file ends one. In Japanese and Chinese files that
    write no 。 the end of a cue or a space ends one.

    Cues without start or with a blank text are left out, repeated deliveries count once, cues that start at once are
    in the order as written. An empty table gives no rows. A file is parsed by spans of time that see the nearest cues
    of their neighbours, so that no task holds a whole file; the models are joined, not collected.
    """
    rows = cut(ordered_cues(cues, files, list(tracks)))
    found = cut(parsed(rows))
    starters, abbreviations, collocations = models(found)
    asked = found.where("kind = 'ask'").withColumn("lang", F.coalesce("lang", F.lit("")))
    judged = (
        asked.join(starters.withColumn("starts", F.lit(True)), ["lang", "follows"], "left")
        .join(abbreviations.withColumn("short", F.lit(True)), ["lang", "token"], "left")
        .join(collocations.withColumn("bound", F.lit(True)), ["lang", "token", "follows"], "left")
    )
    starts, short, bound = (F.coalesce(F.col(c), F.lit(False)) for c in ("starts", "short", "bound"))
    yes = F.when(F.col("token") == "…", starts).otherwise((~short & ~bound) | starts)
    ends = found.where("kind = 'end'").select("file_id", "cue_id", "end_char")
    return ends.unionAll(judged.where(yes).select("file_id", "cue_id", "end_char"))
