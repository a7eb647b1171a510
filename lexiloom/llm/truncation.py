"""Documents whose text was cut short, and the hidden length limits of their sources."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.arrow_sql import spread
from lexiloom.llm.sentences import LIKELY, likelihood_ratio
from lexiloom.session import cut

#: A limit shows as a heap of lengths in EDGE values up to it that is STEEP times as dense as the BESIDE values before,
#: by a likelihood ratio of SURE_HEAP at least.
EDGE, BESIDE, STEEP, SURE_HEAP = 8, 64, 5, 25.0
#: A heap is at one length, or at the last NARROW ones where characters of several bytes meet the limit, if such a share
#: of it stands there; else texts were cut between words, which reaches down WIDE lengths.
SHARP, NARROW, WIDE = 0.9, 3, 16
#: Characters at a text's end that hold any mark of an end.
REACH = 200
#: Below this share of texts that end with a stop, a source is taken to write none.
STOPLESS = 0.3
#: A last line is known from the texts of its language if so many of them, and such a share, end with it; one that has
#: the shape of a label needs less.
LEAST, SHARE = 3, 0.001
LABEL_LEAST, LABEL_SHARE = 2, 0.0001
#: A word of so many letters isn't an abbreviation that only a limit shows.
WORD_LETTERS = 5

CLOSERS = "”“\"»›」』)）]】’'"
STOP = re.compile(rf"[.!?…。！？｡।;][{re.escape(CLOSERS)}]*$")
#: In scripts without spaces a point stands in numbers only.
CJK_STOP = re.compile(rf"[!?…。！？｡][{re.escape(CLOSERS)}]*$")
DOT = re.compile(rf"\.[{re.escape(CLOSERS)}]*$")
#: A character, entity, tag or escape of which only the beginning arrived.
BROKEN = re.compile(r"(?:�+|&#?\w{0,8}|</?\w*|\\(?:u[0-9a-fA-F]{0,3})?)$")
#: What is put where a text was cut.
BRACKET = re.compile(r"\s+[\[(<]\s*[^\s\])>][^\])>]{0,14}[\])>]$")
ELLIPSIS = re.compile(r"\s?(?:…|\.\.+)$")
LABEL = re.compile(r"^(?:[-–—•*·]\s*\S|[^.!?。]{1,30}[:：]\s*\S|\w[\w ]{0,20}\d+$)")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
QUOTED = re.compile(r"[“„«‹「『\"][^”“»›」』\"]*[”“»›」』\"]")
PAIRS = (("“", "”"), ("„", "“"), ("«", "»"), ("「", "」"), ("『", "』"), ("(", ")"), ("（", "）"), ("‹", "›"))
DOTTED, DIGITS, ALNUM = re.compile(r"\S*\.\S*"), re.compile(r"\d+"), re.compile(r"[^\W_]")
EDGES, BEFORE = "“”„«»\"'()[]¿¡—", "“”„«»\"'("


#: What a store may count as the length of a text, in the order of ``lengths``.
ENCODINGS = (
    "characters", "utf-8 bytes", "utf-16 units", "characters, crlf", "utf-8 bytes, crlf", "characters, entities",
    "utf-8 bytes, entities", "characters, json", "utf-8 bytes, json", "characters, ascii json",
)


def lengths(text: str) -> list[int]:
    """The lengths of ``text`` under ``ENCODINGS``."""
    chars = len(text)
    lines, quotes = text.count("\n"), text.count('"')
    entities = 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * quotes + 4 * text.count("'")
    escapes = quotes + lines + text.count("\\") + text.count("\t") + text.count("\r")
    octets, units, wide = chars, chars, 0
    if not text.isascii():
        octets, units = len(text.encode("utf-8", "surrogatepass")), len(text.encode("utf-16-le", "surrogatepass")) // 2
        wide = units - len(text.encode("ascii", "ignore"))
    return [
        chars, octets, units, chars + lines, octets + lines, chars + entities, octets + entities, chars + escapes,
        octets + escapes, units + escapes + 5 * wide,
    ]


def measured(documents: DataFrame) -> DataFrame:
    """source and lengths of every text that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lengths(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["source"], pa.array(found, pa.list_(pa.int64()))], names=["source", "lengths"])

    return spread(documents.select("source", "text").where("text <> ''")).mapInArrow(run, "source string, lengths array<bigint>")


def hidden_limits(documents: DataFrame) -> DataFrame:
    """The limits that show in the lengths of each source: source, encoding, length, width, n_at, n_above, n_documents.

    Every length is recomputed under each encoding; per source and encoding the lengths are counted, so that only
    counts of distinct lengths are gathered per source. A limit is where lengths heap up; a text that stands on heaps of
    several encodings counts for the sharpest, and a source has as many limits as heaps that are heaps by texts of their
    own. ``width`` says how far below the limit texts stand that it cut. A source without a heap has no row; texts that
    are null or empty are left out, a null source counts as one.
    """
    return limits_of(measured(documents))


def heap_ratio(at: Column, beside: Column) -> Column:
    """-2 log of the likelihood ratio of one density in the EDGE and the BESIDE lengths against two."""
    pooled = (at + beside) / F.lit(float(EDGE + BESIDE))
    part = lambda n, width: F.when(n > 0, n * F.log(n / (F.lit(float(width)) * pooled))).otherwise(0.0)
    return 2 * (part(at, EDGE) + part(beside, BESIDE))


def is_heap(at: Column, beside: Column) -> Column:
    return (at >= STEEP * (beside * (EDGE / BESIDE) + 1)) & (heap_ratio(at, beside) > SURE_HEAP)


def limits_of(rows: DataFrame) -> DataFrame:
    """The limits that show in ``lengths`` of rows with a source (see ``hidden_limits``)."""
    each = rows.select("source", F.posexplode("lengths").alias("at", "length"))
    counted = each.groupBy("source", "at", "length").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("source", "at").orderBy("length")
    near = counted.select(
        "*",
        F.sum("n").over(ordered.rangeBetween(-EDGE + 1, 0)).alias("n_at"),
        F.sum("n").over(ordered.rangeBetween(-NARROW + 1, 0)).alias("n_near"),
        F.coalesce(F.sum("n").over(ordered.rangeBetween(-EDGE - BESIDE + 1, -EDGE)), F.lit(0)).alias("n_beside"),
        F.sum("n").over(ordered.rangeBetween(Window.unboundedPreceding, 0)).alias("n_upto"),
        F.sum("n").over(Window.partitionBy("source", "at")).alias("n_documents"),
    ).withColumn("n_above", F.col("n_documents") - F.col("n_upto"))
    # The limit is the last dense length: one beyond it has as dense a stretch before it, but few texts itself.
    dense = F.col("n") * (2 * EDGE) >= F.col("n_at")
    heaps = near.where(dense & is_heap(F.col("n_at"), F.col("n_beside")) & (F.col("n_above") <= 2 * F.col("n_at")))
    # A text counts for the first of the heaps it stands on, from the densest down.
    width = F.when(F.col("n") >= SHARP * F.col("n_at"), 0).when(F.col("n_near") >= SHARP * F.col("n_at"), NARROW - 1).otherwise(WIDE)
    place = F.struct((-F.col("n_at")).alias("a"), (-F.col("n")).alias("b"), F.col("at").alias("e"), (-F.col("length")).alias("c"))
    listed = heaps.withColumns({"place": place, "width": width}).groupBy(F.col("source").alias("s")).agg(
        F.array_sort(F.collect_list(F.struct("place", "at", "length", "width", "n_beside", "n_above", "n_documents"))).alias("heaps")
    )
    on = rows.select("source", "lengths").join(listed, F.col("source").eqNullSafe(F.col("s")))
    stands = lambda h: F.get("lengths", h["at"]).between(h["length"] - EDGE + 1, h["length"])
    first = F.get(F.filter("heaps", stands), 0)
    own = on.select("source", first.alias("h")).where("h is not null").groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_at"))
    names = F.array(*[F.lit(n) for n in ENCODINGS])
    return own.where(is_heap(F.col("n_at"), F.col("h.n_beside"))).select(
        "source", F.get(names, F.col("h.at")).alias("encoding"), "h.length", "h.width", "n_at", "h.n_above", "h.n_documents"
    )


def bare_quotation(line: str) -> bool:
    """Whether ``line`` ends with a quotation that nothing leads to, so that the words reporting it are missing."""
    for a, b in PAIRS[:5]:
        if line.endswith(b):
            i = line.rfind(a)
            return i >= 0 and not line[:i].rstrip().endswith((",", ":", "：", "，")) and (i == 0 or line[:i].rstrip()[-1:] in ".!?…。！？" or b == "」")
    return False


def masked(word: str) -> str:
    low = word.lower()
    return low if low.isalpha() else DIGITS.sub("#", low)


def unbalanced(line: str) -> bool:
    """Whether a quotation or bracket of ``line`` is still open at its end."""
    for a, b in PAIRS:
        i = line.rfind(a)
        if i >= 0 and line.rfind(b) < i and not (a == "“" and line.rfind("„", 0, i) >= 0):
            return True
    return line.count('"') % 2 == 1


def periods(lines: list[str]) -> Iterator[tuple[str, str, bool]]:
    """(word before, token, whether it may end a sentence) of each period but the one at the text's end."""
    for at, line in enumerate(lines):
        for m in DOTTED.finditer(line):
            core = m[0].strip(EDGES)
            p = core.find(".")
            if p < 0:
                continue
            before = line[: m.start()].split()[-1:] if m.start() else []
            word = masked(before[0].strip(BEFORE)) if before else ""
            while 0 <= p < len(core) - 1:
                if core[p + 1] != ".":
                    yield word, masked(core[: p + 1]), False
                p = core.find(".", p + 1)
            if core.endswith(".") and not core.endswith(".."):
                following = ALNUM.search(line, m.end())
                if following:
                    yield word, masked(core), not (following[0].islower() or following[0].isdigit())
                elif at < len(lines) - 1:
                    yield word, masked(core), True


def grams(words: list[str], end: int) -> tuple[str, str, str, str]:
    """The last four, three, two and one words up to ``end``."""
    part = words[max(0, end - 4) : end]
    return " ".join(part), " ".join(part[-3:]), " ".join(part[-2:]), " ".join(part[-1:])


def last_line(line: str) -> str:
    """What stands for a last line when equal ones are counted: itself, or the hash of a long one."""
    line = masked(line)
    return line if len(line) <= 80 else md5(line.encode("utf-8", "surrogatepass")).hexdigest()


def ending_of(body: str, lines: list[str], cjk: bool) -> tuple[str, list[str]]:
    """How a text ends, and the words before a period, ellipsis or mark at its end."""
    last, final = lines[-1].strip(), body[-REACH:]
    stops = CJK_STOP if cjk else STOP
    if BROKEN.search(final):
        return "broken", []
    if ELLIPSIS.search(final) or BRACKET.search(final):
        # Patterns that are tied to the end need no more of a text than their longest match.
        rest = (body[:-REACH] + BRACKET.sub("", ELLIPSIS.sub("", final))).rstrip()
        tail, before = rest.split("\n")[-1].split(), rest[-REACH:]
        if stops.search(before) and not ELLIPSIS.search(before):
            return ("dot" if DOT.search(before) and not cjk else "stop"), tail
        if tail:
            tail[-1] += "."
        return ("ellipsis" if ELLIPSIS.search(final) else "bracket"), tail
    if stops.search(final):
        if unbalanced(last):
            return "open", last.split()
        if bare_quotation(last):
            return "quote", last.split()
        return ("dot" if DOT.search(final) and not cjk else "stop"), last.split()
    return ("open" if unbalanced(last) else "none"), []


def features(documents: DataFrame) -> DataFrame:
    """One row for each text with how it ends (kind 'text') and counts over all texts (kinds 'dot', 'token' and 'gram').

    Counts, by language and key: periods by their token, and by the word before and the token (a: inside a sentence, b:
    where it may end one), and word groups in texts that write no stops (a: inside a line, b: at its end). The end of a
    text isn't counted here, for it may be where it was cut. Batches are counted before they are shuffled.
    """
    names = ["kind", "doc_id", "source", "lang", "ending", "dot", "token", "grams", "line", "label", "key", "a", "b", "lengths"]
    text = pa.string()
    kinds = [text, pa.int64(), *[text] * 5, pa.list_(text), text, pa.bool_(), text, pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            counts: dict[tuple, list[int]] = {}
            for number, source, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = text.rstrip()
                if not body:
                    continue
                lines = body.split("\n")
                cjk = bool(CJK.search(body[-12:]))
                if not cjk:
                    for before, token, may_end in periods(lines):
                        counts.setdefault(("token", lang, token), [0, 0])[may_end] += 1
                        counts.setdefault(("dot", lang, f"{before} {token}"), [0, 0])[may_end] += 1
                    if sum(1 for x in lines if STOP.search(x.rstrip()[-REACH:])) < STOPLESS * len(lines):
                        for at, line in enumerate(lines):
                            w = masked(QUOTED.sub("Q", line)).split()
                            for end in range(1, len(w) + (at < len(lines) - 1)):
                                for g in set(grams(w, end)):
                                    counts.setdefault(("gram", lang, g), [0, 0])[end == len(w)] += 1
                ending, tail = ending_of(body, lines, cjk)
                token = masked(tail[-1].strip(EDGES)) if tail else None
                dot = f"{masked(tail[-2].strip(BEFORE)) if len(tail) > 1 else ''} {token}" if tail else None
                last, groups = lines[-1].strip(), None
                if ending == "none":
                    w = masked(QUOTED.sub("Q", last)).split()
                    groups = list(grams(w, len(w)))
                shaped = len(lines) > 1 and bool(LABEL.search(last))
                found.append(("text", number, source, lang, ending, dot, token, groups, last_line(last), shaped, None, None, None, lengths(text)))
            found += [(kind, None, None, lang, *[None] * 6, key, *n, None) for (kind, lang, key), n in counts.items()]
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return spread(texts).mapInArrow(
        run,
        "kind string, doc_id bigint, source string, lang string, ending string, dot string, token string,"
        " grams array<string>, line string, label boolean, key string, a bigint, b bigint, lengths array<bigint>",
    )


def at_limits(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """``texts`` with at_limit: whether a text's length stands at one of its source's ``limits``."""
    number = F.array_position(F.array(*[F.lit(n) for n in ENCODINGS]), F.col("encoding")).cast("int") - 1
    by_source = limits.groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct(number.alias("e"), "length", "width")).alias("limits"))
    met = F.exists("limits", lambda x: F.get("lengths", x["e"]).between(x["length"] - x["width"], x["length"]))
    return texts.join(by_source, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("at_limit", F.coalesce(met, F.lit(False))).drop("s", "limits")


def evidence(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """What all texts say about a key (kind, l, key): counts a, b and c.

    Kinds: 'token' and 'dot' (c: at the ends of texts), 'gram', 'line' (c: texts that end with the line), 'ways' (word
    groups before three last words, inside lines and at their ends) and 'prefix' (a: known words that a beginning of
    more letters than it has goes on to). Ends of texts that stand at a limit aren't ends, and don't count.
    """
    lang = F.coalesce(F.col("lang"), F.lit("")).alias("l")
    ends = texts.where("not at_limit")
    at_end = ends.where("ending = 'dot'").select(F.explode(F.array(F.struct(F.lit("token").alias("kind"), F.col("token").alias("key")), F.struct(F.lit("dot").alias("kind"), F.col("dot").alias("key")))).alias("x"), "l")
    # Every text counts for its language and for the texts without one.
    pooled = ends.where("ending = 'none'").select(F.lit("line").alias("kind"), F.explode(F.array_distinct(F.array("l", F.lit("")))).alias("l"), F.col("line").alias("key"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    counted = (
        rows.where("kind <> 'text'").select("kind", lang, "key", "a", "b", zero.alias("c"))
        .unionAll(at_end.select("x.kind", "l", "x.key", zero, zero, one)).unionAll(pooled.select("kind", "l", "key", zero, zero, one))
        .groupBy("kind", "l", "key").agg(*[F.sum(x).alias(x) for x in "abc"])
    )
    counted = cut(counted)
    grams_of = counted.where("kind = 'gram'")
    four = grams_of.where("size(split(key, ' ')) = 4")
    ways = four.groupBy("l", F.substring_index("key", " ", -3).alias("key")).agg(F.count_if(F.col("a") > 0).alias("a"), F.count_if(F.col("b") > 0).alias("b"))
    words = grams_of.where("not key like '% %' and length(key) > 3").where(F.col("key").rlike(r"^\p{L}+$")).select("l", "key")
    begun = words.select("l", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    prefixes = begun.groupBy("l", "key").agg(F.count(F.lit(1)).alias("a"))
    return counted.unionAll(ways.select(F.lit("ways"), "l", "key", "a", "b", zero)).unionAll(prefixes.select(F.lit("prefix"), "l", "key", "a", zero, zero))


def judged_documents(documents: DataFrame) -> DataFrame:
    """Each document with text and whether it was cut: doc_id, source, lang, ending, at_limit, cut.

    ``ending`` says what the text ends with: broken (half a character, entity, tag or escape), bracket or ellipsis (a
    mark where no stop is), open (an open quotation or bracket), quote (a quotation without report), dot or stop, none.

    The hidden limits decide in two ways. A text at its source's limit is cut unless its end is certain: a mark that
    only ends sentences, a period after a word or after what ends sentences elsewhere, a last line that many documents
    have, or, where the source writes no stops, words that mostly end lines. And what ends texts at a limit is no
    evidence for ends, so that all statistics are learnt from the others.

    Below a limit broken, open and bracketed ends are cuts. A period is one if it hardly ever ends a sentence after its
    word or token. A text without a stop is cut unless its last line is one that many documents have (a label, a list, a
    sign-off) or its source writes no stops and its last words end lines elsewhere. How many have a line is counted per
    language, and over all languages for a text without one; the shape of a label lowers the share that is asked for,
    and never replaces it. An ellipsis is a cut after words that end no sentences.

    Texts that are null or blank have no row and are no case; repeated texts are judged alike; a null source or
    language is one of its own. Statistics cover all documents, and are joined, never collected.
    """
    rows = cut(features(documents))
    return judged(rows, cut(limits_of(rows.where("kind = 'text'"))))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The verdicts (see ``judged_documents``) for rows of ``features`` and the ``limits`` of their sources."""
    texts = at_limits(rows.where("kind = 'text'").drop("kind", "key", "a", "b"), limits)
    texts = cut(texts.drop("lengths").withColumns({"l": F.coalesce(F.col("lang"), F.lit("")), "row": F.monotonically_increasing_id()}))
    known = evidence(rows, texts)

    by_source = texts.groupBy(F.col("source").alias("s")).agg(
        ((F.count_if(F.col("ending").isin("stop", "dot", "quote")) < STOPLESS * F.count(F.lit(1))) & (F.count(F.lit(1)) >= 10)).alias("stopless")
    )
    by_lang = texts.select(F.explode(F.array_distinct(F.array("l", F.lit("")))).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n_lang"))
    rate = known.where("kind = 'dot'").groupBy("l").agg((F.sum("c") / F.greatest(F.sum("b") + F.sum("c"), F.lit(1))).alias("p"))

    def ask(slot: str, kind: str, key: Column) -> Column:
        return F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), key.alias("key"))

    group = lambda i: F.get("grams", F.lit(i))
    asks = F.when(F.col("ending").isin("dot", "ellipsis"), F.array(ask("dot", "dot", F.col("dot")), ask("token", "token", F.col("token")))).when(
        F.col("ending") == "none",
        F.array(ask("line", "line", F.col("line")), ask("ways", "ways", group(1)), ask("part", "prefix", group(3)), *[ask(f"g{4 - i}", "gram", group(i)) for i in range(4)]),
    )
    asked = texts.where("ending in ('dot', 'ellipsis', 'none')").select("row", "l", F.explode(asks).alias("x")).select("row", "l", "x.*")
    met = asked.join(known, ["kind", "l", "key"])
    slots = ["dot", "token", "line", "ways", "part", "g4", "g3", "g2", "g1"]
    pick = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c))).alias(f"{slot}_{c}")
    seen = met.groupBy("row").agg(*[pick(s, c) for s in slots for c in "abc"])
    full = texts.join(seen, "row", "left").join(by_source, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(by_lang, "l", "left").join(rate, "l", "left")

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a, b, c = (zero(f"dot_{x}") for x in "abc")
    n, tn, tc, p = a + b + c, zero("token_a") + zero("token_b") + zero("token_c"), zero("token_c"), F.coalesce(F.col("p"), F.lit(0.1))
    # Ends of texts are rare after what doesn't end a sentence, be it the token or the token after its word.
    seldom = (tn >= 20) & (likelihood_ratio(tc, F.greatest(tn, F.lit(1)), p) > LIKELY) & (tc / tn < p / 3)
    seldom_here = (n >= 20) & (c / n < p / 3) & (likelihood_ratio(c, F.greatest(n, F.lit(1)), p) > LIKELY)
    inside = (a >= 2) & (a > 3 * (b + c - 1))
    ends_elsewhere = (b >= 1) & ~seldom_here & ~inside
    dot_cut = F.coalesce(inside | seldom_here | (seldom & ~ends_elsewhere), F.lit(False))
    worded = F.col("token").rlike(rf"^\p{{L}}{{{WORD_LETTERS},}}\.$|\p{{L}}[{re.escape(CLOSERS)}]\.$")
    certain_dot = ~dot_cut & (worded | (b + c >= 1) | (zero("token_b") + tc >= 2))

    rates = [F.when(zero(f"{k}_a") + zero(f"{k}_b") >= (1 if k == "g4" else 2), zero(f"{k}_b") / (zero(f"{k}_a") + zero(f"{k}_b"))) for k in ("g4", "g3", "g2")]
    # After a word group never seen: what may precede the last three words at line ends is more varied than inside.
    rates.insert(1, F.when(zero("ways_b") > zero("ways_a"), F.lit(1.0)))
    alone = zero("g1_a") + zero("g1_b")
    rarely = (alone >= 5) & (zero("g1_b") < 0.15 * alone)
    fragment = (zero("part_a") > 0) & (zero("g1_b") == 0)
    ends_line = F.coalesce(F.coalesce(*rates) >= 0.3, ~(rarely | fragment))
    least = F.when(F.col("label"), F.greatest(F.lit(LABEL_LEAST), LABEL_SHARE * F.col("n_lang"))).otherwise(F.greatest(F.lit(LEAST), SHARE * F.col("n_lang")))
    label = zero("line_c") >= least
    stopless = F.coalesce(F.col("stopless"), F.lit(False))
    ending = F.col("ending")
    at_limit = (
        F.when(ending == "stop", False).when(ending == "dot", ~certain_dot)
        .when(ending == "none", ~label & ~(stopless & F.coalesce(F.coalesce(*rates) >= 0.5, F.lit(False)))).otherwise(True)
    )
    below = (
        F.when(ending.isin("broken", "bracket", "open"), True).when(ending.isin("stop", "quote"), False).when(ending == "dot", dot_cut)
        .when(ending == "ellipsis", (b + c < 2) | dot_cut).when(stopless, ~(ends_line | label)).otherwise(~label)
    )
    return full.select("doc_id", "source", "lang", "ending", "at_limit", F.when(F.col("at_limit"), at_limit).otherwise(below).alias("cut"))


def cut_documents(documents: DataFrame) -> DataFrame:
    """doc_id of each document whose text was cut within a word or a sentence (see ``judged_documents``)."""
    return judged_documents(documents).where("cut").select("doc_id")


def cut_shares(documents: DataFrame) -> DataFrame:
    """Per source: documents with text, those cut, their share, and the most used hidden limit, if any.

    Texts are read and measured once: limits and verdicts both come from the written features.
    """
    rows = cut(features(documents))
    limits = cut(limits_of(rows.where("kind = 'text'")))
    share = judged(rows, limits).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("cut").alias("n_cut"),
        F.count_if(F.col("cut") & F.col("at_limit")).alias("n_cut_at_limit"),
    )
    top = limits.groupBy(F.col("source").alias("s")).agg(F.max_by(F.struct("encoding", "length"), F.struct("n_at", "length")).alias("x"), F.count(F.lit(1)).alias("n_limits"))
    joined = share.join(top.select("s", "x.encoding", F.col("x.length").alias("limit_length"), "n_limits"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return joined.withColumn("cut_share", F.col("n_cut") / F.col("n_documents"))
