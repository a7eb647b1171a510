"""Selecting documents so that sources reach target shares of all tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.tokens import RANKS, with_tokens
from lexiloom.operators.sequence import ordered_scan
from lexiloom.session import cut

#: Cells of source, language and topic that are raked in the driver's memory; more are raked as a table.
DRIVER_CELLS = 1_000_000
#: How far the default targets of languages and topics even out the sources' own make-up: 1 keeps it, 0 levels it.
TEMPER = 0.5
#: Rounds of raking at most, and how near all marginals have to come.
ROUNDS, CLOSE = 500, 1e-6
#: Starting points tried for each source's systematic sample.
STARTS = 64
AXES = ("source", "lang", "topic")


def rake(
    mass: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], most: np.ndarray | None = None, rounds: int = ROUNDS, close: float = CLOSE
) -> np.ndarray:
    """Iterative proportional fitting: cell shares nearest to ``mass`` whose sums along each axis meet its targets.

    ``axes`` give each cell's category on each axis. No share exceeds ``most``: a cell that reaches it stays there and
    the others of its categories make up for it. The first axis is fitted last in each round; the rounds end when all
    marginals are met.
    """
    share = mass / mass.sum()
    for _ in range(rounds):
        off = 0.0
        for axis, target in reversed(list(zip(axes, targets, strict=True))):
            sums = np.bincount(axis, share, len(target))
            off = max(off, float(np.abs(sums - target).max()))
            factor = np.divide(target, sums, out=np.zeros_like(target), where=sums > 0)
            share = share * factor[axis]
            if most is not None:
                share = np.minimum(share, most)
        if off < close:
            break
    return share


def rake_table(cells: DataFrame, targets: list[DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """``rake`` over a table of cells (source, lang, topic, mass, most) of any length, with ``share`` added.

    Each step sums the shares along one axis, which is partly done before the shuffle, and joins the factors back; each
    round's cells are written to the checkpoint folder.
    """
    total = cells.agg(F.sum("mass")).first()[0]
    at = cut(cells.withColumn("share", F.col("mass") / F.lit(total)))
    for _ in range(rounds):
        off = 0.0
        for axis, target in reversed(list(zip(AXES, targets, strict=True))):
            sums = cut(at.groupBy(axis).agg(F.sum("share").alias("sum")).join(target, axis))
            off = max(off, sums.agg(F.max(F.abs(F.col("sum") - F.col("target")))).first()[0] or 0.0)
            factor = sums.select(axis, F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("factor"))
            at = at.join(factor, axis).withColumn("share", F.least(F.col("share") * F.col("factor"), F.col("most"))).drop("factor")
        at = cut(at)
        if off < close:
            break
    return at


def tempered(cells: pd.DataFrame, temper: float) -> np.ndarray:
    """Cell shares of an evened-out make-up: in each source its languages, and in each of these its topics, have shares
    as their tokens to the power ``temper``; the sources' shares (``goal``) stay, and so does what has no language or
    topic. Its marginals can be met together, as far as no cell reaches its source's repeats."""

    def levelled(rows: pd.DataFrame, within: list[str], axis: str) -> pd.Series:
        keys = [rows[k] for k in within]
        own = rows["mass"] / rows["mass"].groupby(keys).transform("sum")
        raised = (rows["mass"] ** temper).where(rows[axis] != "", 0.0)
        unknown = own.where(rows[axis] == "", 0.0).groupby(keys).transform("sum")
        every = raised.groupby(keys).transform("sum")
        return own.where(rows[axis] == "", (1 - unknown) * raised / every.where(every > 0, 1.0))

    of_lang = cells.groupby(["source", "lang"], as_index=False)["mass"].sum()
    of_lang["lang_share"] = levelled(of_lang, ["source"], "lang")
    lang_share = cells.merge(of_lang[["source", "lang", "lang_share"]], on=["source", "lang"], how="left")["lang_share"].to_numpy()
    return cells["goal"].to_numpy() * lang_share * levelled(cells, ["source", "lang"], "topic").to_numpy()


def tempered_table(cells: DataFrame, temper: float) -> DataFrame:
    """``tempered`` for a table: ``cells`` with ``want``."""

    def levelled(rows: DataFrame, within: list[str], axis: str, name: str) -> DataFrame:
        blank, raised = F.col(axis) == "", F.pow("mass", F.lit(temper))
        per = rows.groupBy(*within).agg(
            F.sum("mass").alias("_all"), F.sum(F.when(blank, F.col("mass")).otherwise(0.0)).alias("_blank"), F.sum(F.when(blank, 0.0).otherwise(raised)).alias("_raised")
        )
        share = F.when(blank, F.col("mass") / F.col("_all")).otherwise((1 - F.col("_blank") / F.col("_all")) * raised / F.col("_raised"))
        return rows.join(per, within).withColumn(name, share).drop("_all", "_blank", "_raised")

    of_lang = levelled(cells.groupBy("source", "lang").agg(F.sum("mass").alias("mass")), ["source"], "lang", "_lang").drop("mass")
    each = levelled(cells, ["source", "lang"], "topic", "_topic").join(of_lang, ["source", "lang"])
    return each.withColumn("want", F.col("goal") * F.col("_lang") * F.col("_topic")).drop("_lang", "_topic")


def planned(
    cells: DataFrame, given: dict[str, dict[str, float]], temper: float, driver_cells: int, scaling_only: bool
) -> tuple[DataFrame, DataFrame, float]:
    """Expected copies of the cells (source, lang, topic, expected, repeats), targets (axis, category, target) and the
    total of tokens, from ``cells`` (source, lang, topic, mass, weight, repeats). Both ways of raking give the same."""
    session = cells.sparkSession
    few = cells.limit(driver_cells + 1).toPandas()
    if len(few) > driver_cells:
        return planned_table(cells, given, temper, scaling_only)
    schema = "source string, lang string, topic string, expected double, repeats double"
    if few.empty:
        return session.createDataFrame([], schema), session.createDataFrame([], "axis string, category string, target double"), 0.0
    few = few.sort_values(list(AXES), ignore_index=True)
    sources = few.groupby("source").agg(whole=("mass", "sum"), weight=("weight", "first"), repeats=("repeats", "first"))
    sources["goal"] = sources["weight"] / sources["weight"].sum()
    total = float((sources["whole"] * sources["repeats"] / sources["goal"]).min())
    few["goal"], few["whole"] = few["source"].map(sources["goal"]), few["source"].map(sources["whole"])
    want = few["goal"] * few["mass"] / few["whole"] if scaling_only else tempered(few, temper)
    axes, wanted, targets = [], [], []
    for axis in AXES:
        kinds, at = np.unique(few[axis], return_inverse=True)
        target = np.bincount(at, want, len(kinds))
        if axis in given:
            target = np.array([given[axis].get(k, 0.0) for k in kinds.tolist()])
            target = target / target.sum()
        axes.append(at)
        wanted.append(target)
        targets += [(axis, k, float(x)) for k, x in zip(kinds.tolist(), target, strict=True)]
    mass, repeats = few["mass"].to_numpy(), few["repeats"].to_numpy()
    share = np.asarray(want) if scaling_only else rake(mass, axes, wanted, mass * repeats / total)
    rows = list(zip(few["source"], few["lang"], few["topic"], (share * total / mass).tolist(), repeats.tolist(), strict=True))
    return session.createDataFrame(rows, schema), session.createDataFrame(targets, "axis string, category string, target double"), total


def planned_table(cells: DataFrame, given: dict[str, dict[str, float]], temper: float, scaling_only: bool) -> tuple[DataFrame, DataFrame, float]:
    """``planned`` without gathering cells, for any number of them."""
    session = cells.sparkSession
    sources = cut(cells.groupBy("source").agg(F.sum("mass").alias("whole"), F.first("weight").alias("w")))
    all_weights = sources.agg(F.sum("w")).first()[0]
    goals = sources.select("source", "whole", (F.col("w") / F.lit(all_weights)).alias("goal"))
    full = cells.join(goals, "source")
    total = full.agg(F.min(F.col("whole") * F.col("repeats") / F.col("goal"))).first()[0]
    full = full.withColumn("most", F.col("mass") * F.col("repeats") / F.lit(total))
    full = cut(full.withColumn("want", F.col("goal") * F.col("mass") / F.col("whole")) if scaling_only else tempered_table(full, temper))
    targets = []
    for axis in AXES:
        target = full.groupBy(axis).agg(F.sum("want").alias("target"))
        if axis in given:
            table = session.createDataFrame(list(given[axis].items()), f"{axis} string, given double")
            target = target.join(table, axis, "left").na.fill(0.0, ["given"])
            target = target.select(axis, (F.col("given") / F.lit(target.agg(F.sum("given")).first()[0])).alias("target"))
        targets.append(cut(target))
    share = full.withColumn("share", F.col("want")) if scaling_only else rake_table(full.select(*AXES, "mass", "repeats", "most"), targets)
    listed = [t.select(F.lit(a).alias("axis"), F.col(a).alias("category"), "target") for a, t in zip(AXES, targets, strict=True)]
    return share.select(*AXES, (F.col("share") * F.lit(total) / F.col("mass")).alias("expected"), "repeats"), listed[0].unionAll(listed[1]).unionAll(listed[2]), total


def sized_documents(documents: DataFrame, weights: DataFrame, topic: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The usable documents of the weighted sources (doc_id, source, lang, topic, tokens), and their cells."""
    wanted = weights.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.max("target_share").cast("double").alias("weight"), F.max("max_repeats").cast("double").alias("repeats")
    )
    # The weights are one row for each source; the planner broadcasts them if their size is small, before texts are read.
    used = documents.where("doc_id is not null and text <> ''").join(wanted.select("source"), "source", "left_semi")
    used = used.withColumns({"lang": F.coalesce("lang", F.lit("")), "topic": F.coalesce(F.col(topic), F.lit(""))})
    sized = cut(with_tokens(used, "doc_id bigint, source string, lang string, topic string", path).where("tokens > 0"))
    return sized, sized.groupBy(*AXES).agg(F.sum("tokens").cast("double").alias("mass")).join(wanted, "source")


def drawn_documents(sized: DataFrame, expected: DataFrame, total: float, seed: int) -> DataFrame:
    """doc_id, source, lang, topic, tokens, copies: the systematic sample with the cells' expected copies."""
    drawn = sized.join(expected, list(AXES))
    whole = F.floor(F.col("expected") + 1e-9)
    drawn = drawn.select("doc_id", *AXES, "tokens", "expected", "repeats", whole.alias("whole"), F.greatest(F.col("expected") - whole, F.lit(0.0)).alias("part"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(16))
    # By language, then by size: so each language of a source is met within a document, and sizes are spread.
    drawn = drawn.withColumn("bucket", F.struct("lang", (F.floor(F.log("tokens") * 40) * 16 + hashed).alias("size")))
    placed = cut(ordered_scan(drawn, ["source"], "bucket", ["tokens", "doc_id"], total={"upto": "part"}))

    def copies(start: Column) -> Column:
        hit = F.floor(F.col("upto") + start + 1e-9) - F.floor(F.col("upto") - F.col("part") + start + 1e-9)
        return F.least(F.col("whole") + hit, F.col("repeats").cast("bigint"))

    starts = [k / STARTS for k in range(STARTS)]
    sums = placed.groupBy("source").agg(F.sum(F.col("expected") * F.col("tokens")).alias("aim"), F.array(*[F.sum(copies(F.lit(u)) * F.col("tokens")) for u in starts]).alias("sums"))
    off = F.transform("sums", lambda x: F.abs(x - F.col("aim")))
    best = sums.select("source", ((F.array_position(off, F.array_min(off)) - 1) / F.lit(float(STARTS))).alias("start"))
    return placed.join(best, "source").select("doc_id", *AXES, "tokens", copies(F.col("start")).alias("copies")).where("copies > 0")


def chosen(
    documents: DataFrame, weights: DataFrame, language_targets: dict[str, float] | None, topic_targets: dict[str, float] | None,
    topic: str, seed: int, path: str, temper: float, driver_cells: int, scaling_only: bool,
) -> tuple[DataFrame, DataFrame]:
    given = {axis: t for axis, t in (("lang", language_targets), ("topic", topic_targets)) if t is not None}
    sized, cells = sized_documents(documents, weights, topic, path)
    expected, targets, total = planned(cells, given, temper, driver_cells, scaling_only)
    return drawn_documents(sized, expected, total, seed), targets


def selection(
    documents: DataFrame, weights: DataFrame, language_targets: dict[str, float] | None = None,
    topic_targets: dict[str, float] | None = None, topic: str = "series", seed: int = 7, path: str = RANKS,
    temper: float = TEMPER, driver_cells: int = DRIVER_CELLS, scaling_only: bool = False,
) -> DataFrame:
    """The documents used and how often: doc_id, source, tokens, copies (1 to the source's max_repeats).

    Token weights of the cells of source, language and topic are raked to the sources' target shares and to targets of
    languages and topics. These default to a make-up of each source that is evened out (see ``tempered``). The total is
    the largest at which no source is used more often than it may be, and no cell is raised above its source's repeats.
    Each document's expected number of copies is its cell's; the whole part is taken, and a systematic sample, over
    documents in order of language and size, gives the rest. Of ``STARTS`` starting points of the sample the one that meets the
    source's tokens best is taken. ``scaling_only`` leaves the raking out, for comparison.

    Target shares are scaled to sum to 1; sources without tokens or share are left out and their share falls to the
    others. Null or empty texts, and sources not in ``weights``, aren't selected; of several weights of a source the
    largest holds. A null language or topic is a category of its own. Nothing to select gives no rows. Texts are counted
    where they are scanned and go no further; cells are gathered if there are few of them, documents never.
    """
    rows, _ = chosen(documents, weights, language_targets, topic_targets, topic, seed, path, temper, driver_cells, scaling_only)
    return rows.select("doc_id", "source", "tokens", "copies")


def marginals(
    documents: DataFrame, weights: DataFrame, language_targets: dict[str, float] | None = None,
    topic_targets: dict[str, float] | None = None, topic: str = "series", seed: int = 7, path: str = RANKS,
    temper: float = TEMPER, driver_cells: int = DRIVER_CELLS, scaling_only: bool = False,
) -> DataFrame:
    """Target and actual share of all selected tokens for the categories of each axis: axis, category, target, actual."""
    rows, targets = chosen(documents, weights, language_targets, topic_targets, topic, seed, path, temper, driver_cells, scaling_only)
    each = rows.select((F.col("tokens") * F.col("copies")).alias("n"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in AXES])).alias("x"))
    actual = each.groupBy("x.axis", "x.category").agg(F.sum("n").alias("n"))
    actual = actual.withColumn("actual", F.col("n") / F.sum("n").over(Window.partitionBy("axis"))).drop("n")
    return targets.join(actual, ["axis", "category"], "left").na.fill(0, ["actual"])


def shares(documents: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """Per source of ``weights``: target and actual share of all selected tokens, tokens, documents and copies."""
    picked = selection(documents, weights, **options).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"),
        F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"),
    )
    joined = weights.select("source", "target_share", "max_repeats").join(picked, "source", "left").na.fill(0, ["n_tokens", "n_documents", "n_copies", "most_copies"])
    # One row for each source: a window over all of them.
    actual = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))
    return joined.select("source", "target_share", actual.alias("actual_share"), "n_tokens", "n_documents", "n_copies", "most_copies", "max_repeats")
