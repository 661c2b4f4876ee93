"""Mixing sources to target shares of the total size: iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import BYTE_BPE_50K, count_tokens

#: At most so many cells (source x language x topic) are raked on the driver; they don't grow with the corpus, and more are refused.
MAX_CELLS = 100_000
#: Tables of counts up to so many rows are broadcast; larger ones are joined.
MAX_BROADCAST = 100_000
#: Ranges of sizes (so many as the size doubles) and hash buckets of about so many rows by which the running sums of a source are split among tasks.
BANDS_PER_DOUBLING, BUCKET_ROWS = 8, 100_000
ROUNDS = 200
#: Weights that move less than this share in a round stand.
STEADY = 1e-9


@dataclass(frozen=True)
class Cell:
    source: str
    language: str
    topic: str
    tokens: float


def normal_source(c: Column) -> Column:
    """Case and blanks around a source mean no difference; a blank source becomes null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def language(c: Column) -> Column:
    """en, de or fr however they are written; anything else and null is 'und'."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("en", "eng"), "en").when(x.isin("de", "deu", "ger"), "de").when(x.isin("fr", "fra", "fre"), "fr").otherwise("und")


def topic(docket: Column) -> Column:
    """The kind of case: the letters that begin the docket, else 'none'."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(docket), r"^\s*([A-Z]+)", 1), F.lit("")), F.lit("none"))


@dataclass(frozen=True)
class Raked:
    """Expected uses of each cell's documents, their total size, the rounds taken and whether the weights came to stand."""

    weight: np.ndarray
    total: float
    rounds: int
    converged: bool


def rake(cells: list[Cell], shares: dict[str, float], repeats: dict[str, int], total: float | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Expected uses of each cell's documents and the total size, as ``raked`` has them."""
    out = raked(cells, shares, repeats, total, rounds)
    return out.weight, out.total


def raked(cells: list[Cell], shares: dict[str, float], repeats: dict[str, int], total: float | None = None, rounds: int = ROUNDS) -> Raked:
    """Weights of the cells by iterative proportional fitting.

    Cells are scaled in turn to the source targets and to the corpus's own marginals of language and topic among the
    eligible cells, each cell held to at most the repeats of its source; the last step meets the sources exactly. Shares of
    sources without text are given to the others in proportion. ``total`` defaults to, and is never above, the largest
    size at which no source needs more than its repeats.
    """
    size = np.array([c.tokens for c in cells], dtype=float)
    source = np.array([c.source for c in cells], dtype=object)
    there = {s: size[source == s].sum() for s in shares}
    live = [s for s in shares if shares[s] > 0 and repeats[s] > 0 and there[s] > 0]
    weight = np.zeros(len(cells))
    if not live:
        return Raked(weight, 0.0, 0, True)
    scale = sum(shares[s] for s in live)
    want = {s: shares[s] / scale for s in live}
    most = min(there[s] * repeats[s] / want[s] for s in live)
    total = most if total is None else min(total, most)
    cap = np.array([repeats[s] if s in want else 0 for s in source], dtype=float)
    use = cap > 0
    weight[use] = 1.0
    margins = []
    for name in ("language", "topic"):
        value = np.array([getattr(c, name) for c in cells], dtype=object)
        for v in sorted(set(value[use])):
            at = use & (value == v)
            margins.append((at, size[at].sum() / size[use].sum() * total))
    for k in range(rounds):
        before = weight.copy()
        for at, goal in margins:
            now = (weight[at] * size[at]).sum()
            if now > 0:
                weight[at] = np.minimum(weight[at] * goal / now, cap[at])
        for s in live:
            at = source == s
            weight[at] = fill(weight[at], size[at], float(repeats[s]), want[s] * total)
        if np.allclose(weight, before, rtol=STEADY, atol=0):
            return Raked(weight, total, k + 1, True)
    return Raked(weight, total, rounds, False)


def fill(weight: np.ndarray, size: np.ndarray, cap: float, goal: float) -> np.ndarray:
    """``weight`` scaled so that its size sums to ``goal``, cells at the cap left there and the rest scaled on."""
    weight = np.where(weight > 0, weight, 1e-12)
    held = np.zeros(len(weight), dtype=bool)
    for _ in range(len(weight) + 1):
        free = (weight[~held] * size[~held]).sum()
        rest = goal - cap * size[held].sum()
        if free <= 0 or rest <= 0:
            break
        weight = np.where(held, cap, weight * (rest / free))
        over = ~held & (weight > cap * (1 + 1e-12))
        if not over.any():
            break
        held |= over
        weight = np.where(held, cap, weight)
    return np.minimum(weight, cap)


KEYS = ["source", "language", "topic"]


@dataclass(frozen=True)
class Mix:
    """A raked corpus: its counted documents of target sources (``rows``), the cells and what raking gave."""

    rows: DataFrame
    cells: list[Cell]
    result: Raked


def raked_mix(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = BYTE_BPE_50K) -> Mix:
    """Counts the tokens of every document of a target source, once, and rakes the cells.

    Documents of no size (null and empty texts) are left out; repeated targets of one source count once, with their greatest
    share; null shares and repeats count as 0. The counts are cut off in the session's shared folder. More than 100,000
    target sources or cells are refused.
    """
    rows = count_tokens(documents.select("doc_id", normal_source(F.col("source")).alias("source"), language(F.col("lang")).alias("language"), topic(F.col("docket")).alias("topic"), "text"), keep=["doc_id", *KEYS], path=path)
    rows = rows.filter("n_tokens > 0 and source is not null")
    goals = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    goal_rows = goals.limit(MAX_CELLS + 1).collect()
    if len(goal_rows) > MAX_CELLS:
        raise ValueError("too many target sources")
    shares = {r["source"]: max(0.0, r["share"] or 0.0) for r in goal_rows}
    repeats = {r["source"]: max(0, r["repeats"] or 0) for r in goal_rows}
    rows = cut(rows.join(F.broadcast(goals.filter("share > 0 and repeats > 0").limit(MAX_CELLS)), "source"))  # tokens are counted once
    cells = [Cell(r["source"], r["language"], r["topic"], float(r["t"])) for r in rows.groupBy(*KEYS).agg(F.sum("n_tokens").alias("t")).orderBy(*KEYS).limit(MAX_CELLS + 1).collect()]
    if len(cells) > MAX_CELLS:
        raise ValueError("too many cells of source, language and topic")
    return Mix(rows, cells, raked(cells, shares, repeats, total))


def bounded(table: DataFrame, most: int) -> DataFrame:
    """``table`` to be broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def draw(mix: Mix, seed: int = 7, bucket_rows: int = BUCKET_ROWS, most: int = MAX_BROADCAST) -> DataFrame:
    """The documents to use and how often, by systematic sampling: doc_id, source, language, topic, n_tokens, ``weight``, ``uses``.

    Documents of a source are ordered by size, then cell, and each is used as often as the running sum of weights passes a
    whole number, so a source's size misses its goal by about one document. The running sum is taken in three steps: over
    size ranges and cells of a source, over hash buckets of a range, of which it has as many as its rows ask for, and within
    a bucket. No task needs a whole source or range.
    """
    spark = mix.rows.sparkSession
    band = F.floor(F.log2(F.col("n_tokens").cast("double")) * BANDS_PER_DOUBLING).cast("int")
    rows = mix.rows.withColumn("band", band)
    weights = [(c.source, c.language, c.topic, float(w)) for c, w in zip(mix.cells, mix.result.weight)]
    table = spark.createDataFrame(weights, "source string, language string, topic string, weight double")
    by_range = Window.partitionBy("source").orderBy("band", "language", "topic").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*KEYS, "band").agg(F.count(F.lit(1)).alias("n")).join(bounded(table, most), KEYS)
    ranges = ranges.select(*KEYS, "band", "weight", F.ceil(F.col("n") / bucket_rows).cast("int").alias("buckets"), F.coalesce(F.sum(F.col("n") * F.col("weight")).over(by_range), F.lit(0.0)).alias("before"))
    rows = rows.join(bounded(ranges, most), [*KEYS, "band"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets")).cast("int"))
    by_bucket = Window.partitionBy(*KEYS, "band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*KEYS, "band", "bucket").agg(F.count(F.lit(1)).alias("n")).select(*KEYS, "band", "bucket", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("first"))
    order = Window.partitionBy(*KEYS, "band", "bucket").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0) + F.col("before")
    uses = F.floor(F.col("k") * F.col("weight") + start) - F.floor((F.col("k") - 1) * F.col("weight") + start)
    drawn = rows.join(bounded(starts, most), [*KEYS, "band", "bucket"]).withColumn("k", F.row_number().over(order) + F.col("first"))
    return drawn.withColumn("uses", F.least(uses, F.col("repeats")).cast("int")).filter("uses > 0").select("doc_id", *KEYS, "n_tokens", F.round("weight", 9).alias("weight"), "uses")


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = BYTE_BPE_50K, seed: int = 7) -> DataFrame:
    """The documents to use and how often: doc_id, source, language, topic, n_tokens, ``weight``, ``uses``.

    Sizes are tokens of the whole text under the vocabulary of ``path``. Documents of sources without a target, of no
    size (null and empty texts) or not drawn are left out; ``uses`` is never above the source's ``max_repeats``. Targets
    without documents give no rows.
    """
    return draw(raked_mix(documents, targets, total, path), seed)


def reached_marginals(mix: Mix, selection: DataFrame) -> DataFrame:
    """How near the mix comes to each marginal: ``dimension`` (source, language, topic), ``value``, ``target_share``,
    ``raked_share`` of the weights, ``actual_share`` of the documents drawn, ``rounds`` and ``converged`` of the raking.

    Targets of languages and topics are the corpus's own shares among the documents of target sources; those of sources are
    their own among the sources that have documents. The table has a row per value; its numbers are sums over cells.
    """
    spark = mix.rows.sparkSession
    size = np.array([c.tokens for c in mix.cells], dtype=float)
    use = size * mix.result.weight
    goal = {r["source"]: max(0.0, r["share"] or 0.0) for r in mix.rows.select("source", "share").distinct().limit(MAX_CELLS).collect()}
    rows = []
    for dimension in KEYS:
        values = np.array([getattr(c, dimension) for c in mix.cells], dtype=object)
        for v in sorted(set(values)):
            at = values == v
            target = goal.get(v, 0.0) / (sum(goal.values()) or 1.0) if dimension == "source" else size[at].sum() / size.sum()
            rows.append((dimension, v, round(float(target), 6), round(float(use[at].sum() / (use.sum() or 1.0)), 6), mix.result.rounds, mix.result.converged))
    table = spark.createDataFrame(rows, "dimension string, value string, target_share double, raked_share double, rounds int, converged boolean")
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in KEYS))).alias("m")
    got = selection.select(each, (F.col("uses") * F.col("n_tokens")).alias("t")).groupBy("m.dimension", "m.value").agg(F.sum("t").alias("t"))
    out = table.join(got, ["dimension", "value"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    share = F.round(F.try_divide("t", F.sum("t").over(Window.partitionBy("dimension"))), 6)
    return out.select("dimension", "value", "target_share", "raked_share", share.alias("actual_share"), "rounds", "converged")


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, max_repeats, documents, most_uses, tokens, actual_share (0 where nothing was drawn)."""
    goals = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = selection.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    out = goals.join(got, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "most_uses": F.coalesce("most_uses", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    return out.withColumn("actual_share", F.round(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), 6))
