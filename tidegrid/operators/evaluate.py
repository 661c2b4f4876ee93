"""Evaluation of scores: thresholds, rank metrics, splits, selection, bootstrap and false-discovery control."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels


def alarm_threshold(scored: DataFrame, keys: Sequence[str], budgets: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """keys, budget, threshold: the order statistic at ceil((1 - budget)(n - 1)) of the scores with label 0.

    That is the quantile that never lies below the exact one, so that with alarms strictly above it at most the budget
    of the negatives is alarmed. Equal scores are counted first, on the map side; the distinct scores of a key pass one task.
    """
    counts = scored.filter((F.col(label) == 0) & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(score)
    upto = counts.withColumns({"__to": F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(Window.partitionBy(*keys))})
    each = upto.withColumn("budget", F.explode(F.array(*(F.lit(float(b)) for b in budgets))))
    at = F.ceil((F.lit(1.0) - F.col("budget")) * (F.col("__all") - 1))
    return each.filter(F.col("__to") > at).groupBy(*keys, "budget").agg(F.min(score).alias("threshold"))


def rank_metrics(scored: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """keys, n, positives, prevalence, auroc (null for one class), average_precision (null without positives); ties share ranks.

    Equal scores are counted first, on the map side; the distinct scores of a key pass one task as running sums.
    """
    g = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("bigint")).alias("__k"))
    up = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    x = g.withColumns({"__cn": F.sum("__n").over(up), "__dn": F.sum("__n").over(down), "__dk": F.sum("__k").over(down), "__all": F.sum("__n").over(whole), "__pos": F.sum("__k").over(whole)})
    p, n = F.max("__pos").cast("double"), F.max("__all").cast("double")
    return x.groupBy(*keys).agg(
        F.max("__all").alias("n"),
        F.max("__pos").alias("positives"),
        (p / n).alias("prevalence"),
        F.try_divide(F.sum(F.col("__k") * (F.col("__cn") - (F.col("__n") - 1) / 2)) - p * (p + 1) / 2, F.nullif(p * (n - p), F.lit(0.0))).alias("auroc"),
        F.sum(F.try_divide(F.col("__k"), F.col("__pos")) * (F.col("__dk") / F.col("__dn"))).alias("average_precision"),
    )


def alarm_metrics(scored: DataFrame, keys: Sequence[str], label: str = "label", alarm: str = "alarm", order: str = "date") -> DataFrame:
    """Confusion counts, rates and episodes (runs of alarms in the order of ``order``; false without a positive inside)."""
    w = Window.partitionBy(*keys).orderBy(order)
    a = F.coalesce(F.col(alarm), F.lit(False))
    new = (a & ~F.coalesce(F.lag(a).over(w), F.lit(False))).cast("int")
    x = scored.withColumn("__new", new).withColumn("__e", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*keys, "__e").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.expr(f"coalesce({alarm}, false) = {str(b).lower()} and {label} = {v}")).alias(c) for c, b, v in (("tp", True, 1), ("fp", True, 0), ("fn", False, 1), ("tn", False, 0))),
        F.max("__new").alias("__run"),
    )
    t = runs.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn", "tn")), F.sum("__run").cast("bigint").alias("alarm_episodes"), F.sum(F.when((F.col("__run") == 1) & (F.col("tp") == 0), 1).otherwise(0)).cast("bigint").alias("false_alarm_episodes"))
    at_least_1 = lambda c: F.greatest(c, F.lit(1))
    return t.withColumns({
        "false_positive_rate": F.col("fp") / at_least_1(F.col("fp") + F.col("tn")),
        "recall": F.col("tp") / at_least_1(F.col("tp") + F.col("fn")),
        "precision": F.col("tp") / at_least_1(F.col("tp") + F.col("fp")),
        "time_under_warning": (F.col("tp") + F.col("fp")) / F.col("n"),
    })


def brier(scored: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))


def stratified(scored: DataFrame, keys: Sequence[str], stratum: str, label: str = "label", score: str = "score") -> DataFrame:
    """auroc and average_precision within each stratum of two classes, averaged by its positives."""
    per = rank_metrics(scored, [*keys, stratum], label, score).filter("auroc is not null")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("positives")), F.sum("positives")).alias(c)
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("strata"), mean("auroc"), mean("average_precision"))


def purged_splits(panel: DataFrame, keys: Sequence[str], date: str = "date", resolved: str = "label_end", calibration: int = 252, least: int = 525, least_fit: int = 252) -> DataFrame:
    """One row per key and calendar year with enough resolved history before it.

    known: rows with ``resolved`` before January 1st; the last ``calibration`` of them calibrate; those resolved before the
    first calibration date fit. Columns: year, known, fit_rows, fit_label_end, calibration_start, calibration_label_end,
    test_start, test_end. Rows per key are one a day; years are few, so the join by key multiplies by years only.
    """
    years = panel.groupBy(*keys, F.year(date).alias("year")).agg(F.min(date).alias("test_start"), F.max(date).alias("test_end"))
    rows = panel.filter(F.col(resolved).isNotNull()).select(*keys, F.col(date).alias("__d"), F.col(resolved).alias("__e"))
    known = years.join(rows, list(keys)).filter(F.col("__e") < F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    w = Window.partitionBy(*keys, "year").orderBy(F.desc("__d"))
    ranked = known.withColumn("__r", F.row_number().over(w))
    cal = ranked.withColumn("__c", F.min(F.when(F.col("__r") <= calibration, F.col("__d"))).over(Window.partitionBy(*keys, "year")))
    out = cal.groupBy(*keys, "year", "test_start", "test_end").agg(
        F.count(F.lit(1)).alias("known"),
        F.count_if(F.col("__e") < F.col("__c")).alias("fit_rows"),
        F.max(F.when(F.col("__e") < F.col("__c"), F.col("__e"))).alias("fit_label_end"),
        F.min("__c").alias("calibration_start"),
        F.max(F.when(F.col("__d") >= F.col("__c"), F.col("__e"))).alias("calibration_label_end"),
    )
    return out.filter((F.col("known") >= least) & (F.col("fit_rows") >= least_fit))


def inner_folds(panel: DataFrame, keys: Sequence[str], date: str = "date", resolved: str = "label_end", start: float = 0.4, blocks: int = 2) -> DataFrame:
    """keys, block, start, end, rows, train_rows: equal blocks of the rows behind the first ``start`` share, trained on the rows resolved before each."""
    s = Window.partitionBy(*keys).orderBy(date)
    x = panel.withColumns({"__i": F.row_number().over(s) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    first = F.floor(F.col("__n") * start)
    edge = lambda k: F.floor(first + (F.col("__n") - first) * k / blocks)
    x = x.withColumn("block", F.coalesce(*(F.when((F.col("__i") >= edge(k)) & (F.col("__i") < edge(k + 1)), F.lit(k + 1)) for k in range(blocks))))
    each = x.filter("block is not null").groupBy(*keys, "block").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("rows"))
    train = each.join(x.select(*keys, F.col(resolved).alias("__e")), list(keys)).groupBy(*keys, "block", "start", "end", "rows")
    return train.agg(F.count_if(F.col("__e") < F.col("start")).alias("train_rows"))


def first_best(candidates: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The candidate of each key with the greatest value, null as -1, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(F.col(value), F.lit(-1.0)).desc(), order)
    return candidates.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def benjamini_hochberg(tests: DataFrame, keys: Sequence[str], p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """``tests`` with q_value_bh and significant."""
    w = Window.partitionBy(*keys).orderBy(p, tie)
    m, r = F.count(p).over(Window.partitionBy(*keys)), F.row_number().over(w)
    raw = tests.filter(F.col(p).isNotNull()).withColumn("__q", F.col(p) * m / r)
    back = Window.partitionBy(*keys).orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("__q").over(back))
    return raw.withColumn("q_value_bh", q).withColumn("significant", F.col("q_value_bh") <= alpha).drop("__q")


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """The inner join by all of ``on``; other columns that both have get the suffixes. Null keys meet nothing."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    named = lambda df, suffix: df.select(*(F.col(f"`{c}`").alias(c + suffix if c in both else c) for c in df.columns))
    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(on))


def reproduction(now: DataFrame, published: DataFrame, on: Sequence[str], by: Sequence[str], value: str, alarm: str) -> DataFrame:
    """What was recomputed against what was published, joined by ``on``: for each of ``by`` rows, ``most`` (largest difference in ``value``), alarm_mismatches."""
    x = joined(now, published, on, ("", "_published"))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(F.col(value) - F.col(f"{value}_published"))), 9).alias("most"), F.count_if(~F.col(alarm).eqNullSafe(F.col(f"{alarm}_published"))).alias("alarm_mismatches"))


#: A pair table of up to so many rows goes to the tasks as arrays; a larger one is joined.
MAX_PAIRED = 1_000_000
_PRIME = 2_147_483_647


def _mixed(draw, k, block: int, seed: int):
    """A number below the prime from a draw and a block's place in it: squares modulo the prime, alike for columns and arrays."""
    a = (draw * 7919 + k * 104729 + (block * 31 + seed)) % _PRIME + 1
    x = a * 48271 % _PRIME
    x = (x * x + a) % _PRIME
    return (x * x + a) % _PRIME


def block_starts(spark: SparkSession, n: int, block: int, draws: int, seed: int = 42) -> DataFrame:
    """draw, position, row: the rows (from 0) of each moving-block sample, differently for each block length.

    Starts are computed from draw and place where the rows are made; nothing is listed on the driver.
    """
    block = max(1, min(block, n))
    per = -(-n // block) if n else 0
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(max(per, 1) - 1).cast("bigint"))
    base = spark.range(draws).select(F.col("id").alias("draw"), F.explode(places).alias("k")).filter(F.lit(n > 0))
    start = (_mixed(F.col("draw"), F.col("k"), block, seed) * F.lit(n - block + 1) / F.lit(_PRIME)).cast("bigint")
    each = base.withColumn("start", start).select("draw", "k", "start", F.posexplode(F.sequence(F.lit(0), F.lit(block - 1))))
    return each.select(F.col("draw").cast("int").alias("draw"), (F.col("k") * block + F.col("pos")).alias("position"), (F.col("start") + F.col("pos")).alias("row")).filter(F.col("position") < n)


def bootstrap_difference(paired: DataFrame, model: str, reference: str, order: str, blocks: Sequence[int] = (20, 60, 120), draws: int = 500, seed: int = 42, family: int = 1, label: str = "label", most: int = MAX_PAIRED) -> DataFrame:
    """Moving-block bootstrap of the difference in average precision of two scores: one row for each block length.

    ``paired`` has one row per value of ``order``, a label and two scores; rows with a null are left out, samples of one class
    too. Columns: block_sessions, draws, ap_difference (of the whole), lower95, upper95, lower_bonferroni, upper_bonferroni,
    share_draws_favouring_model, p_approx. Tables of up to ``most`` rows go to the tasks as arrays, and every draw is one small
    computation there; larger ones are numbered and joined with the drawn rows. No rows give no draws.
    """
    spark = paired.sparkSession
    rows = paired.dropna(subset=[order, label, model, reference]).select(order, F.col(label).cast("double").alias("y"), F.col(model).cast("double").alias("m"), F.col(reference).cast("double").alias("r"))
    held = rows.orderBy(order).limit(most + 1).toPandas()
    each = _drawn_here(spark, held, blocks, draws, seed) if len(held) <= most else _drawn_by_joins(rows, order, blocks, draws, seed)
    drawn = F.when(F.col("draw") >= 0, F.col("d"))
    tail = 0.05 / family / 2
    s = F.avg((drawn > 0).cast("double"))
    return each.groupBy(F.col("block").alias("block_sessions")).agg(
        F.count(drawn).alias("draws"), F.max(F.when(F.col("draw") < 0, F.col("d"))).alias("ap_difference"),
        F.percentile(drawn, 0.025).alias("lower95"), F.percentile(drawn, 0.975).alias("upper95"),
        F.percentile(drawn, tail).alias("lower_bonferroni"), F.percentile(drawn, 1 - tail).alias("upper_bonferroni"),
        s.alias("share_draws_favouring_model"), F.greatest(F.lit(1 / 501), F.least(F.lit(1.0), F.least(s, 1 - s) * 2)).alias("p_approx"),
    )


def _drawn_here(spark: SparkSession, held: pd.DataFrame, blocks: Sequence[int], draws: int, seed: int) -> DataFrame:
    """block, draw (-1: the whole), d (null for one class) from arrays that every task has."""
    shared = spark.sparkContext.broadcast([held[c].to_numpy(dtype=float) for c in ("y", "m", "r")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, m, r = shared.value
        n = len(y)
        for batch in batches:
            out = []
            for size, draw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.arange(n)
                if draw >= 0 and n:
                    block = max(1, min(size, n))
                    starts = _mixed(np.int64(draw), np.arange(-(-n // block), dtype=np.int64), block, seed) * (n - block + 1) / _PRIME
                    at = (starts.astype(np.int64)[:, None] + np.arange(block)).ravel()[:n]
                hits = y[at].sum()
                out.append(kernels.average_precision(y[at], m[at]) - kernels.average_precision(y[at], r[at]) if 0 < hits < n else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["block", "draw", "d"])

    each = F.explode(F.array(*map(F.lit, blocks))).alias("block")
    return spark.range(-1, draws).select(each, F.col("id").cast("int").alias("draw")).mapInArrow(run, "block int, draw int, d double")


def _drawn_by_joins(rows: DataFrame, order: str, blocks: Sequence[int], draws: int, seed: int) -> DataFrame:
    """The same by relational operators; rows are numbered by a window over ``order`` alone, one small row a session."""
    spark, n = rows.sparkSession, rows.count()
    numbered = rows.withColumn("row", (F.row_number().over(Window.partitionBy().orderBy(order)) - 1).cast("bigint"))
    sample = numbered.select(F.explode(F.array(*map(F.lit, blocks))).alias("block"), F.lit(-1).alias("draw"), "row")
    for block in blocks:
        sample = sample.unionByName(block_starts(spark, n, block, draws, seed).select(F.lit(block).alias("block"), "draw", "row"))
    both = F.explode(F.array(F.struct(F.lit("m").alias("w"), F.col("m").alias("s")), F.struct(F.lit("r").alias("w"), F.col("r").alias("s"))))
    ap = rank_metrics(sample.join(numbered, "row").select("block", "draw", "y", both.alias("x")).select("block", "draw", "y", "x.w", "x.s"), ["block", "draw", "w"], "y", "s")
    delta = F.max(F.when(F.col("w") == "m", F.col("average_precision"))) - F.max(F.when(F.col("w") == "r", F.col("average_precision")))
    each = ap.groupBy("block", "draw").agg(delta.alias("d"), F.min("auroc").alias("two"))
    return each.select("block", "draw", F.when(F.col("two").isNotNull(), F.col("d")).alias("d"))
