"""Walk-forward fits: many small regressions in parallel groups, tree ensembles by MLlib, frozen transfer and ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import cut, spread
from .evaluate import alarm_threshold, purged_splits

PENALTIES = (0.01, 0.1, 1.0)


def scale_fit(x: np.ndarray, y: np.ndarray, c: float, penalty: str) -> np.ndarray | float:
    """A fit on standardised columns (population deviation; constant columns as they are), or the prevalence for one class."""
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    center, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    w = kernels.logistic((x - center) / sd, y, c, penalty)
    return np.r_[w[0] - (w[1:] * center / sd).sum(), w[1:] / sd]


def scores_of(fit: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), fit) if isinstance(fit, float) else 1 / (1 + np.exp(-np.clip(fit[0] + x @ fit[1:], -35, 35)))


def inner_score(x: np.ndarray, y: np.ndarray, date: np.ndarray, end: np.ndarray, c: float, penalty: str, start: float = 0.4, history: int | None = None, classic: bool = False) -> float:
    """Average precision over two blocks behind the first ``start`` share, each fitted on the rows resolved before it.

    Fits of one class give their prevalence, and -1 is returned without positives. ``classic`` averages over the blocks that
    have both classes in both parts instead, and returns minus infinity if there is none.
    """
    n = len(y)
    edges = np.linspace(int(start * n), n, 3).astype(int)
    got, want, each = [], [], []
    for a, z in zip(edges[:-1], edges[1:]):
        if a == z:
            continue
        train = np.flatnonzero(end < date[a])
        train = train[-history:] if history else train
        if classic and (len(np.unique(y[train])) < 2 or len(np.unique(y[a:z])) < 2):
            continue
        got.append(scores_of(scale_fit(x[train], y[train], c, penalty), x[a:z]))
        want.append(y[a:z])
        each.append(kernels.average_precision(want[-1], got[-1]))
    if classic:
        return float(np.mean(each)) if each else -np.inf
    ap = kernels.average_precision(np.concatenate(want), np.concatenate(got)) if want else None
    return -1.0 if ap is None else ap


def complete_rows(panel: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, date, label, label_end and ``columns`` of the rows in which all of ``columns`` are finite."""
    fine = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in columns)
    return panel.filter(fine).select(*keys, "date", "label", "label_end", *columns)


def columns_of(groups: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({c for cs in groups.values() for c in cs})


def fit_years(rows: DataFrame, splits: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]], penalties: Sequence[float] = PENALTIES, penalty: str = "l2", history: int | None = None, classic: bool = False) -> DataFrame:
    """The model of each key, year of ``splits`` and group: keys, year, model, c, inner_ap, ``tried`` (inner_ap of each candidate), constant, intercept, weights.

    Candidates are chosen by inner average precision (the first of equals) and refitted on the rows resolved before the
    calibration rows; ``weights`` are in the order of the group's columns. Where those rows are of one class, ``constant`` is their
    prevalence and there are no weights. A (key, group) is one task, which takes the key's rows, one a day, once for all years.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    each = F.explode(F.array(*map(F.lit, groups)))

    def run(key: tuple, pdf: pd.DataFrame, years: pd.DataFrame) -> pd.DataFrame:
        *own, name = key
        pdf = pdf.sort_values("date")
        date, end = pd.to_datetime(pdf["date"]).to_numpy(), pd.to_datetime(pdf["label_end"]).to_numpy()
        x, y = pdf[list(groups[name])].to_numpy(dtype=float), pdf["label"].to_numpy(dtype=float)
        out = []
        for year, start in sorted(zip(years["year"], pd.to_datetime(years["calibration_start"]))):
            first, cal = np.datetime64(f"{year}-01-01"), start.to_datetime64()
            fit = np.flatnonzero(~np.isnat(end) & (end < first) & (end < cal))
            inner = [inner_score(x[fit], y[fit], date[fit], end[fit], c, penalty, history=history, classic=classic) for c in penalties]
            best = int(np.argmax(inner))
            train = fit[-history:] if history else fit
            model = scale_fit(x[train], y[train], penalties[best], penalty)
            flat = isinstance(model, float)
            tried = [v if np.isfinite(v) else None for v in inner]
            out.append((*own, int(year), name, penalties[best], tried[best], tried, model if flat else None, None if flat else float(model[0]), [] if flat else model[1:].tolist()))
        return pd.DataFrame(out, columns=[*keys, "year", "model", "c", "inner_ap", "tried", "constant", "intercept", "weights"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", year int, model string, c double, inner_ap double, tried array<double>, constant double, intercept double, weights array<double>"
    by = [*keys, "model"]
    years = splits.select(*keys, "year", "calibration_start", each.alias("model")).toDF(*keys, "year", "calibration_start", "model")
    return spread(rows.withColumn("model", each), by).groupBy(*by).cogroup(spread(years, by).groupBy(*by)).applyInPandas(run, schema)


def score_of(groups: Mapping[str, Sequence[str]]) -> Column:
    """The score of a row beside its ``model``, ``constant``, ``intercept`` and ``weights``: one JVM expression."""
    array = lambda names: F.array(*(F.col(c).cast("double") for c in names))
    x = F.coalesce(*(F.when(F.col("model") == name, array(names)) for name, names in groups.items()))
    z = F.col("intercept") + F.aggregate(F.zip_with("weights", x, lambda w, v: w * v), F.lit(0.0), lambda a, v: a + v)
    return F.coalesce("constant", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z)))))


def parts(rows: DataFrame, splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` of each year of ``splits`` with ``part``: the calibration rows resolved before the year, and the year's own (test)."""
    cal = splits.select(*keys, "year", "calibration_start").join(rows, list(keys)).filter((F.col("label_end") < F.make_date(F.col("year"), F.lit(1), F.lit(1))) & (F.col("date") >= F.col("calibration_start")))
    test = rows.withColumn("year", F.year("date")).join(splits.select(*keys, "year"), [*keys, "year"])
    return cal.drop("calibration_start").withColumn("part", F.lit("calibration")).unionByName(test.withColumn("part", F.lit("test")))


def walk_forward(panel: DataFrame, keys: Sequence[str], groups: Mapping[str, Sequence[str]], penalties: Sequence[float] = PENALTIES, penalty: str = "l2", calibration: int = 252, least: int = 525, least_fit: int = 252, history: int | None = None, classic: bool = False) -> DataFrame:
    """Annual purged walk-forward scores: keys, year, model, c, inner_ap, constant_fallback, part (calibration, test), date, label, score.

    ``panel`` has date, label, label_end and the columns of all groups; rows with a null column, NaN or infinity are left out
    for all groups alike. The models are those of ``fit_years``; rows are scored in the JVM. Rows, splits and fits are read
    several times, so each is written once to the session's shared folder.
    """
    rows = cut(complete_rows(panel, keys, columns_of(groups)))
    splits = cut(purged_splits(rows, keys, calibration=calibration, least=least, least_fit=least_fit))
    fits = fit_years(rows, splits, keys, groups, penalties, penalty, history, classic)
    scored = parts(rows, splits, keys).join(cut(fits), [*keys, "year"])
    return scored.select(*keys, "year", "model", "c", "inner_ap", F.col("constant").isNotNull().alias("constant_fallback"), "part", "date", F.col("label").cast("int").alias("label"), score_of(groups).alias("score"))


def raw_benchmark(panel: DataFrame, keys: Sequence[str], score: str, name: str, calibration: int = 252, least: int = 525, least_fit: int = 252) -> DataFrame:
    """A column as a score without any fit, over the same calibration and test rows as ``walk_forward`` would have: its columns without those of a fit."""
    rows = complete_rows(panel, keys, [score])
    splits = purged_splits(rows, keys, calibration=calibration, least=least, least_fit=least_fit)
    return parts(rows, splits, keys).select(*keys, "year", F.lit(name).alias("model"), "part", "date", F.col("label").cast("int").alias("label"), F.col(score).alias("score"))


def transfer(fits: DataFrame, thresholds: DataFrame, rows: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of other entities scored and alarmed by the models and thresholds of a year, both applied unchanged.

    ``fits`` has year, model and the fit; ``thresholds`` year, model, budget, threshold; ``rows`` date, label and the columns of
    ``groups``. Each row gets its own year's models; years without one have no rows.
    """
    frozen = fits.select("year", "model", "constant", "intercept", "weights").join(thresholds, ["year", "model"])
    x = rows.withColumn("year", F.year("date")).join(frozen, "year").withColumn("score", score_of(groups))
    return x.withColumn("alarm", F.col("score") > F.col("threshold")).drop("constant", "intercept", "weights")


def calibrated_alarms(scores: DataFrame, keys: Sequence[str], budgets: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Test rows of ``walk_forward`` with budget, threshold and ``alarm``, strictly above the threshold of the year's calibration rows."""
    by = [*keys, "year", "model"]
    cut = alarm_threshold(scores.filter("part = 'calibration'"), by, budgets)
    return scores.filter("part = 'test'").join(cut, by).withColumn("alarm", F.col("score") > F.col("threshold"))


def ensemble(scores: DataFrame, keys: Sequence[str], first: str, second: str, name: str) -> DataFrame:
    """The mean of two models' scores as a model of its own, with its own threshold to be set."""
    by = [*keys, "year", "part", "date", "label"]
    pair = scores.filter(F.col("model").isin(first, second)).groupBy(*by).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return pair.select(*keys, "year", F.lit(name).alias("model"), "part", "date", "label", "score")


def frozen_scores(coefficients: Mapping[str, float], intercept: float, features: DataFrame) -> DataFrame:
    """``features`` with ``score`` of a logistic model fitted elsewhere: one JVM expression."""
    z = sum((F.col(c) * F.lit(w) for c, w in coefficients.items()), F.lit(intercept))
    return features.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def tree_scores(train: DataFrame, test: DataFrame, columns: Sequence[str], kind: str = "forest", depth: int = 5, trees: int = 200, seed: int = 42) -> DataFrame:
    """``test`` with ``score``, the probability of label 1 by an MLlib random forest or boosted trees fitted on ``train``.

    Rows with a null or NaN among ``columns`` are left out of both. A training set of one class or of no rows gives its
    prevalence (0 for none) to every row.
    """
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train, test = train.dropna(subset=[*columns, "label"]), test.dropna(subset=list(columns))
    n, hits = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < hits < n:
        return test.withColumn("score", F.lit(hits / n if n else 0.0))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip")
    common = {"featuresCol": "__x", "labelCol": "label", "seed": seed, "maxDepth": depth}
    model = (
        RandomForestClassifier(numTrees=trees, minInstancesPerNode=10, featureSubsetStrategy="sqrt", **common)
        if kind == "forest"
        else GBTClassifier(maxIter=min(trees, 100), stepSize=0.04, subsamplingRate=0.8, minInstancesPerNode=10, **common)
    )
    fitted = model.fit(vectors.transform(train))
    return fitted.transform(vectors.transform(test)).withColumn("score", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def best_coordinate(train: DataFrame, keys: Sequence[str], array: str, label: str = "label", digits: int = 12) -> DataFrame:
    """The coordinate of an array whose values rank the labels best in either direction, the first of those equal to ``digits`` places: keys, coordinate, auroc, sign."""
    from .evaluate import first_best, rank_metrics

    each = train.select(*keys, label, F.posexplode(array).alias("coordinate", "v"))
    ranked = rank_metrics(each, [*keys, "coordinate"], label, "v").withColumn("strength", F.round(F.greatest("auroc", F.lit(1.0) - F.col("auroc")), digits))
    return first_best(ranked, keys, "strength", "coordinate").select(*keys, "coordinate", "auroc", F.when(F.col("auroc") >= 0.5, 1).otherwise(-1).alias("sign"))
