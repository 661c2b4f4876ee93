"""Irregular readings onto a regular weekday grid: harmonic seasonal regression with trend and bridged residuals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clip, finite, positive

#: Harmonics of the year in the regression.
YEARLY = 2
#: Ridge weight of the normal equations, as a share of their diagonal, for series too short to tell the terms apart.
RIDGE = 1e-6
#: Logarithms are held to this magnitude, so that their exponentials are finite and above 0.
LARGEST = 700.0


def features(date: Column, first: Column, last: Column, yearly: int = YEARLY) -> list[Column]:
    """Intercept, trend in [-1, 1], a weekly harmonic and ``yearly`` harmonics of the year."""
    day = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("double")
    span = F.greatest(F.datediff(last, first), F.lit(1))
    out = [F.lit(1.0), F.datediff(date, first) / span * 2.0 - 1.0]
    for period in (7.0, *(365.25 / k for k in range(1, yearly + 1))):
        out += [F.sin(day * (2 * math.pi / period)), F.cos(day * (2 * math.pi / period))]
    return out


def regular_grid(readings: DataFrame, keys: Sequence[str], date: str, value: str, yearly: int = YEARLY) -> DataFrame:
    """One row per key and weekday from its first to its last reading: keys, date, ``value``, ``filled``, ``fitted``.

    ``readings`` has one usable (finite, above 0) reading per key and date; other columns are ignored. On weekdays
    without one, ``value`` is the regression's prediction plus the residual carried linearly in time between the readings
    before and after, so observed values are met exactly, and ``filled`` is true. The logarithm is fitted; where the
    equations have no finite solution the bridge alone fills. Readings on days off serve the fit and the bridges but have no
    grid row; a key read on days off only gives no rows. Every value is finite and above 0.

    The normal equations are sums that Spark combines on the map side; only the solved 8 x 8 systems, one per key, pass
    through Python. All steps keep to one exchange by key, and a key has at most one row per calendar day.
    """
    names = [f"__x{i}" for i in range(4 + 2 * yearly)]
    w = Window.partitionBy(*keys)
    base = readings.select(*keys, date, F.ln(value).alias("__y")).repartition(*keys)
    base = base.withColumns({"__first": F.min(date).over(w), "__last": F.max(date).over(w)})
    x = features(F.col(date), F.col("__first"), F.col("__last"), yearly)
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"__g{i}_{j}") for i, j in pairs] + [F.sum(F.col(n) * F.col("__y")).alias(f"__b{i}") for i, n in enumerate(names)]
    gram = base.select(*keys, "__y", *(c.alias(n) for n, c in zip(names, x))).groupBy(*keys).agg(*sums)

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, b: pd.Series) -> pd.Series:
        a, rhs = np.zeros((len(g), len(names), len(names))), np.array(b.tolist(), dtype=float).reshape(len(b), len(names))
        flat = np.array(g.tolist(), dtype=float).reshape(len(g), len(pairs))
        for k, (i, j) in enumerate(pairs):
            a[:, i, j] = a[:, j, i] = flat[:, k]
        a += np.eye(len(names)) * (RIDGE * np.trace(a, axis1=1, axis2=2) / len(names) + 1e-12)[:, None, None]
        return pd.Series(list(np.linalg.solve(a, rhs[:, :, None])[:, :, 0]))

    coefs = gram.select(*keys, solve(F.array(*(f"__g{i}_{j}" for i, j in pairs)), F.array(*(f"__b{i}" for i in range(len(names))))).alias("__c"))
    seq = Window.partitionBy(*keys).orderBy(date)
    fit = sum((F.col("__c")[i] * c for i, c in enumerate(features(F.col(date), F.col("__first"), F.col("__last"), yearly))), F.lit(0.0))
    fit = F.coalesce(finite(fit), F.lit(0.0))
    known = base.join(coefs.hint("shuffle_hash"), list(keys)).withColumn("__r", F.col("__y") - fit)
    known = known.withColumns({"__gap": F.coalesce(F.datediff(F.lead(date).over(seq), F.col(date)), F.lit(1)), "__after": F.lead("__r").over(seq)})
    dense = known.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__gap") - 1))).withColumn(date, F.date_add(date, F.col("__k"))).filter(F.weekday(date) < 5)
    seen = F.col("__k") == 0
    dense = dense.withColumn("__fit", F.when(seen, F.col("__y") - F.col("__r")).otherwise(fit))
    bridge = F.col("__r") + (F.col("__after") - F.col("__r")) * F.col("__k") / F.col("__gap")
    value = F.exp(clip(F.when(seen, F.col("__y")).otherwise(F.col("__fit") + bridge), -LARGEST, LARGEST))
    return dense.select(*keys, date, value.alias("value"), (~seen).alias("filled"), F.exp("__fit").alias("fitted"))


def feed_readings(markets: DataFrame, vix: DataFrame) -> DataFrame:
    """One usable reading per feed, series (SPY, VIX) and date: the last received of SPY, the last read of VIX.

    Usable: not null, finite, above 0. Rows without feed or date count for nothing. Of equals the greatest value holds.
    """
    spy = markets.select("feed", F.lit("SPY").alias("series"), "date", positive("SPY").alias("value"), F.struct("received_at", positive("SPY").alias("v")).alias("o"))
    read = vix.select("feed", F.lit("VIX").alias("series"), F.col("DATE").alias("date"), positive("CLOSE").alias("value"), F.struct("read_at", "received_at", positive("CLOSE").alias("v")).alias("o"))
    one = lambda df: df.filter("feed is not null and date is not null and value is not null").groupBy("feed", "series", "date").agg(F.max_by("value", "o").alias("value"))
    return one(spy).unionByName(one(read))


def feed_grid(markets: DataFrame, vix: DataFrame) -> DataFrame:
    """The weekday grid of every feed's SPY and VIX: feed, series, date, value, filled, fitted."""
    return regular_grid(feed_readings(markets, vix), ["feed", "series"], "date", "value")
