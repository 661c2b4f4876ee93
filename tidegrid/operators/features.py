"""Feature panels: groups of features by entity and date, their dynamics, and a registry of the groups that models may use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeline as t
from ..functions.values import finite

#: Columns that follow the calendar more than the market; they stay in the panel but in no group.
COVERAGE = ("eligible_assets", "eligible_fraction")
#: Summaries that are gated research only.
RESEARCH = ("n_assets", "eigenvalue_ratio", "average_correlation", "landscape1_l1_per_asset", "landscape1_l2_per_asset", "network_clustering", "network_algebraic_connectivity")


def enhanced(keys: Sequence[str], p: str = "p", vix: str = "vix", r: str = "r") -> dict[str, Column]:
    """Recent stress by what is known at the close: momenta, drawdowns, downside volatility, change and ratio of the volatility index."""
    s = t.Series(keys)
    return {
        **{f"momentum_{n}": t.momentum(s, p, n) for n in (5, 20, 60)},
        **{f"drawdown_{n}": t.drawdown(s, p, n) for n in (60, 252)},
        "downside_vol20": t.downside_volatility(s, r),
        "vix_change5": t.difference(s, vix, 5),
        "vix_ratio60": t.ratio_to_mean(s, vix, 60),
    }


def with_coverage(panel: DataFrame, coverage: DataFrame, date: str = "date") -> DataFrame:
    """``panel`` with eligible_assets and eligible_fraction of its dates; ``coverage`` has date, eligible and expected, one row a date."""
    x = coverage.select(date, F.col("eligible").alias("eligible_assets"), F.try_divide("eligible", "expected").alias("eligible_fraction"))
    return panel.join(x, date, "left")


def dynamics(keys: Sequence[str], columns: Sequence[str], order: str = "session") -> dict[str, Column]:
    """The change over 5 rows and the causal z of 60 rows (40 at least, clipped to 10) of each column."""
    s = t.Series(keys, order)
    return {name: c for x in columns for name, c in ((f"{x}_change5", t.difference(s, x, 5)), (f"{x}_z60", t.causal_z(s, x, 60, 40)))}


def registry(base: Sequence[str], topology: Sequence[str], moving: Sequence[str], curve: Sequence[str], stress: Sequence[str]) -> dict[str, list[str]]:
    """The groups of features: what is not to be used is named and left out, so that new summaries don't slip into fixed groups."""
    compact = [c for c in topology if c not in RESEARCH]
    out = {"base": list(base), "compact": compact, "combined": [*base, *compact], "dynamic_combined": [*base, *compact, *moving], "full": [*curve, *compact]}
    out["enhanced_base"] = [*base, *(c for c in stress if c not in COVERAGE)]
    out["enhanced_combined"] = [*out["enhanced_base"], *compact]
    return out


def assemble(parts: Sequence[DataFrame], keys: Sequence[str], groups: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per key that every part has, with finite values of all columns of all groups; ``keep`` names columns to be left as they are."""
    x = parts[0]
    for part in parts[1:]:
        x = x.join(part, list(keys))
    columns = sorted({c for cs in groups.values() for c in cs})
    return x.select(*keys, *keep, *(finite(F.col(c).cast("double")).alias(c) for c in columns)).dropna(subset=columns)
