"""Validity masks and guarded arithmetic on doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def positive(c: Column | str) -> Column:
    """The value where it is finite and above 0, else null."""
    c = col(c)
    return F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)


def capped_magnitude(c: Column | str, limit: float) -> Column:
    """The value where its magnitude is at most ``limit``, else null."""
    c = col(c)
    return F.when(F.abs(c) <= limit, c)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clip to [low, high]; null stays null, though greatest() and least() would skip it."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def none_of(c: Column | str, values: Sequence) -> Column:
    """Whether the value is none of a list; null is none of them."""
    return F.coalesce(~col(c).isin(*values), F.lit(True))
