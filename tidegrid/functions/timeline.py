"""Window expressions over ordered series. A frame that isn't full gives null unless a smaller number of values is allowed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .values import clip, col, ratio

SESSIONS_PER_YEAR = 252


@dataclass(frozen=True)
class Series:
    """Rows of each ``keys`` in the order of ``order``. A key should have a bounded number of rows, such as one a day."""

    keys: Sequence[str]
    order: str | Sequence[str] = "date"

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*([self.order] if isinstance(self.order, str) else self.order))

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.window().rowsBetween(first, last)

    def trailing(self, k: int) -> WindowSpec:
        """The last k rows, this one included."""
        return self.rows(-(k - 1), 0)

    def preceding(self, k: int) -> WindowSpec:
        """The k rows before this one."""
        return self.rows(-k, -1)

    def following(self, k: int) -> WindowSpec:
        return self.rows(1, k)

    def so_far(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0)


def guarded(value: Column, c: Column | str, frame: WindowSpec, least: int) -> Column:
    """``value`` over the frame where it holds at least ``least`` values of ``c``, else null."""
    return F.when(F.count(col(c)).over(frame) >= least, value.over(frame))


def session_number(s: Series) -> Column:
    """1 for the first row of each key, then counting up."""
    return F.row_number().over(s.window())


def shifted(s: Series, c: Column | str, k: int) -> Column:
    """The value k rows before (after, for k below 0)."""
    return F.lag(col(c), k).over(s.window()) if k >= 0 else F.lead(col(c), -k).over(s.window())


def difference(s: Series, c: Column | str, k: int = 1) -> Column:
    return col(c) - shifted(s, c, k)


def log_return(s: Series, p: Column | str) -> Column:
    """ln p less that of the row before; null next to a missing price, which is not bridged."""
    return F.ln(col(p)) - F.lag(F.ln(col(p))).over(s.window())


def momentum(s: Series, p: Column | str, k: int) -> Column:
    return F.ln(ratio(p, shifted(s, p, k)))


def rolling(s: Series, c: Column | str, k: int, how: str = "avg", least: int | None = None) -> Column:
    """avg, sum, max, min, median, stddev_samp or stddev_pop of the last k rows."""
    return guarded(getattr(F, how)(col(c)), c, s.trailing(k), k if least is None else least)


def causal_z(s: Series, c: Column | str, k: int, least: int, limit: float = 10.0) -> Column:
    """Today's value against mean and deviation of the k rows before it, clipped; null for too few rows or no deviation."""
    frame = s.preceding(k)
    sd = F.nullif(F.stddev_samp(col(c)).over(frame), F.lit(0.0))
    return F.when(F.count(col(c)).over(frame) >= least, clip((col(c) - F.avg(col(c)).over(frame)) / sd, -limit, limit))


def annual_volatility(s: Series, r: Column | str, k: int = 20) -> Column:
    return rolling(s, r, k, "stddev_samp") * F.sqrt(F.lit(float(SESSIONS_PER_YEAR)))


def downside_volatility(s: Series, r: Column | str, k: int = 20) -> Column:
    """Annual volatility of the moves with those above 0 taken as 0."""
    return annual_volatility(s, clip(r, high=0.0), k)


def drawdown(s: Series, p: Column | str, k: int) -> Column:
    """The price against the highest of the last k rows, less 1."""
    return col(p) / rolling(s, p, k, "max") - 1


def ratio_to_mean(s: Series, c: Column | str, k: int) -> Column:
    return ratio(c, rolling(s, c, k))


def variation(s: Series, c: Column | str, k: int) -> Column:
    """Coefficient of variation of the last k rows."""
    return ratio(rolling(s, c, k, "stddev_samp"), rolling(s, c, k))


def forward_loss(s: Series, p: Column | str, loss: float, h: int = 20) -> Column:
    """1 if the lowest of the next h prices is at least ``loss`` below this one, else 0; null for the last h rows."""
    low = guarded(F.min(col(p)), p, s.following(h), h)
    return F.when(low.isNotNull() & col(p).isNotNull(), (low / col(p) - 1 <= -loss).cast("int"))


def label_end(s: Series, h: int = 20) -> Column:
    """The date on which the label of this row is known."""
    return F.lead(s.order if isinstance(s.order, str) else s.order[0], h).over(s.window())


def last_known(s: Series, c: Column | str, most: int | None = None) -> Column:
    """The last value up to this row, from at most ``most`` rows before it."""
    return F.last(col(c), ignorenulls=True).over(s.so_far() if most is None else s.rows(-most, 0))


def run_starts(s: Series, flag: Column | str) -> Column:
    """1 where a run of true rows begins, 0 elsewhere."""
    f = F.coalesce(col(flag), F.lit(False))
    return (f & ~F.coalesce(F.lag(f).over(s.window()), F.lit(False))).cast("int")


def gap_starts(s: Series, days: int) -> Column:
    """1 where more than ``days`` calendar days lie between this row and the one before, and at the first row."""
    d = s.order if isinstance(s.order, str) else s.order[0]
    gap = F.datediff(F.col(d), F.lag(d).over(s.window()))
    return (gap.isNull() | (gap > days)).cast("int")
