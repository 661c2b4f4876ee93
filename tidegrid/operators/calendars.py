"""Session calendars, alignment, as-of lookups and dated membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeline import Series, last_known, session_number


def sessions(readings: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The distinct dates of each key with their number from 1."""
    return readings.select(*keys, date).distinct().withColumn("session", session_number(Series(keys, date)))


def align(calendar: DataFrame, readings: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row of the calendar with its reading or nulls; readings off the calendar are dropped."""
    return calendar.join(readings, list(on), "left")


def as_of(calendar: DataFrame, readings: DataFrame, keys: Sequence[str], values: Sequence[str], date: str = "date") -> DataFrame:
    """Each calendar row with the last value of each of ``values`` dated on or before it, unbounded.

    Calendar and readings are laid under one another and filled forward, which needs one exchange by key and no range
    join. A reading on the very day counts. Rows of the calendar are kept one to one.
    """
    s = Series([*keys], [date, "__asked"])
    both = readings.select(*keys, date, *values, F.lit(0).alias("__asked")).unionByName(calendar.withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    filled = both.withColumns({v: last_known(s, v) for v in values})
    return filled.filter("__asked = 1").select(*calendar.columns, *(v for v in values if v not in calendar.columns))


def as_of_bounded(aligned: DataFrame, keys: Sequence[str], value: str, most: int = 5, lag: int = 1, date: str = "date") -> Column:
    """On calendar rows: the last value from at most ``most`` rows back, seen ``lag`` rows later."""
    s = Series(keys, date)
    return F.lag(last_known(s, value, most), lag).over(s.window())


def nearest(questions: DataFrame, readings: DataFrame, keys: Sequence[str], value: str, date: str = "date") -> DataFrame:
    """Each question with the value of the reading nearest in days; of two as near the earlier one. Null without readings.

    The nearest is the last reading before or the first one after, both found by windows over the union.
    """
    w = Window.partitionBy(*keys).orderBy(date, "__asked")
    r = F.when(F.col("__asked") == 0, F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    both = readings.select(*keys, date, value, F.lit(0).alias("__asked")).unionByName(questions.withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    before = F.last(r, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc(date), F.desc("__asked"))  # a running frame in the other order; one that looks ahead costs the square
    after = F.last(r, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    x = both.withColumns({"__b": before, "__a": after}).filter("__asked = 1")
    take_before = F.col("__a").isNull() | (F.datediff(F.col(date), F.col("__b.d")) <= F.datediff(F.col("__a.d"), F.col(date)))
    return x.withColumn(value, F.when(F.col("__b").isNotNull() & take_before, F.col("__b.v")).otherwise(F.col("__a.v"))).withColumn(
        "nearest_date", F.when(F.col("__b").isNotNull() & take_before, F.col("__b.d")).otherwise(F.col("__a.d"))
    ).select(*questions.columns, value, "nearest_date")


def membership_intervals(members: DataFrame, snapshots: DataFrame, entity: Sequence[str], key: str, date: str = "date") -> DataFrame:
    """Entity, key, ``start`` and ``end_exclusive`` (null while open): the unbroken stretches of snapshots that hold the key.

    ``members`` has the distinct (entity, date, key), ``snapshots`` the distinct (entity, date). Snapshots are numbered;
    consecutive numbers of a key less their rank are equal within a stretch.
    """
    numbered = snapshots.withColumns({"n": session_number(Series(entity, date)), "next": F.lead(date).over(Window.partitionBy(*entity).orderBy(date))})
    rows = members.join(numbered, [*entity, date]).withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy(*entity, key).orderBy(date)))
    return rows.groupBy(*entity, key, "island").agg(F.min(date).alias("start"), F.max_by("next", date).alias("end_exclusive")).drop("island")


def window_before(events: DataFrame, calendar: DataFrame, keys: Sequence[str], onset: str, rows: int = 20) -> DataFrame:
    """Each event with the ``rows`` sessions strictly before its onset session: an equi-join on exploded session numbers."""
    asked = events.withColumn("session", F.explode(F.sequence(F.greatest(F.col(onset) - rows, F.lit(1)), F.col(onset) - 1))).filter((F.col("session") >= 1) & (F.col("session") < F.col(onset)))
    return asked.join(calendar, [*keys, "session"])


def latest_resolved(panel: DataFrame, keys: Sequence[str], values: Sequence[str], date: str, resolved: str, take: int = 252) -> DataFrame:
    """For each row of ``panel``: the number and the mean of ``values`` over the last ``take`` rows (by date) whose label was resolved before its date.

    Labels are resolved in the order of their dates, so that the rows resolved before a day are a prefix of the series.
    The end of that prefix is found by a window over dates and resolutions laid under one another, and a frame
    over running sums gives the rest; no range join.
    """
    s = Series(keys, date)
    numbered = panel.withColumn("__n", session_number(s))
    for v in values:
        numbered = numbered.withColumn(f"__c_{v}", F.sum(v).over(s.so_far()))
    asked = numbered.select(*keys, F.col(date).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("int").alias("__end"), F.col("__n").alias("__row"))
    known = numbered.filter(F.col(resolved).isNotNull()).select(*keys, F.col(resolved).alias("__at"), F.lit(1).alias("__kind"), F.col("__n").cast("int").alias("__end"), F.lit(None).cast("int").alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = asked.unionByName(known).withColumn("__last", F.coalesce(F.max("__end").over(w), F.lit(0))).filter("__kind = 0").select(*keys, F.col("__row").alias("__n"), "__last")
    sums = numbered.select(*keys, F.col("__n").alias("__last"), *(F.col(f"__c_{v}").alias(f"__hi_{v}") for v in values))
    lows = numbered.select(*keys, F.col("__n").alias("__low"), *(F.col(f"__c_{v}").alias(f"__lo_{v}") for v in values))
    out = numbered.join(ends, [*keys, "__n"]).withColumn("__low", F.greatest(F.col("__last") - take, F.lit(0)))
    out = out.join(sums, [*keys, "__last"], "left").join(lows, [*keys, "__low"], "left").withColumn("known", F.col("__last") - F.col("__low"))
    means = {f"mean_{v}": F.try_divide(F.coalesce(F.col(f"__hi_{v}"), F.lit(0)) - F.coalesce(F.col(f"__lo_{v}"), F.lit(0)), F.col("known")) for v in values}
    return out.withColumns(means).select(*panel.columns, "known", *means)
