"""Episodes, drawdown events and the leads of alarms before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeline import Series, gap_starts, run_starts
from .calendars import window_before


def episodes(rows: DataFrame, keys: Sequence[str], flag: str, order: str = "date", positive: str | None = None) -> DataFrame:
    """Runs of consecutive rows with a true ``flag``: keys, episode, first, last, rows, and whether a positive lies inside."""
    s = Series(keys, order)
    numbered = rows.withColumn("episode", F.sum(run_starts(s, flag)).over(s.so_far())).filter(F.col(flag))
    inside = [F.max(F.coalesce(F.col(positive), F.lit(0))).alias("positive")] if positive else []
    return numbered.groupBy(*keys, "episode").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("rows"), *inside)


def gap_sessions(rows: DataFrame, keys: Sequence[str], days: int = 3, order: str = "date") -> DataFrame:
    """Rows with ``session``, counting up where more than ``days`` calendar days lie between a row and the one before."""
    s = Series(keys, order)
    return rows.withColumn("__new", gap_starts(s, days)).withColumn("session", F.sum("__new").over(s.so_far())).drop("__new")


def drawdown_events(prices: DataFrame, keys: Sequence[str], price: str, loss: float = 0.10, order: str = "date") -> DataFrame:
    """Falls of ``loss`` from a high: keys, event, peak, onset, peak_price, recovery, censored.

    A spell lasts from one high-water mark to the next; its onset is the first row at least ``loss`` below the mark. The
    recovery is the next mark, or the last row for a spell still open, which is censored. Null prices are left out.
    """
    s = Series(keys, order)
    high = prices.filter(F.col(price).isNotNull()).withColumn("__hw", F.max(price).over(s.so_far()))
    spell = high.withColumn("__spell", F.sum((F.col(price) == F.col("__hw")).cast("int")).over(s.so_far()))
    each = spell.groupBy(*keys, "__spell").agg(
        F.min(order).alias("peak"),
        F.min(F.when(F.col(price) / F.col("__hw") - 1 <= -loss, F.col(order))).alias("onset"),
        F.max("__hw").alias("peak_price"),
        F.max(order).alias("__last"),
    )
    w = Window.partitionBy(*keys).orderBy("__spell")
    after = F.lead("peak").over(w)
    found = each.withColumns({"recovery": F.coalesce(after, F.col("__last")), "censored": after.isNull()}).filter("onset is not null")
    return found.withColumn("event", F.row_number().over(w)).select(*keys, "event", "peak", "onset", "peak_price", "recovery", "censored")


def event_leads(scores: DataFrame, events: DataFrame, calendar: DataFrame, keys: Sequence[str], rows: int = 20) -> DataFrame:
    """For each event: alarm days and first alarm among the ``rows`` sessions strictly before its onset, and the lead in sessions.

    ``scores`` has keys, date, score, alarm; ``calendar`` keys, date, session. Only events with an onset within the
    scored dates count; ``fully_observed`` tells whether all ``rows`` sessions are scored; misses have a null lead.
    """
    span = scores.groupBy(*keys).agg(F.min("date").alias("__from"), F.max("date").alias("__to"))
    at = events.join(calendar.select(*keys, F.col("date").alias("onset"), F.col("session").alias("__onset")), [*keys, "onset"])
    at = at.join(span, [*keys]).filter("onset between __from and __to").select(*keys, "event", "onset", "peak", "censored", "__onset")
    days = window_before(at, calendar, keys, "__onset", rows).join(scores.select(*keys, "date", "score", "alarm"), [*keys, "date"], "left")
    out = days.groupBy(*keys, "event", "onset", "peak", "censored", "__onset").agg(
        F.count("score").alias("observed"),
        F.coalesce(F.sum(F.col("alarm").cast("int")), F.lit(0)).cast("int").alias("alarm_days"),
        F.min(F.when(F.col("alarm"), F.col("date"))).alias("first_alarm"),
        F.min(F.when(F.col("alarm"), F.col("session"))).alias("__first"),
    )
    return out.withColumns({"fully_observed": F.col("observed") == rows, "lead_sessions": F.col("__onset") - F.col("__first")}).drop("__onset", "__first", "observed")


def event_summary(leads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Over fully observed events: number, detected, median lead and recall."""
    return leads.filter("fully_observed").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count("lead_sessions").alias("detected"), F.median("lead_sessions").alias("median_lead"), (F.count("lead_sessions") / F.count(F.lit(1))).alias("recall")
    )


def label_episodes(rows: DataFrame, keys: Sequence[str], label: str = "label", alarm: str = "alarm", order: str = "date") -> DataFrame:
    """Runs of label 1 and whether, and when first, an alarm fell inside."""
    s = Series(keys, order)
    flag = F.coalesce(F.col(label) == 1, F.lit(False))
    numbered = rows.withColumn("__f", flag).withColumn("episode", F.sum(run_starts(s, "__f")).over(s.so_far())).filter("__f")
    return numbered.groupBy(*keys, "episode").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max(F.coalesce(F.col(alarm), F.lit(False))).alias("detected"), F.min(F.when(F.col(alarm), F.col(order))).alias("first_alarm"))
