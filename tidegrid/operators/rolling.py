"""Totals and averages over trailing calendar periods, days without a row included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import canonical_symbol
from ..functions.values import positive


#: A series with more rows than this holds far more deliveries than days, and is combined before it is brought together.
CROWDED = 50_000
#: Up to so many crowded series are told apart by a list; beyond, every series is combined first.
MOST_CROWDED = 1_000


def last_daily(prices: DataFrame, crowded: int = CROWDED, most: int = MOST_CROWDED) -> DataFrame:
    """The last received price ``p`` of each (basket, canonical symbol, date), null if that was null; spread by (basket, symbol).

    Null keys count for nothing; a null moment of receipt is earlier than any. Of rows received at the same moment the
    greatest price holds (NaN is the greatest). One exchange by (basket, symbol) serves both groupings and every later window over the series. A series has one row a
    day after them, but may have any number of deliveries before: the rows of such crowded series, found by a count
    that is combined on the map side, are first reduced to one per day and moment where they lie.
    """
    keys = ["basket", "symbol", "date", "received_at"]
    moment = prices.schema["received_at"].dataType
    received = F.coalesce("received_at", F.lit("0001-01-01 00:00:00").cast(moment)).alias("received_at")
    rows = prices.select("basket", canonical_symbol("symbol").alias("symbol"), "date", "adjusted_close", received)
    rows = rows.filter("basket is not null and symbol is not null and date is not null")
    reduced = lambda df: df.groupBy(*keys).agg(F.max("adjusted_close").alias("adjusted_close")).groupBy(*keys[:3]).agg(F.max_by("adjusted_close", "received_at").alias("adjusted_close"), F.max("received_at").alias("received_at"))
    hot = crowded_series(prices, crowded, most)
    if len(hot) > most:
        rows = reduced(rows)
    elif hot:
        names = F.broadcast(prices.sparkSession.createDataFrame(hot, "basket string, symbol string"))
        rows = rows.join(names, ["basket", "symbol"], "left_anti").unionByName(reduced(rows.join(names, ["basket", "symbol"], "left_semi")))
    return (
        rows.repartition("basket", "symbol")
        .groupBy(*keys)
        .agg(F.max("adjusted_close").alias("p"))
        .groupBy("basket", "symbol", "date")
        .agg(F.max_by("p", "received_at").alias("p"))
    )


def crowded_series(prices: DataFrame, crowded: int, most: int) -> list[tuple[str, str]]:
    """Up to ``most`` + 1 (basket, canonical symbol) with more than ``crowded`` rows, however they are spelled.

    A crowded series lies in a basket with as many rows, so rows are first counted by a hash of the basket, which costs little;
    only if some hash has that many are the spellings counted, which are then summed up by their canonical form.
    """
    bucket = F.pmod(F.hash("basket"), F.lit(1 << 20))
    if not prices.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded).take(1):
        return []
    count = prices.groupBy("basket", "symbol").agg(F.count(F.lit(1)).alias("n"))
    found = count.groupBy("basket", canonical_symbol("symbol").alias("symbol")).agg(F.sum("n").alias("n"))
    found = found.filter((F.col("n") > crowded) & F.col("symbol").isNotNull() & F.col("basket").isNotNull())
    return [(r["basket"], r["symbol"]) for r in found.select("basket", "symbol").limit(most + 1).collect()]


def valid_daily(prices: DataFrame) -> DataFrame:
    """The last received price (``value``) of each (basket, canonical symbol, date) where it is finite and above 0."""
    return last_daily(prices).select("basket", "symbol", "date", positive("p").alias("value")).filter("value is not null")


def trailing_totals(daily: DataFrame, keys: Sequence[str], date: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For every key and calendar day between its first and last row: count, total and average of the trailing days.

    ``daily`` has at most one row per key and date, with a value that is not null. Each row is followed by the days up to
    the next one (the key's stretch of the calendar, without a join), so that a window of the last n days is a frame of
    n rows. Columns: keys, date, and for each n ``n_n``, ``total_n``, ``avg_n`` (total and average null where n_n is 0).
    """
    w = Window.partitionBy(*keys).orderBy(date)
    gap = F.coalesce(F.datediff(F.lead(date).over(w), F.col(date)), F.lit(1))
    dense = (
        daily.select(*keys, date, value, gap.alias("__gap"))
        .select(*keys, date, value, F.explode(F.sequence(F.lit(0), F.col("__gap") - 1)).alias("__k"))
        .select(*keys, F.date_add(date, F.col("__k")).alias(date), F.when(F.col("__k") == 0, F.col(value)).alias(value))
    )
    out = []
    for n in periods:
        frame = w.rowsBetween(-(n - 1), 0)
        out += [F.count(value).over(frame).alias(f"n_{n}"), F.sum(value).over(frame).alias(f"total_{n}"), F.avg(value).over(frame).alias(f"avg_{n}")]
    return dense.select(*keys, date, *out)


def undefined_days(totals: DataFrame, keys: Sequence[str], date: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """The days of ``trailing_totals`` whose average is undefined: keys, date, ``days``; a row for each such period."""
    days = F.filter(F.array(*(F.when(F.col(f"n_{n}") == 0, F.lit(n)) for n in periods)), lambda d: d.isNotNull())
    return totals.filter(" or ".join(f"n_{n} = 0" for n in periods)).select(*keys, date, F.explode(days).alias("days"))
