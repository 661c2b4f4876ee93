"""Base tables that the queries share, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeline import Series, drawdown, forward_loss, label_end, rolling
from ..operators import asof, calendars, panels, rolling as trailing
from ..operators.grid import feed_readings
from ..sources.tables import table
from .problems import _PARTS as PARTS_SQL, _PRICE as PRICE_SQL

Query = Callable[[SparkSession, str], DataFrame]
FEED, REV, BASKET = Series(["feed"]), Series(["k"]), ["basket"]
HORIZON, LOSS = 20, 0.05


class Catalogue:
    """Queries by name with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def text_date(c: str = "date", name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)


def spy(spark: SparkSession, d: str) -> DataFrame:
    """feed, date, p: the last received usable SPY close."""
    return feed_readings(table(spark, d, "markets"), table(spark, d, "vix")).filter("series = 'SPY'").select("feed", "date", F.col("value").alias("p"))


SPY = """spy AS (SELECT feed, date, arg_max(SPY, (received_at, SPY)) AS p FROM markets WHERE SPY > 0 AND isfinite(SPY) AND feed IS NOT NULL AND date IS NOT NULL GROUP BY feed, date)"""


def vix_daily(spark: SparkSession, d: str) -> DataFrame:
    """feed, date, v: the last read usable volatility."""
    return feed_readings(table(spark, d, "markets"), table(spark, d, "vix")).filter("series = 'VIX'").select("feed", "date", F.col("value").alias("v"))


VIX = """vixd AS (SELECT feed, "DATE" AS date, arg_max("CLOSE", (read_at, received_at, "CLOSE")) AS v FROM vix WHERE "CLOSE" > 0 AND isfinite("CLOSE") AND feed IS NOT NULL AND "DATE" IS NOT NULL GROUP BY feed, "DATE")"""


def revenue(spark: SparkSession, d: str) -> DataFrame:
    """k, date, p: daily revenue by order priority, smoothed over 60 rows."""
    daily = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return daily.select("k", "date", F.round(rolling(REV, "v", 60), 6).alias("p")).filter("p is not null")


REVENUE = """rev0 AS (SELECT o_orderpriority AS k, o_orderdate::DATE AS date, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL),
rev AS (SELECT k, date, round(avg(v) OVER w, 6) AS p FROM rev0 WINDOW w AS (PARTITION BY k ORDER BY date ROWS 59 PRECEDING) QUALIFY count(*) OVER w >= 60)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """k, date, p, label, label_end, score (trailing drawdown), alarm (score above 0.05); rows with a score."""
    x = revenue(spark, d).withColumns({"label": forward_loss(REV, "p", LOSS, HORIZON), "label_end": label_end(REV, HORIZON), "score": F.round(-drawdown(REV, "p", 60), 6)})
    return x.filter("score is not null").withColumn("alarm", F.col("score") > 0.05)


SCORED = (
    REVENUE
    + f""", lab AS (SELECT k, date, p, CASE WHEN count(p) OVER f = {HORIZON} THEN (min(p) OVER f / p - 1 <= -{LOSS})::INT END AS label, lead(date, {HORIZON}) OVER (PARTITION BY k ORDER BY date) AS label_end,
CASE WHEN count(p) OVER b = 60 THEN round(-(p / max(p) OVER b - 1), 6) END AS score FROM rev
WINDOW f AS (PARTITION BY k ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING), b AS (PARTITION BY k ORDER BY date ROWS 59 PRECEDING)),
ev AS (SELECT *, score > 0.05 AS alarm FROM lab WHERE score IS NOT NULL)"""
)


def price_panel(spark: SparkSession, d: str, dates: bool = False) -> DataFrame:
    """basket, symbol, session, date, p, r: every member on every session of its basket; ``date`` is null where p is, unless asked for."""
    daily = daily_prices(spark, d)
    return panels.returns(panels.dense_panel(daily, BASKET, "symbol", "p", dates=dates), BASKET, "symbol", "p")


PANEL = (
    PRICE_SQL
    + """, cal AS (SELECT basket, date, row_number() OVER (PARTITION BY basket ORDER BY date) AS session FROM (SELECT DISTINCT basket, date FROM valid)),
span AS (SELECT basket, symbol, min(date) AS a, max(date) AS z FROM valid GROUP BY ALL),
panel0 AS (SELECT s.basket, s.symbol, c.session, c.date, v.p FROM span s JOIN cal c ON c.basket = s.basket AND c.date BETWEEN s.a AND s.z LEFT JOIN valid v ON v.basket = s.basket AND v.symbol = s.symbol AND v.date = c.date),
panel AS (SELECT *, ln(p) - lag(ln(p)) OVER (PARTITION BY basket, symbol ORDER BY session) AS r FROM panel0)"""
)


def daily_prices(spark: SparkSession, d: str) -> DataFrame:
    return trailing.valid_daily(table(spark, d, "prices")).withColumnRenamed("value", "p")


def basket_spans(spark: SparkSession, d: str) -> DataFrame:
    """basket, symbol, first, last: the sessions on which a name was a member as known that day."""
    return asof.member_spans(calendars.sessions(daily_prices(spark, d), BASKET), table(spark, d, "membership"))


def basket_members(spark: SparkSession, d: str) -> DataFrame:
    """basket, symbol, session, date: the members of each basket on each of its sessions as known that day."""
    return asof.members_by_session(calendars.sessions(daily_prices(spark, d), BASKET), basket_spans(spark, d))


def member_panel(spark: SparkSession, d: str) -> DataFrame:
    """``price_panel`` with ``member_now``."""
    return panels.with_members(price_panel(spark, d), basket_spans(spark, d), BASKET, "symbol")


MEMBERS = f"""{PARTS_SQL}, best AS (SELECT c.basket, c.session, c.date, arg_max(m.snapshot_id, (m.date, m.received_at, m.snapshot_id)) AS snapshot_id
FROM cal c JOIN full_parts m ON m.basket = c.basket AND m.date <= c.date AND m.received_at < c.date + INTERVAL 1 DAY GROUP BY ALL),
named AS (SELECT DISTINCT snapshot_id, unnest(names) AS symbol FROM full_parts), members AS (SELECT b.basket, b.session, b.date, n.symbol FROM best b JOIN named n USING (snapshot_id)),
listed AS (SELECT DISTINCT basket, symbol FROM last_px WHERE basket IS NOT NULL)"""
DAY = "strftime(date, '%Y-%m-%d') AS date"


def by_key(keys: list[str]):
    return Window.partitionBy(*keys)
