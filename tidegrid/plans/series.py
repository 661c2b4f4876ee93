"""Queries of series operators: alignment, as-of lookups, rolling features, labels, episodes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeline as t
from ..functions.values import capped_magnitude
from ..operators import calendars, islands, panels
from ..sources.tables import table
from .bases import BASKET, DAY, FEED, PANEL, REV, REVENUE, SCORED, SPY, VIX, Catalogue, daily_prices, price_panel, revenue, scored, spy, text_date, vix_daily

cat = Catalogue()


def feature(sql: str):
    """Registers a query that gives feed, date and x, rounded, of the SPY series; ``sql`` is x over the table spy with windows of it."""
    return cat.add(f"WITH {SPY}, f AS (SELECT feed, date, p, ln(p) - lag(ln(p)) OVER w AS r FROM spy WINDOW w AS (PARTITION BY feed ORDER BY date)) SELECT feed, {DAY}, round({sql}, 9) AS x FROM f WINDOW w AS (PARTITION BY feed ORDER BY date), w5 AS (w ROWS 4 PRECEDING), w20 AS (w ROWS 19 PRECEDING), w60 AS (w ROWS 59 PRECEDING)")


def shown(df, x):
    return df.select("feed", text_date(), F.round(x, 9).alias("x"))


def with_returns(spark, d):
    return spy(spark, d).withColumn("r", t.log_return(FEED, "p"))


@cat.add(f"WITH {SCORED} SELECT k, year(date)::INT AS year, count(label) AS labelled, coalesce(sum(label), 0)::BIGINT AS losses, round(avg(label), 9) AS rate FROM ev GROUP BY ALL")
def q_label_rate_by_year(spark, d):
    return scored(spark, d).groupBy("k", F.year("date").alias("year")).agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("losses"), F.round(F.avg("label"), 9).alias("rate"))


@cat.add(f"WITH {SPY}, {VIX}, cal AS (SELECT feed, date FROM spy) SELECT c.feed, strftime(c.date, '%Y-%m-%d') AS date, v.v FROM cal c LEFT JOIN vixd v USING (feed, date)")
def q_calendar_align(spark, d):
    return calendars.align(spy(spark, d).select("feed", "date"), vix_daily(spark, d), ["feed", "date"]).select("feed", text_date(), "v")


@cat.add(f"""WITH {SPY}, {VIX} SELECT s.feed, strftime(s.date, '%Y-%m-%d') AS date, y.T10Y2Y AS x, v.v FROM spy s ASOF LEFT JOIN (SELECT * FROM vixd) v ON v.feed = s.feed AND v.date <= s.date
ASOF LEFT JOIN (SELECT date, T10Y2Y FROM yield_curve WHERE T10Y2Y IS NOT NULL AND isfinite(T10Y2Y)) y ON y.date <= s.date""")
def q_asof_backward(spark, d):
    """The last volatility of the feed and the last term spread of all on or before each session."""
    first = calendars.as_of(spy(spark, d).select("feed", "date"), vix_daily(spark, d), ["feed"], ["v"])
    # the spread has one value a day for all feeds: it is matched to the distinct dates, then joined on them
    spread = table(spark, d, "yield_curve").filter("T10Y2Y is not null and not isnan(T10Y2Y)").select("date", F.col("T10Y2Y").alias("x"), F.year("date").alias("one") * 0)
    days = first.select("date").distinct().withColumn("one", F.lit(0))
    return first.join(calendars.as_of(days, spread.select("date", "x", F.lit(0).alias("one")), ["one"], ["x"]).drop("one"), "date", "left").select("feed", text_date(), "x", "v")


@cat.add(f"""WITH {SPY}, {VIX}, a AS (SELECT s.feed, s.date, v.v FROM spy s LEFT JOIN vixd v USING (feed, date)),
b AS (SELECT feed, date, last_value(v IGNORE NULLS) OVER (PARTITION BY feed ORDER BY date ROWS 5 PRECEDING) AS f FROM a)
SELECT feed, {DAY}, lag(f) OVER (PARTITION BY feed ORDER BY date) AS v FROM b""")
def q_asof_bounded5(spark, d):
    aligned = calendars.align(spy(spark, d).select("feed", "date"), vix_daily(spark, d), ["feed", "date"])
    return aligned.select("feed", text_date(), calendars.as_of_bounded(aligned, ["feed"], "v").alias("v"))


@cat.add(f"""WITH {SPY}, {VIX}, b AS (SELECT s.feed, s.date, v.v AS bv, v.date AS bd FROM spy s ASOF LEFT JOIN vixd v ON v.feed = s.feed AND v.date <= s.date),
a AS (SELECT s.feed, s.date, v.v AS av, v.date AS ad FROM spy s ASOF LEFT JOIN vixd v ON v.feed = s.feed AND v.date >= s.date)
SELECT b.feed, strftime(b.date, '%Y-%m-%d') AS date, CASE WHEN bd IS NOT NULL AND (ad IS NULL OR b.date - bd <= ad - b.date) THEN bv ELSE av END AS v,
strftime(CASE WHEN bd IS NOT NULL AND (ad IS NULL OR b.date - bd <= ad - b.date) THEN bd ELSE ad END, '%Y-%m-%d') AS nearest_date FROM b JOIN a USING (feed, date)""")
def q_asof_nearest(spark, d):
    return calendars.nearest(spy(spark, d).select("feed", "date"), vix_daily(spark, d), ["feed"], "v").select("feed", text_date(), "v", text_date("nearest_date"))


@feature("r")
def q_log_return(spark, d):
    x = with_returns(spark, d)
    return shown(x, F.col("r"))


@feature("p - lag(p, 5) OVER w")
def q_difference5(spark, d):
    x = spy(spark, d)
    return shown(x, t.difference(FEED, "p", 5))


@feature("CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END")
def q_rolling_vol(spark, d):
    x = with_returns(spark, d)
    return shown(x, t.annual_volatility(FEED, "r"))


@feature("CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(CASE WHEN r > 0 THEN 0 ELSE r END) OVER w20 * sqrt(252) END")
def q_downside_vol(spark, d):
    x = with_returns(spark, d)
    return shown(x, t.downside_volatility(FEED, "r"))


@feature("ln(p / lag(p, 20) OVER w)")
def q_momentum20(spark, d):
    x = spy(spark, d)
    return shown(x, t.momentum(FEED, "p", 20))


@feature("CASE WHEN count(p) OVER w60 = 60 THEN p / max(p) OVER w60 - 1 END")
def q_drawdown60(spark, d):
    x = spy(spark, d)
    return shown(x, t.drawdown(FEED, "p", 60))


@feature("CASE WHEN count(p) OVER w60 = 60 THEN p / avg(p) OVER w60 END")
def q_ratio60(spark, d):
    x = spy(spark, d)
    return shown(x, t.ratio_to_mean(FEED, "p", 60))


@feature("CASE WHEN count(p) OVER w60 = 60 THEN stddev_samp(p) OVER w60 / avg(p) OVER w60 END")
def q_variation60(spark, d):
    x = spy(spark, d)
    return shown(x, t.variation(FEED, "p", 60))


@feature("(p + lag(p) OVER w) / 2")
def q_rolling_pair_mean(spark, d):
    x = spy(spark, d)
    return shown(x, t.rolling(FEED, "p", 2))


def z_sql(k: int, least: int) -> str:
    return f"""WITH {SPY}, f AS (SELECT feed, date, p, count(p) OVER w AS n, avg(p) OVER w AS m, stddev_samp(p) OVER w AS s FROM spy WINDOW w AS (PARTITION BY feed ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING))
SELECT feed, {DAY}, round(CASE WHEN n >= {least} AND s <> 0 THEN greatest(-10, least(10, (p - m) / s)) END, 8) AS x FROM f"""


@cat.add(z_sql(60, 40))
def q_causal_z60(spark, d):
    x = spy(spark, d)
    return x.select("feed", text_date(), F.round(t.causal_z(FEED, "p", 60, 40), 8).alias("x"))


@cat.add(z_sql(252, 126))
def q_causal_z252(spark, d):
    x = spy(spark, d)
    return x.select("feed", text_date(), F.round(t.causal_z(FEED, "p", 252, 126), 8).alias("x"))


@cat.add(f"""WITH {SPY}, n AS (SELECT feed, date, p, row_number() OVER (PARTITION BY feed ORDER BY date) AS i FROM spy),
pairs AS (SELECT e.feed, e.date, sum(sign(b.p - a.p)) AS s, count(*) FILTER (b.p <> a.p) AS u FROM n e JOIN n a ON a.feed = e.feed AND a.i > e.i - 60 AND a.i <= e.i JOIN n b ON b.feed = e.feed AND b.i > a.i AND b.i <= e.i WHERE e.i >= 60 GROUP BY ALL)
SELECT n.feed, strftime(n.date, '%Y-%m-%d') AS date, round(s / nullif(sqrt(1770.0 * u), 0), 9) AS tau FROM n LEFT JOIN pairs USING (feed, date)""")
def q_kendall60(spark, d):
    return panels.kendall_trend(spy(spark, d), ["feed"], "p").select("feed", text_date(), F.round("tau", 9).alias("tau"))


@cat.add(f"""WITH {SPY}, {VIX}, a AS (SELECT s.feed, s.date, ln(s.p) AS y, v.v AS x FROM spy s LEFT JOIN vixd v USING (feed, date)),
b AS (SELECT *, CASE WHEN x IS NOT NULL THEN y END AS yy FROM a),
c AS (SELECT feed, date, y, x, regr_count(yy, x) OVER w AS n, regr_slope(yy, x) OVER w AS s, regr_intercept(yy, x) OVER w AS i FROM b WINDOW w AS (PARTITION BY feed ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT feed, {DAY}, round(CASE WHEN n >= 40 THEN y - i - s * x END, 7) AS residual FROM c""")
def q_rolling_ols_residual(spark, d):
    both = calendars.align(spy(spark, d), vix_daily(spark, d), ["feed", "date"]).withColumn("y", F.ln("p"))
    return panels.ols_residual(both, ["feed"], "y", ["v"]).select("feed", text_date(), F.round("residual", 7).alias("residual"))


def label_sql(loss: float, h: int) -> str:
    return f"""WITH {REVENUE} SELECT k, {DAY}, CASE WHEN count(p) OVER f = {h} THEN (min(p) OVER f / p - 1 <= -{loss})::INT END AS label, strftime(lead(date, {h}) OVER (PARTITION BY k ORDER BY date), '%Y-%m-%d') AS label_end
FROM rev WINDOW f AS (PARTITION BY k ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"""


def labels(spark, d, loss, h):
    return revenue(spark, d).select("k", "date", t.forward_loss(REV, "p", loss, h).alias("label"), t.label_end(REV, h).alias("e")).select("k", text_date(), "label", text_date("e", "label_end"))


@cat.add(label_sql(0.10, 20))
def q_forward_label_10(spark, d):
    return labels(spark, d, 0.10, 20)


@cat.add(label_sql(0.075, 20))
def q_forward_label_7(spark, d):
    return labels(spark, d, 0.075, 20)


@cat.add(label_sql(0.05, 60))
def q_forward_label_60(spark, d):
    return labels(spark, d, 0.05, 60)


EVENTS = """hw AS (SELECT k, date, p, max(p) OVER (PARTITION BY k ORDER BY date) AS h FROM rev), sp AS (SELECT *, sum((p = h)::INT) OVER (PARTITION BY k ORDER BY date) AS spell FROM hw),
es AS (SELECT k, spell, min(date) AS peak, min(date) FILTER (p / h - 1 <= -0.1) AS onset, max(h) AS peak_price, max(date) AS z FROM sp GROUP BY ALL),
ev0 AS (SELECT k, spell, peak, onset, peak_price, coalesce(lead(peak) OVER w, z) AS recovery, lead(peak) OVER w IS NULL AS censored FROM es WINDOW w AS (PARTITION BY k ORDER BY spell)),
events_ AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY spell) AS event, peak, onset, peak_price, recovery, censored FROM ev0 WHERE onset IS NOT NULL)"""


@cat.add(f"WITH {REVENUE}, {EVENTS} SELECT k, event::INT AS event, strftime(peak, '%Y-%m-%d') AS peak, strftime(onset, '%Y-%m-%d') AS onset, peak_price, strftime(recovery, '%Y-%m-%d') AS recovery, censored FROM events_")
def q_drawdown_events(spark, d):
    e = islands.drawdown_events(revenue(spark, d), ["k"], "p")
    return e.select("k", "event", text_date("peak"), text_date("onset"), "peak_price", text_date("recovery"), "censored")


LEADS = """cal AS (SELECT k, date, row_number() OVER (PARTITION BY k ORDER BY date) AS s FROM rev), span AS (SELECT k, min(date) AS a, max(date) AS z FROM ev GROUP BY k),
onsets AS (SELECT e.*, c.s AS os FROM events_ e JOIN cal c ON c.k = e.k AND c.date = e.onset JOIN span ON span.k = e.k AND e.onset BETWEEN span.a AND span.z),
leads AS (SELECT t.k, t.event, t.onset, t.peak, t.censored, count(x.score) = 20 AS fully_observed, count(*) FILTER (x.alarm) AS alarm_days, min(c.date) FILTER (x.alarm) AS first_alarm, t.os - min(c.s) FILTER (x.alarm) AS lead_sessions
FROM onsets t JOIN cal c ON c.k = t.k AND c.s BETWEEN t.os - 20 AND t.os - 1 LEFT JOIN ev x ON x.k = c.k AND x.date = c.date GROUP BY t.k, t.event, t.onset, t.peak, t.censored, t.os)"""


def leads(spark, d):
    s = scored(spark, d)
    calendar = calendars.sessions(revenue(spark, d), ["k"])
    return islands.event_leads(s, islands.drawdown_events(revenue(spark, d), ["k"], "p"), calendar, ["k"])


@cat.add(f"WITH {SCORED}, {EVENTS}, {LEADS} SELECT k, event::INT AS event, strftime(onset, '%Y-%m-%d') AS onset, fully_observed, alarm_days::INT AS alarm_days, strftime(first_alarm, '%Y-%m-%d') AS first_alarm, lead_sessions::INT AS lead_sessions FROM leads")
def q_event_leads(spark, d):
    return leads(spark, d).select("k", "event", text_date("onset"), "fully_observed", "alarm_days", text_date("first_alarm"), "lead_sessions")


@cat.add(f"WITH {SCORED}, {EVENTS}, {LEADS} SELECT k, count(*) AS events, count(lead_sessions) AS detected, median(lead_sessions) AS median_lead, count(lead_sessions) / count(*) AS recall FROM leads WHERE fully_observed GROUP BY k")
def q_event_summary(spark, d):
    return islands.event_summary(leads(spark, d), ["k"])


@cat.add(f"""WITH {SCORED}, {EVENTS}, cal AS (SELECT k, date, row_number() OVER (PARTITION BY k ORDER BY date) AS s FROM rev), pk AS (SELECT e.k, e.event, e.peak, c.s AS ps FROM events_ e JOIN cal c ON c.k = e.k AND c.date = e.peak)
SELECT p.k, p.event::INT AS event, strftime(p.peak, '%Y-%m-%d') AS peak, count(*) FILTER (x.alarm) AS alarm_days, (p.ps - min(c.s) FILTER (x.alarm))::INT AS lead_sessions FROM pk p JOIN cal c ON c.k = p.k AND c.s BETWEEN p.ps - 60 AND p.ps - 1 LEFT JOIN ev x ON x.k = c.k AND x.date = c.date GROUP BY p.k, p.event, p.peak, p.ps""")
def q_peak_leads(spark, d):
    """Alarms in the 60 sessions before each peak, and the lead of the first."""
    calendar = calendars.sessions(revenue(spark, d), ["k"])
    peaks = islands.drawdown_events(revenue(spark, d), ["k"], "p").select("k", "event", F.col("peak").alias("date")).join(calendar, ["k", "date"])
    peaks = peaks.select("k", "event", F.col("date").alias("peak"), F.col("session").alias("at"))
    days = calendars.window_before(peaks, calendar, ["k"], "at", 60).join(scored(spark, d).select("k", "date", "alarm"), ["k", "date"], "left")
    out = days.groupBy("k", "event", "peak", "at").agg(F.count_if("alarm").alias("alarm_days"), F.min(F.when(F.col("alarm"), F.col("session"))).alias("first"))
    return out.select("k", "event", text_date("peak"), "alarm_days", (F.col("at") - F.col("first")).alias("lead_sessions"))


@cat.add(f"""WITH {SCORED}, a AS (SELECT *, (alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY k ORDER BY date), false))::INT AS s FROM ev), b AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY date) AS e FROM a)
SELECT k, e::BIGINT AS episode, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, count(*) AS rows, max(coalesce(label, 0))::INT AS positive FROM b WHERE alarm GROUP BY k, e""")
def q_alarm_episodes(spark, d):
    return islands.episodes(scored(spark, d), ["k"], "alarm", positive="label").select("k", "episode", text_date("first"), text_date("last"), "rows", "positive")


@cat.add(f"""WITH {SCORED}, a AS (SELECT k, date, (coalesce(date - lag(date) OVER (PARTITION BY k ORDER BY date), 99) > 3)::INT AS s FROM ev WHERE alarm)
SELECT k, {DAY}, sum(s) OVER (PARTITION BY k ORDER BY date)::BIGINT AS session FROM a""")
def q_gap_sessions(spark, d):
    return islands.gap_sessions(scored(spark, d).filter("alarm").select("k", "date"), ["k"]).select("k", text_date(), "session")


@cat.add(f"""WITH {SCORED}, a AS (SELECT *, (label = 1 AND NOT coalesce(lag(label) OVER (PARTITION BY k ORDER BY date) = 1, false))::INT AS s FROM ev), b AS (SELECT *, sum(coalesce(s, 0)) OVER (PARTITION BY k ORDER BY date) AS e FROM a)
SELECT k, e::BIGINT AS episode, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, bool_or(alarm) AS detected, strftime(min(date) FILTER (alarm), '%Y-%m-%d') AS first_alarm FROM b WHERE label = 1 GROUP BY k, e""")
def q_label_episodes(spark, d):
    return islands.label_episodes(scored(spark, d), ["k"]).select("k", "episode", text_date("first"), text_date("last"), "detected", text_date("first_alarm"))


@cat.add(f"WITH {PANEL} SELECT basket, symbol, {DAY}, round(r, 9) AS r FROM panel WHERE abs(r) > 0.5")
def q_extreme_returns(spark, d):
    return price_panel(spark, d).filter(F.col("r").isNotNull() & capped_magnitude("r", 0.5).isNull()).select("basket", "symbol", text_date(), F.round("r", 9).alias("r"))


COMPLETE = """, marked AS (SELECT *, coalesce(count(r) OVER w = 60 AND stddev_pop(r) OVER w > 1e-12, false) AS complete FROM panel WINDOW w AS (PARTITION BY basket, symbol ORDER BY session ROWS 59 PRECEDING))"""


@cat.add(f"WITH {PANEL}{COMPLETE} SELECT basket, {DAY}, count(*) AS expected, count(p) AS priced, count(*) FILTER (complete) AS eligible, count(*) FILTER (NOT complete) AS excluded FROM marked GROUP BY basket, date")
def q_coverage_daily(spark, d):
    marked = panels.complete_windows(price_panel(spark, d), BASKET, "symbol")
    x = panels.coverage(marked, BASKET, "symbol", "p", "session")
    return x.join(calendars.sessions(daily_prices(spark, d), BASKET), [*BASKET, "session"]).select("basket", text_date(), "expected", "priced", "eligible", "excluded")


@cat.add(f"""WITH {PANEL}{COMPLETE}, c AS (SELECT basket, symbol, count(*) AS sessions, count(p) AS valid_prices, count(*) FILTER (complete) AS eligible_sessions, min(date) FILTER (p IS NOT NULL) AS a, max(date) FILTER (p IS NOT NULL) AS z FROM marked GROUP BY ALL)
SELECT basket, symbol, sessions, valid_prices, eligible_sessions, strftime(a, '%Y-%m-%d') AS first_valid, strftime(z, '%Y-%m-%d') AS last_valid, CASE WHEN eligible_sessions > 0 THEN 'used' WHEN valid_prices = 0 THEN 'no valid prices' ELSE 'no complete window' END AS status FROM c""")
def q_coverage_entity(spark, d):
    marked = panels.complete_windows(price_panel(spark, d), BASKET, "symbol")
    return panels.coverage(marked, BASKET, "symbol", "p", "member").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_valid", "last_valid")})


@cat.add(f"WITH {PANEL}{COMPLETE} SELECT basket, symbol, count(*) FILTER (complete) AS complete, count(*) FILTER (r IS NULL) AS broken FROM marked GROUP BY ALL")
def q_complete_window(spark, d):
    marked = panels.complete_windows(price_panel(spark, d), BASKET, "symbol")
    return marked.groupBy("basket", "symbol").agg(F.count_if("complete").alias("complete"), F.count_if(F.col("r").isNull()).alias("broken"))
