"""Queries that assemble operators into the parts of a study: feature panels, ledgers, choices, sensitivity and verification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timeline as t
from ..functions.symbols import canonical_symbol
from ..functions.values import capped_magnitude
from ..operators import asof, calendars, evaluate, models, panels, rolling
from ..operators.features import assemble, dynamics, enhanced, registry, with_coverage
from ..sources import contracts
from ..sources.tables import table
from .bases import BASKET, DAY, FEED, MEMBERS, PANEL, SCORED, SPY, VIX, Catalogue, basket_members, daily_prices, member_panel, price_panel, scored, spy, text_date, vix_daily
from .evaluation import GROUPS, features, rank_sql, rounded
from .problems import _PRICE
from .series import COMPLETE
from .topology import WINDOWS

cat = Catalogue()


@cat.add(f"""WITH {SPY}, {VIX}, a AS (SELECT s.feed, s.date, s.p, ln(s.p) - lag(ln(s.p)) OVER w AS r, v.v FROM spy s LEFT JOIN vixd v USING (feed, date) WINDOW w AS (PARTITION BY s.feed ORDER BY s.date)),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY feed ORDER BY date ROWS 5 PRECEDING) AS f FROM a), c AS (SELECT *, lag(f) OVER (PARTITION BY feed ORDER BY date) AS vix FROM b),
e AS (SELECT feed, date, ln(p / lag(p, 5) OVER w) AS mom5, ln(p / lag(p, 20) OVER w) AS mom20, CASE WHEN count(p) OVER w60 = 60 THEN p / max(p) OVER w60 - 1 END AS dd60, CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(r) OVER w20 * sqrt(252) END AS vol20,
CASE WHEN count(r) OVER w20 = 20 THEN stddev_samp(least(r, 0)) OVER w20 * sqrt(252) END AS down20, vix, ln(vix) - lag(ln(vix), 5) OVER w AS vix5, CASE WHEN count(vix) OVER w60 = 60 THEN vix / avg(vix) OVER w60 END AS vix_ratio FROM c
WINDOW w AS (PARTITION BY feed ORDER BY date), w20 AS (w ROWS 19 PRECEDING), w60 AS (w ROWS 59 PRECEDING))
SELECT feed, {DAY}, round(mom5, 8) AS mom5, round(mom20, 8) AS mom20, round(dd60, 8) AS dd60, round(vol20, 8) AS vol20, round(down20, 8) AS down20, vix, round(vix5, 8) AS vix5, round(vix_ratio, 8) AS vix_ratio FROM e
WHERE mom5 IS NOT NULL AND mom20 IS NOT NULL AND dd60 IS NOT NULL AND vol20 IS NOT NULL AND down20 IS NOT NULL AND vix IS NOT NULL AND vix5 IS NOT NULL AND vix_ratio IS NOT NULL""")
def q_feature_panel(spark, d):
    """Market and volatility features of each feed joined by date, complete rows only."""
    x = calendars.align(spy(spark, d), vix_daily(spark, d), ["feed", "date"])
    x = x.withColumn("vix", calendars.as_of_bounded(x, ["feed"], "v")).withColumn("r", t.log_return(FEED, "p"))
    x = x.withColumns({
        "mom5": t.momentum(FEED, "p", 5), "mom20": t.momentum(FEED, "p", 20), "dd60": t.drawdown(FEED, "p", 60), "vol20": t.annual_volatility(FEED, "r"), "down20": t.downside_volatility(FEED, "r"),
        "vix5": t.difference(FEED, F.ln("vix"), 5), "vix_ratio": t.ratio_to_mean(FEED, "vix", 60),
    })
    names = ["mom5", "mom20", "dd60", "vol20", "down20", "vix5", "vix_ratio"]
    return rounded(x.select("feed", text_date(), *names, "vix").dropna(), *names, digits=8)


@cat.add(f"""WITH {PANEL}{COMPLETE} SELECT basket, symbol, {DAY}, CASE WHEN p IS NULL THEN 'missing price' WHEN count(r) OVER w < 60 THEN 'incomplete window' ELSE 'constant window' END AS reason FROM marked WINDOW w AS (PARTITION BY basket, symbol ORDER BY session ROWS 59 PRECEDING) QUALIFY NOT complete""")
def q_exclusion_ledger(spark, d):
    """Why a member has no part in a session's window."""
    s = t.Series(["basket", "symbol"], "session")
    x = panels.complete_windows(price_panel(spark, d, dates=True), BASKET, "symbol").withColumn("n", F.count("r").over(s.trailing(60))).filter("not complete")
    reason = F.when(F.col("p").isNull(), "missing price").when(F.col("n") < 60, "incomplete window").otherwise("constant window")
    return x.select("basket", "symbol", text_date(), reason.alias("reason"))


STATUS = f""", {MEMBERS}, status AS (SELECT m.*, CASE WHEN l.symbol IS NULL THEN '{panels.UNRESOLVED}' WHEN NOT coalesce(k.complete, false) THEN '{panels.INCOMPLETE}' END AS reason
FROM members m LEFT JOIN listed l USING (basket, symbol) LEFT JOIN marked k USING (basket, symbol, session) WHERE m.session > 60)"""


def member_status(spark, d):
    """Every member of every session that has 60 returns behind it, with the reason for which it has no part in the window."""
    marked = panels.complete_windows(price_panel(spark, d), BASKET, "symbol")
    listed = rolling.last_daily(table(spark, d, "prices")).select("basket", "symbol").distinct()
    return panels.member_status(basket_members(spark, d).filter("session > 60"), listed, marked, BASKET, "symbol")


@cat.add(f"WITH {PANEL}{COMPLETE}{STATUS} SELECT basket, symbol, {DAY}, reason FROM status WHERE reason IS NOT NULL")
def q_member_ledger(spark, d):
    """Why a member of that day has no part in a session's window, members without prices included."""
    return member_status(spark, d).filter("reason is not null").select("basket", "symbol", text_date(), "reason")


@cat.add(f"""WITH {PANEL}{COMPLETE}{STATUS} SELECT c.basket, strftime(c.date, '%Y-%m-%d') AS date, count(s.symbol) AS expected_members, count(s.symbol) FILTER (reason IS NULL OR reason <> '{panels.UNRESOLVED}') AS mapped, count(s.symbol) FILTER (reason IS NULL) AS eligible,
count(*) FILTER (reason = '{panels.UNRESOLVED}') AS missing_symbols, count(*) FILTER (reason = '{panels.INCOMPLETE}') AS excluded_incomplete_or_constant FROM cal c LEFT JOIN status s ON s.basket = c.basket AND s.session = c.session WHERE c.session > 60 GROUP BY c.basket, c.date""")
def q_member_coverage(spark, d):
    """Expected, mapped, eligible and missing members of every session that has 60 returns behind it."""
    calendar = calendars.sessions(daily_prices(spark, d), BASKET).filter("session > 60")
    return panels.member_coverage(calendar, member_status(spark, d), BASKET).drop("session").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@cat.add(f"""WITH {PANEL}{COMPLETE}, {MEMBERS} SELECT k.basket, k.symbol, count(m.symbol) AS member, count(*) FILTER (m.symbol IS NULL) AS former FROM marked k SEMI JOIN px USING (basket, symbol, date) LEFT JOIN members m ON m.basket = k.basket AND m.symbol = k.symbol AND m.session = k.session WHERE k.complete GROUP BY k.basket, k.symbol""")
def q_member_windows(spark, d):
    """Sessions on which a priced symbol with a complete window was a member as known that day, and on which it was not."""
    marked = panels.complete_windows(price_panel(spark, d), BASKET, "symbol").filter("complete").select("basket", "symbol", "date")
    known = asof.membership_as_known(table(spark, d, "prices"), table(spark, d, "membership"))
    x = marked.join(known, ["basket", "symbol", "date"])
    return x.groupBy("basket", "symbol").agg(F.count("present").alias("member"), F.count_if(F.col("present").isNull()).alias("former"))


ASSETS = f"""{PANEL}{COMPLETE}, {MEMBERS}, mk AS (SELECT m.*, k.p, coalesce(k.complete, false) AS ok FROM members m LEFT JOIN marked k USING (basket, symbol, session)),
own AS (SELECT basket, symbol, count(*) AS membership_sessions, min(date) AS fm, max(date) AS lm, count(p) AS overlap, count(*) FILTER (ok) AS eligible_sessions, max(session) AS ls FROM mk GROUP BY ALL),
ends AS (SELECT basket, max(session) AS z FROM cal GROUP BY basket), vp AS (SELECT basket, symbol, min(date) AS fv, max(date) AS lv FROM valid WHERE basket IS NOT NULL GROUP BY ALL)"""


@cat.add(f"""WITH {ASSETS} SELECT basket, symbol, l.symbol IS NOT NULL AS supplied, coalesce(membership_sessions, 0) AS membership_sessions, strftime(fm, '%Y-%m-%d') AS first_membership, strftime(lm, '%Y-%m-%d') AS last_membership, coalesce(overlap, 0) AS valid_prices_during_membership, coalesce(eligible_sessions, 0) AS eligible_sessions,
strftime(fv, '%Y-%m-%d') AS first_valid, strftime(lv, '%Y-%m-%d') AS last_valid, coalesce(ls = z, false) AS member_at_end, CASE WHEN eligible_sessions > 0 THEN 'used' WHEN membership_sessions IS NULL THEN 'no dated membership match' WHEN l.symbol IS NULL THEN 'missing price symbol' WHEN overlap = 0 THEN 'no valid prices during membership' ELSE 'no complete valid window' END AS status
FROM own FULL JOIN listed l USING (basket, symbol) LEFT JOIN vp USING (basket, symbol) LEFT JOIN ends USING (basket)""")
def q_asset_coverage(spark, d):
    """Every member and every priced symbol of each basket with its membership, prices, eligible sessions and one of five statuses."""
    x = asset_coverage(spark, d)
    return x.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_membership", "last_membership", "first_valid", "last_valid")})


def member_sessions(spark, d):
    return panels.member_sessions(basket_members(spark, d), panels.complete_windows(price_panel(spark, d), BASKET, "symbol"), BASKET, "symbol", "p")


def asset_coverage(spark, d):
    listed = rolling.last_daily(table(spark, d, "prices")).select("basket", "symbol").distinct()
    daily = daily_prices(spark, d)
    return panels.asset_coverage(member_sessions(spark, d), listed, daily, calendars.sessions(daily, BASKET), BASKET, "symbol")


@cat.add(f"""WITH {ASSETS} SELECT c.basket, strftime(c.date, '%Y-%m-%d') AS date, count(m.symbol) AS expected_members, count(l.symbol) AS matched_members, count(*) FILTER (m.ok) AS eligible_members, count(*) FILTER (m.ok AND o.ls < e.z) AS eligible_former_members
FROM cal c LEFT JOIN mk m ON m.basket = c.basket AND m.session = c.session LEFT JOIN listed l ON l.basket = m.basket AND l.symbol = m.symbol LEFT JOIN own o ON o.basket = m.basket AND o.symbol = m.symbol LEFT JOIN ends e ON e.basket = c.basket GROUP BY c.basket, c.date""")
def q_survivorship_daily(spark, d):
    """Members of each session that are expected, have prices and are eligible, and the eligible ones that have left by the end."""
    calendar = calendars.sessions(daily_prices(spark, d), BASKET)
    x = panels.survivorship(member_sessions(spark, d), asset_coverage(spark, d), calendar, BASKET, "symbol")
    return x.drop("session").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@cat.add(f"""WITH {PANEL}, {MEMBERS} SELECT p.basket, p.symbol, strftime(p.date, '%Y-%m-%d') AS date, round(p.r, 9) AS log_return, m.symbol IS NOT NULL AS member FROM panel p LEFT JOIN members m ON m.basket = p.basket AND m.symbol = p.symbol AND m.session = p.session WHERE abs(p.r) > 0.5""")
def q_extreme_returns(spark, d):
    """Returns beyond 0.5 with whether the symbol was a member on that day."""
    x = member_panel(spark, d).filter("abs(r) > 0.5")
    return x.select("basket", "symbol", text_date(), F.round("r", 9).alias("log_return"), F.col("member_now").alias("member"))


@cat.add(f"""WITH {_PRICE}, ref AS (SELECT basket, symbol, date, arg_min(p, (received_at, p)) AS reference FROM px WHERE basket IS NOT NULL AND p IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL),
st AS (SELECT r.basket, CASE WHEN v.p IS NULL THEN 'not_available' WHEN NOT abs(v.p - reference) <= 0.02 THEN 'mismatch' ELSE 'match' END AS status FROM ref r LEFT JOIN valid v USING (basket, symbol, date)) SELECT basket, status, count(*) AS n FROM st GROUP BY ALL""")
def q_spot_check(spark, d):
    """The first price delivered for each key against the one that holds: match within 0.02, mismatch or not available, counted by basket."""
    p = table(spark, d, "prices").select("basket", canonical_symbol("symbol").alias("symbol"), "date", "adjusted_close", "received_at").dropna(subset=["basket", "symbol", "date", "received_at"]).filter("adjusted_close is not null")
    first = p.groupBy("basket", "symbol", "date").agg(F.min_by("adjusted_close", F.struct("received_at", "adjusted_close")).alias("reference"))
    x = contracts.against_reference(daily_prices(spark, d), first, ["basket", "symbol", "date"], "p", "reference")
    return x.groupBy("basket", "status").agg(F.count(F.lit(1)).alias("n"))


@cat.add(f"WITH {PANEL}, m AS (SELECT *, CASE WHEN abs(r) <= 0.1 THEN r END AS q FROM panel) SELECT basket, symbol, count(r) AS returns, count(q) AS kept, round(stddev_samp(r), 9) AS plain, round(stddev_samp(q), 9) AS masked FROM m GROUP BY ALL")
def q_mask_sensitivity(spark, d):
    """Volatility of each member with and without its large returns."""
    x = price_panel(spark, d).withColumn("q", capped_magnitude("r", 0.1))
    return rounded(x.groupBy("basket", "symbol").agg(F.count("r").alias("returns"), F.count("q").alias("kept"), F.stddev_samp("r").alias("plain"), F.stddev_samp("q").alias("masked")), "plain", "masked")


SCALES = (20, 40, 60, 120, 180, 250)


@cat.add(f"""WITH {SCORED}, dd AS (SELECT k, date, label, {', '.join(f"CASE WHEN count(p) OVER w{n} = {n} THEN round(-(p / max(p) OVER w{n} - 1), 6) END AS s{n}" for n in SCALES)} FROM ev WINDOW {', '.join(f"w{n} AS (PARTITION BY k ORDER BY date ROWS {n - 1} PRECEDING)" for n in SCALES)}),
sc AS (SELECT k, year(date) AS year, label, unnest({list(SCALES)}) AS scale, unnest([{', '.join(f's{n}' for n in SCALES)}]) AS score FROM dd WHERE s250 IS NOT NULL),
{rank_sql('sc', 'k, year, scale')} SELECT k, year::INT AS year, scale::INT AS scale, round(average_precision, 9) AS average_precision FROM rm QUALIFY row_number() OVER (PARTITION BY k, year ORDER BY coalesce(round(average_precision, 9), -1) DESC, scale) = 1""")
def q_scale_choice(spark, d):
    """The drawdown window that ranks each year's labels best, the first of equals."""
    x = scored(spark, d)
    x = x.withColumns({f"s{n}": F.round(-t.drawdown(t.Series(["k"]), "p", n), 6) for n in SCALES}).filter("s250 is not null")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scale"), F.col(f"s{n}").alias("s")) for n in SCALES)))
    x = x.select("k", F.year("date").alias("year"), "label", each.alias("c")).select("k", "year", "label", "c.scale", "c.s")
    ranked = rounded(evaluate.rank_metrics(x, ["k", "year", "scale"], score="s"), "average_precision")  # equal but for rounding is equal
    return evaluate.first_best(ranked, ["k", "year"], "average_precision", "scale").select("k", "year", "scale", "average_precision")


@cat.add()
def q_history_search(spark, d):
    """Walk-forward scores of each feature group fitted on all, 756 or 1,260 rows of history, ranked within priority."""
    out = None
    for history in (None, 756, 1260):
        one = models.walk_forward(features(spark, d), ["k"], GROUPS, history=history).filter("part = 'test'")
        one = evaluate.rank_metrics(one, ["k", "model"]).withColumn("history", F.lit(history or 0))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(F.desc("average_precision"))))


@cat.add(f"""WITH {SCORED}, {rank_sql('ev', 'k')}, slow AS (SELECT a.k, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auroc FROM ev a JOIN ev b ON b.k = a.k AND a.label = 1 AND b.label = 0 GROUP BY a.k)
SELECT k, n, round(rm.auroc, 7) AS auroc, abs(rm.auroc - slow.auroc) < 1e-9 AS agrees FROM rm JOIN slow USING (k)""")
def q_verify_metrics(spark, d):
    """The rank metric against a second way of computing it: average ranks of tied scores."""
    x = scored(spark, d).filter("label is not null")
    ranks = x.withColumn("r", F.rank().over(Window.partitionBy("k").orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy("k", "score")) - 1) / 2)
    p, n = F.sum("label"), F.count(F.lit(1))
    slow = ranks.groupBy("k").agg(((F.sum(F.when(F.col("label") == 1, F.col("r"))) - p * (p + 1) / 2) / (p * (n - p))).alias("slow"))
    y = evaluate.rank_metrics(x, ["k"]).join(slow, "k")
    return y.select("k", "n", F.round("auroc", 7).alias("auroc"), (F.abs(F.col("auroc") - F.col("slow")) < 1e-9).alias("agrees"))


@cat.add(f"WITH {SCORED}, {rank_sql('ev', 'k')} SELECT k AS \"Priority\", round(auroc, 4) AS \"AUROC\", round(average_precision, 4) AS \"AP\", list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], k)::BIGINT AS \"Order\" FROM rm WHERE k IN ('5-LOW', '1-URGENT', '3-MEDIUM')")
def q_result_view(spark, d):
    """Fixed metric columns under display names, for models in an explicit order."""
    order = F.array(*map(F.lit, ("5-LOW", "1-URGENT", "3-MEDIUM")))
    x = evaluate.rank_metrics(scored(spark, d), ["k"]).withColumn("Order", F.array_position(order, F.col("k"))).filter("Order > 0")
    return x.select(F.col("k").alias("Priority"), F.round("auroc", 4).alias("AUROC"), F.round("average_precision", 4).alias("AP"), "Order").orderBy("Order")


@cat.add("SELECT replace(upper(trim(symbol)), '.', '-') AS symbol, count(DISTINCT basket) AS baskets, count(*) AS rows FROM prices WHERE symbol IS NOT NULL GROUP BY 1")
def q_symbol_enumeration(spark, d):
    """Every symbol with the baskets that list it."""
    return table(spark, d, "prices").filter("symbol is not null").groupBy(canonical_symbol("symbol").alias("symbol")).agg(F.count_distinct("basket").alias("baskets"), F.count(F.lit(1)).alias("rows"))


@cat.add(f"""WITH {SPY}, {VIX}, {ASSETS}, cv AS (SELECT date, count(*) AS expected, count(*) FILTER (ok) AS eligible FROM mk GROUP BY date), a AS (SELECT s.feed, s.date, s.p, ln(s.p) - lag(ln(s.p)) OVER w AS r, lag(v.v) OVER w AS vix FROM spy s LEFT JOIN vixd v USING (feed, date) WINDOW w AS (PARTITION BY s.feed ORDER BY s.date))
SELECT feed, strftime(a.date, '%Y-%m-%d') AS date, {', '.join(f'round(ln(p / lag(p, {n}) OVER w), 8) AS momentum_{n}' for n in (5, 20, 60))}, {', '.join(f'CASE WHEN count(p) OVER w{n} = {n} THEN round(p / max(p) OVER w{n} - 1, 8) END AS drawdown_{n}' for n in (60, 252))},
CASE WHEN count(r) OVER w20 = 20 THEN round(stddev_samp(CASE WHEN r IS NOT NULL THEN least(r, 0) END) OVER w20 * sqrt(252), 8) END AS downside_vol20, round(vix - lag(vix, 5) OVER w, 8) AS vix_change5, CASE WHEN count(vix) OVER w60 = 60 THEN round(vix / avg(vix) OVER w60, 8) END AS vix_ratio60,
cv.eligible AS eligible_assets, round(cv.eligible / cv.expected, 8) AS eligible_fraction FROM a LEFT JOIN cv USING (date) WINDOW w AS (PARTITION BY feed ORDER BY date), w20 AS (w ROWS 19 PRECEDING), w60 AS (w ROWS 59 PRECEDING), w252 AS (w ROWS 251 PRECEDING)""")
def q_enhanced_features(spark, d):
    """Recent stress of each feed with the eligible members of all baskets on the day."""
    x = market_base(spark, d)
    names = enhanced(["feed"])
    cover = member_sessions(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("expected"), F.count_if("eligible").alias("eligible"))
    x = with_coverage(x.withColumns(names), cover)
    return rounded(x.select("feed", text_date(), *names, "eligible_assets", "eligible_fraction"), *names, "eligible_fraction", digits=8)


def market_base(spark, d):
    """feed, date, p, r and the volatility of the row before."""
    x = calendars.align(spy(spark, d), vix_daily(spark, d), ["feed", "date"])
    return x.withColumns({"r": t.log_return(FEED, "p"), "vix": t.shifted(FEED, "v", 1)})


@cat.add(f"""WITH {PANEL}, {WINDOWS}, {MEMBERS}, c AS (SELECT p.basket, p.session::INT AS session, avg(rho) AS x FROM pairs p JOIN members a ON a.basket = p.basket AND a.session = p.session AND a.symbol = p.i JOIN members b ON b.basket = p.basket AND b.session = p.session AND b.symbol = p.j GROUP BY p.basket, p.session HAVING count(*) >= 3)
SELECT basket, session, round(x - lag(x, 5) OVER w, 8) AS average_change5, CASE WHEN count(x) OVER b >= 40 THEN round(greatest(-10, least(10, (x - avg(x) OVER b) / nullif(stddev_samp(x) OVER b, 0))), 6) END AS average_z60 FROM c WINDOW w AS (PARTITION BY basket ORDER BY session), b AS (PARTITION BY basket ORDER BY session ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def q_dynamics(spark, d):
    """Change and causal z of the average correlation of each basket's windows."""
    x = panels.correlation_pairs(member_panel(spark, d), BASKET, "symbol", active="member_now").select("basket", "session", "average")
    y = x.withColumns(dynamics(BASKET, ["average"]))
    return y.select("basket", "session", F.round("average_change5", 8).alias("average_change5"), F.round("average_z60", 6).alias("average_z60"))


DYNAMIC = ("h1_entropy_normalized", "h1_total_per_asset", "h1_integrated_l2_per_asset", "w2_per_sqrt_asset")


@cat.add()
def q_model_panel(spark, d):
    """Base, compact, dynamic, curve and stress features of each basket on the dates of the feed that stands beside it, with the forward label.

    Baskets and feeds are paired by their ranks; rows without all features are left out, and columns that follow the calendar are
    in no group. Of the 200 coordinates of the curve every eighth is shown.
    """
    order = lambda c: F.dense_rank().over(Window.partitionBy().orderBy(c))  # noqa: E731  a list of names, small
    feeds = spy(spark, d).select("feed").distinct().withColumn("n", order("feed"))
    many = max(1, feeds.count())
    baskets = table(spark, d, "membership").select("basket").distinct().filter("basket is not null").withColumn("n", order("basket"))
    pairs = baskets.select("basket", (F.pmod(F.col("n") - 1, F.lit(many)) + 1).alias("n")).join(feeds, "n").select("basket", "feed")
    base = market_base(spark, d)
    stress = enhanced(["feed"])
    base = base.withColumns({**stress, "vol20": t.annual_volatility(FEED, "r"), "label": t.forward_loss(FEED, "p", 0.05, 20), "label_end": t.label_end(FEED, 20)})
    top = panels.diagram_velocity(panels.topology_features(member_panel(spark, d), BASKET, "symbol", active="member_now", extras=("betti1",)), BASKET)
    moving = dynamics(BASKET, DYNAMIC)
    curve = {f"betti_{j:03}": F.get("betti1", F.lit(j)) / F.col("n_assets") for j in range(0, 200, 8)}
    top = top.withColumns({**moving, **curve}).drop("bars", "betti1", "session")
    groups = registry(["vix", "vol20", "eigenvalue_ratio"], [*panels.FEATURES, "n_assets", "w2_per_sqrt_asset"], list(moving), list(curve), [*stress, "eligible_assets", "eligible_fraction"])
    x = assemble([base.join(pairs, "feed"), top], ["basket", "date"], groups, keep=["feed", "label"])
    columns = sorted({c for cs in groups.values() for c in cs})
    return x.select("basket", text_date(), "feed", "label", *(F.round(c, 7).alias(c) for c in columns))
