"""Queries of relational operators: contracts, predicates, nulls, joins, aggregates, set operations and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.symbols import canonical_symbol
from ..functions.values import capped_magnitude, clip, finite, none_of, positive, ratio
from ..operators import calendars, evaluate, rolling, snapshots
from ..operators.packed import split_packed
from ..sources import contracts
from ..sources.tables import table
from .bases import DAY, REVENUE, SCORED, SPY, VIX, Catalogue, revenue, scored, spy, text_date, vix_daily
from .problems import _PARTS, _PRICE

cat = Catalogue()
TABLES = ("prices", "membership", "markets", "vix", "yield_curve", "orders", "lineitem", "events")


@cat.add("SELECT symbol, date, adjusted_close AS p FROM prices WHERE date BETWEEN DATE '2005-01-01' AND DATE '2009-12-31' AND symbol IS NOT NULL")
def q_scan_pruned(spark, d):
    """A scan that reads three columns and pushes the range of dates down."""
    return table(spark, d, "prices").filter("date between date'2005-01-01' and date'2009-12-31' and symbol is not null").select("symbol", "date", F.col("adjusted_close").alias("p"))


@cat.add("SELECT basket, symbol, strftime(date, '%Y-%m-%d') AS date, count(*) AS n FROM prices GROUP BY basket, symbol, prices.date HAVING count(*) > 1")
def q_duplicate_keys(spark, d):
    return contracts.duplicate_keys(table(spark, d, "prices"), ["basket", "symbol", "date"]).select("basket", "symbol", text_date(), "n")


@cat.add("SELECT basket, symbol, strftime(date, '%Y-%m-%d') AS date, adjusted_close AS p, received_at FROM prices WHERE adjusted_close IS NOT NULL AND NOT (adjusted_close > 0 AND isfinite(adjusted_close)) AND NOT isnan(adjusted_close)")
def q_validity_quarantine(spark, d):
    _, bad = contracts.quarantine(table(spark, d, "prices"), "adjusted_close")
    return bad.filter("not isnan(adjusted_close)").select("basket", "symbol", text_date(), F.col("adjusted_close").alias("p"), "received_at")


@cat.add(f"""WITH {_PARTS} SELECT 'null' AS rule, count(*) FILTER (tickers IS NULL) AS rows FROM membership UNION ALL SELECT 'repeated name', (SELECT count(*) FROM membership) - (SELECT count(*) FROM parts WHERE len(list_distinct(names)) = len(names)) UNION ALL
SELECT 'repeated snapshot', count(*) FROM (SELECT basket, date FROM membership GROUP BY ALL HAVING count(*) > 1)""")
def q_contract_membership(spark, d):
    """Rules that membership deliveries break; a null field has no distinct names either."""
    x = split_packed(table(spark, d, "membership").select("basket", "date", "tickers"), "tickers", into="names")
    return contracts.membership_contract(x, "names", ["basket"], "date")


@cat.add("SELECT 'dates' AS rule, count(*) FILTER (NOT coalesce(date BETWEEN DATE '2000-01-01' AND DATE '2024-12-31', false)) AS rows FROM markets UNION ALL SELECT 'SPY', count(*) FILTER (NOT coalesce(SPY > 0, false)) FROM markets")
def q_contract_markets(spark, d):
    m = table(spark, d, "markets")
    return contracts.violations(m, {"dates": F.col("date").between("2000-01-01", "2024-12-31"), "SPY": F.col("SPY") > 0})


@cat.add("""SELECT 'vix null' AS rule, count(*) FILTER ("CLOSE" IS NULL OR "DATE" IS NULL) AS rows FROM vix UNION ALL SELECT 'vix repeated', count(*) FROM (SELECT feed, "DATE" FROM vix WHERE "DATE" IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'vix late', count(*) FILTER (NOT coalesce(f <= DATE '2010-01-01', false)) FROM (SELECT min("DATE") AS f FROM vix GROUP BY feed) UNION ALL SELECT 'spread null', count(*) FILTER (T10Y2Y IS NULL OR date IS NULL) FROM yield_curve
UNION ALL SELECT 'spread repeated', count(*) FROM (SELECT date FROM yield_curve WHERE date IS NOT NULL GROUP BY date HAVING count(*) > 1) UNION ALL SELECT 'spread late', (NOT coalesce(min(date) <= DATE '2010-01-01', false))::BIGINT FROM yield_curve""")
def q_contract_series(spark, d):
    """Nulls, repeated dates and late starts of the volatility readings and the term spread."""
    v = contracts.series_contract(table(spark, d, "vix"), ["feed"], "DATE", "CLOSE", "2010-01-01", "vix")
    return v.unionByName(contracts.series_contract(table(spark, d, "yield_curve"), [], "date", "T10Y2Y", "2010-01-01", "spread"))


@cat.add(f"""WITH {_PRICE} SELECT 'rows' AS what, count(*) AS n FROM prices UNION ALL SELECT 'symbols', count(DISTINCT symbol) FROM px UNION ALL SELECT 'invalid', count(*) FILTER (p IS NOT NULL AND NOT coalesce(p > 0 AND isfinite(p), false)) FROM px UNION ALL SELECT 'valid days', count(*) FROM valid""")
def q_input_audit(spark, d):
    """Counts of the input audit, in long form."""
    p = table(spark, d, "prices")
    keyed = p.filter("symbol is not null and date is not null").select(canonical_symbol("symbol").alias("s"), F.col("adjusted_close").alias("p"))
    one = p.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("what"), "n")
    two = keyed.agg(F.count_distinct("s").alias("symbols"), F.count_if(F.col("p").isNotNull() & positive("p").isNull()).alias("invalid")).select(F.explode(F.create_map(F.lit("symbols"), "symbols", F.lit("invalid"), "invalid")).alias("what", "n"))
    return one.unionByName(two).unionByName(rolling.valid_daily(p).agg(F.lit("valid days").alias("what"), F.count(F.lit(1)).alias("n")))


@cat.add("SELECT event_id, CASE WHEN abs(value - 250) <= 100 THEN value END AS near, greatest(50, least(value, 400)) AS clipped, value / nullif(floor(value) % 7, 0) AS ratio FROM events")
def q_masks(spark, d):
    """Magnitude mask, clip and null denominators."""
    e = table(spark, d, "events")
    near = F.when(capped_magnitude(F.col("value") - 250, 100.0).isNotNull(), F.col("value"))
    return e.select("event_id", near.alias("near"), clip("value", 50.0, 400.0).alias("clipped"), ratio("value", F.floor("value").cast("double") % 7).alias("ratio"))


@cat.add("SELECT feed, count(*) AS n, count(*) FILTER (LQD IS NOT NULL AND HYG IS NOT NULL AND NOT isnan(LQD) AND NOT isnan(HYG)) AS both, round(sum(coalesce(CASE WHEN isfinite(HYG) THEN HYG END, -1)), 4) AS filled FROM markets GROUP BY feed")
def q_null_handling(spark, d):
    """Rows left by dropping nulls of a subset, and constants for nulls and infinities."""
    m = table(spark, d, "markets").select("feed", "LQD", "HYG")
    return m.groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("LQD").isNotNull() & F.col("HYG").isNotNull() & ~F.isnan("LQD") & ~F.isnan("HYG")).alias("both"), F.round(F.sum(F.coalesce(finite("HYG"), F.lit(-1.0))), 4).alias("filled"))


@cat.add("SELECT p_brand, count(*) AS n FROM part WHERE p_type IN ('ECONOMY BRUSHED COPPER', 'STANDARD POLISHED TIN') OR (p_name LIKE 'a%' AND p_name NOT LIKE '%e') OR contains(p_type, 'STEEL') OR p_size BETWEEN 10 AND 12 GROUP BY p_brand")
def q_predicates(spark, d):
    p = table(spark, d, "part")
    keep = F.col("p_type").isin("ECONOMY BRUSHED COPPER", "STANDARD POLISHED TIN") | (F.col("p_name").startswith("a") & ~F.col("p_name").endswith("e")) | F.col("p_type").contains("STEEL") | F.col("p_size").between(10, 12)
    return p.filter(keep).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@cat.add("SELECT event_type, count(*) AS n FROM events WHERE value > 400 GROUP BY event_type")
def q_parameterised(spark, d):
    """A named parameter in SQL text."""
    return spark.sql("SELECT event_type, count(*) AS n FROM {e} WHERE value > :least GROUP BY event_type", args={"least": 400.0}, e=table(spark, d, "events"))


MEMBERS = f"""{_PARTS}, mem AS (SELECT DISTINCT basket, date, unnest(names) AS ticker FROM full_parts), shots AS (SELECT DISTINCT basket, date FROM full_parts)"""


def members(spark, d):
    x = snapshots.deliveries_with_values(table(spark, d, "membership"))
    return x.select("basket", "date", F.explode("items.ticker").alias("ticker")).distinct(), x.select("basket", "date").distinct()


@cat.add(f"WITH {MEMBERS} SELECT basket, strftime(date, '%Y-%m-%d') AS date, ticker FROM mem")
def q_membership_explode(spark, d):
    return members(spark, d)[0].select("basket", text_date(), "ticker")


@cat.add(f"""WITH {MEMBERS}, n AS (SELECT basket, date, row_number() OVER w AS n, lead(date) OVER w AS nx FROM shots WINDOW w AS (PARTITION BY basket ORDER BY date)),
i AS (SELECT m.*, n.nx, n.n - row_number() OVER (PARTITION BY m.basket, m.ticker ORDER BY m.date) AS isl FROM mem m JOIN n USING (basket, date))
SELECT basket, ticker, strftime(min(date), '%Y-%m-%d') AS start, strftime(arg_max_null(nx, date), '%Y-%m-%d') AS end_exclusive FROM i GROUP BY basket, ticker, isl""")
def q_membership_intervals(spark, d):
    mem, shots = members(spark, d)
    return calendars.membership_intervals(mem, shots, ["basket"], "ticker").select("basket", "ticker", text_date("start"), text_date("end_exclusive"))


@cat.add(f"""WITH {MEMBERS}, v AS (SELECT DISTINCT basket, replace(upper(trim(symbol)), '.', '-') AS symbol FROM prices WHERE symbol IS NOT NULL AND date IS NOT NULL), t AS (SELECT DISTINCT basket, ticker FROM mem)
SELECT t.basket, count(*) AS named, count(v.symbol) AS priced FROM t LEFT JOIN v ON v.basket = t.basket AND v.symbol = t.ticker GROUP BY t.basket""")
def q_membership_join(spark, d):
    """Members with and without prices, matched in canonical form on both sides."""
    t = members(spark, d)[0].select("basket", "ticker").distinct()
    v = table(spark, d, "prices").filter("symbol is not null and date is not null").select("basket", canonical_symbol("symbol").alias("ticker")).distinct().withColumn("hit", F.lit(1))
    return t.join(v, ["basket", "ticker"], "left").groupBy("basket").agg(F.count(F.lit(1)).alias("named"), F.count("hit").alias("priced"))


@cat.add(f"WITH {SPY}, {VIX} SELECT feed, strftime(date, '%Y-%m-%d') AS date FROM vixd ANTI JOIN spy USING (feed, date)")
def q_except_dates(spark, d):
    return vix_daily(spark, d).select("feed", "date").subtract(spy(spark, d).select("feed", "date")).select("feed", text_date())


@cat.add(f"WITH {SPY}, {VIX} SELECT feed, strftime(date, '%Y-%m-%d') AS date, v FROM vixd SEMI JOIN spy USING (feed, date)")
def q_semi_dates(spark, d):
    return vix_daily(spark, d).join(spy(spark, d), ["feed", "date"], "left_semi").select("feed", text_date(), "v")


@cat.add(f"WITH {SPY}, {VIX} SELECT feed, strftime(date, '%Y-%m-%d') AS date FROM (SELECT feed, date FROM vixd INTERSECT SELECT feed, date FROM spy)")
def q_intersect_dates(spark, d):
    return vix_daily(spark, d).select("feed", "date").intersect(spy(spark, d).select("feed", "date")).select("feed", text_date())


@cat.add(f"WITH {SCORED} SELECT a.k, strftime(a.date, '%Y-%m-%d') AS date, a.budget, a.alarm AS alarm_score, b.alarm AS alarm_price FROM (SELECT k, date, b AS budget, score > b AS alarm FROM ev, (SELECT unnest([0.01::DOUBLE, 0.05]) AS b)) a JOIN (SELECT k, date, b AS budget, p < lag(p) OVER (PARTITION BY k, b ORDER BY date) * (1 - b / 10) AS alarm FROM ev, (SELECT unnest([0.01::DOUBLE, 0.05]) AS b)) b USING (k, date, budget)")
def q_composite_join(spark, d):
    """Alarms of two rules side by side, joined by priority, day and budget; the column that both have gets suffixes."""
    each = scored(spark, d).withColumn("budget", F.explode(F.array(F.lit(0.01), F.lit(0.05))))
    a = each.select("k", "date", "budget", (F.col("score") > F.col("budget")).alias("alarm"))
    before = F.lag("p").over(Window.partitionBy("k", "budget").orderBy("date"))
    b = each.select("k", "date", "budget", (F.col("p") < before * (1 - F.col("budget") / 10)).alias("alarm"))
    return evaluate.joined(a, b, ["k", "date", "budget"], ("_score", "_price")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@cat.add("SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS q, round(max(o_totalprice), 2) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def q_order_lines(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.max("o_totalprice"), 2).alias("p"))


EXCLUDED = ("QORVEX", "ZKOAT-A", "YTMKA")


@cat.add(f"SELECT basket, count(*) AS n, count(symbol) AS named FROM prices WHERE symbol IS NULL OR symbol NOT IN {EXCLUDED} GROUP BY basket")
def q_not_in(spark, d):
    """Rows whose symbol is none of a list; a null symbol is none of them and stays."""
    rows = table(spark, d, "prices").select("basket", "symbol").filter(none_of("symbol", EXCLUDED))
    return rows.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), F.count("symbol").alias("named"))


WEIGHTS = {"view": 1, "click": 2, "cart": 5, "purchase": 20}


@cat.add(f"SELECT user_id, count(*) AS n, sum(MAP {{'view': 1, 'click': 2, 'cart': 5, 'purchase': 20}}[event_type])::BIGINT AS weight FROM events GROUP BY user_id")
def q_literal_map(spark, d):
    """Values looked up in a literal map; what it lacks is null and counts for nothing."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(scalars.mapped("event_type", WEIGHTS)).alias("weight"))


@cat.add("SELECT p_partkey, 'https://example.org/part?name=' || url_encode(p_name) || '&brand=' || url_encode(p_brand) AS url FROM part")
def q_url_encode(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://example.org/part?name="), scalars.quote("p_name"), F.lit("&brand="), scalars.quote("p_brand")).alias("url"))


@cat.add("SELECT r_name, n_name, count(c_custkey) AS customers, count(DISTINCT c_mktsegment) AS segments FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def q_lookup_join(spark, d):
    """A fact with two lookups: Spark broadcasts them by their size."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    x = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("segments", F.lit(0)).alias("segments"))


@cat.add("SELECT y.date::VARCHAR AS date, coalesce(m.x, y.T10Y2Y) AS x FROM yield_curve y LEFT JOIN (SELECT date, round(avg(SPY), 6) AS x FROM markets WHERE isfinite(SPY) AND SPY > 0 GROUP BY date) m USING (date) WHERE y.T10Y2Y IS NOT NULL AND NOT isnan(y.T10Y2Y)")
def q_fallback_lookup(spark, d):
    """A value from the first table, or from the second where that has none."""
    m = table(spark, d, "markets").filter(positive("SPY").isNotNull()).groupBy("date").agg(F.round(F.avg("SPY"), 6).alias("x"))
    y = table(spark, d, "yield_curve").filter("T10Y2Y is not null and not isnan(T10Y2Y)")
    return y.join(m, "date", "left").select(F.col("date").cast("string").alias("date"), F.coalesce("x", "T10Y2Y").alias("x"))


@cat.add("WITH n AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(before) AS pairs, round(max(abs(value - before)), 4) AS most FROM n GROUP BY user_id")
def q_consecutive_pairs(spark, d):
    """Each row with the one before it, by a window in place of a self join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").select("user_id", "value", F.lag("value").over(w).alias("before"))
    return x.groupBy("user_id").agg(F.count("before").alias("pairs"), F.round(F.max(F.abs(F.col("value") - F.col("before"))), 4).alias("most"))


@cat.add("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@cat.add("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def q_row_of_max(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@cat.add("SELECT event_type, bool_or(value > 489) AS any_high, bool_and(value > 1) AS all_above, count(DISTINCT user_id) AS users, round(min(value), 4) AS least, arg_min(event_id, (ts, event_id)) AS first FROM events GROUP BY event_type")
def q_group_summary(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    return e.agg(F.bool_or(F.col("value") > 489).alias("any_high"), F.bool_and(F.col("value") > 1).alias("all_above"), F.count_distinct("user_id").alias("users"), F.round(F.min("value"), 4).alias("least"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first"))


@cat.add("SELECT year(o_orderdate)::INT AS year, o_orderstatus, round(sum(o_totalprice), 2) AS total, grouping_id(year(o_orderdate), o_orderstatus)::BIGINT AS level FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)")
def q_year_rollup(spark, d):
    x = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return x.rollup("year", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@cat.add(f"WITH {REVENUE} SELECT k, {DAY}, p FROM rev QUALIFY row_number() OVER (PARTITION BY k ORDER BY date DESC) <= 252")
def q_topk_tail(spark, d):
    """The last 252 rows of each series."""
    w = Window.partitionBy("k").orderBy(F.desc("date"))
    return revenue(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 252").select("k", text_date(), "p")


@cat.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
def q_top_orders(spark, d):
    """A top-k report."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(60)


@cat.add("SELECT event_type, list_position(['view', 'click', 'cart', 'purchase', 'refund'], event_type)::BIGINT AS position, count(*) AS n FROM events GROUP BY event_type")
def q_custom_order(spark, d):
    """Sorting by an explicit list: its positions as a key (0 or null for what it lacks)."""
    x = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    at = F.array_position(F.array(*map(F.lit, ("view", "click", "cart", "purchase", "refund"))), F.col("event_type"))
    return x.withColumn("position", F.nullif(at, F.lit(0).cast("bigint")).cast("bigint")).orderBy("position", "event_type")


@cat.add("SELECT n_name AS name, NULL::DOUBLE AS balance, n_regionkey AS region FROM nation UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def q_union_wide(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).select("name", "balance", "region")


@cat.add("SELECT symbol FROM (SELECT replace(upper(trim(symbol)), '.', '-') AS symbol FROM prices WHERE symbol IS NOT NULL) UNION SELECT DISTINCT ticker FROM (WITH " + _PARTS + " SELECT unnest(names) AS ticker FROM full_parts)")
def q_union_distinct(spark, d):
    a = table(spark, d, "prices").filter("symbol is not null").select(canonical_symbol("symbol").alias("symbol")).distinct()
    b = members(spark, d)[0].select(F.col("ticker").alias("symbol"))
    return a.union(b).distinct()


@cat.add("SELECT user_id, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY user_id, event_type")
def q_keep_first(spark, d):
    """The first row of each key in time."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("user_id", "event_id")


@cat.add(f"WITH {SCORED} SELECT {DAY}, max(score) FILTER (k = '1-URGENT') AS urgent, max(score) FILTER (k = '2-HIGH') AS high, max(score) FILTER (k = '5-LOW') AS low FROM ev GROUP BY date")
def q_pivot_scores(spark, d):
    x = scored(spark, d).groupBy("date").pivot("k", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.max("score"))
    return x.select(text_date(), F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


FUNDS = ("LQD", "HYG", "JNK", "VCIT", "VCSH", "USIG", "BND")


@cat.add("SELECT feed, fund, count(*) AS n, round(sum(v), 3) AS total FROM (UNPIVOT (SELECT feed, " + ", ".join(f"CASE WHEN {c} > 0 AND isfinite({c}) THEN {c} END AS {c}" for c in FUNDS) + " FROM markets) ON " + ", ".join(FUNDS) + " INTO NAME fund VALUE v) GROUP BY ALL")
def q_unpivot_funds(spark, d):
    x = table(spark, d, "markets").select("feed", *(positive(c).alias(c) for c in FUNDS)).unpivot("feed", list(FUNDS), "fund", "v").filter("v is not null")
    return x.groupBy("feed", "fund").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


@cat.add("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def q_json_document(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@cat.add("""SELECT p_partkey, replace(p_type, ' ', '_') AS underscored, regexp_extract(p_brand, '(\\d+)', 1) AS digits, split_part(p_type, ' ', -1) AS last, upper(left(p_name, 10)) AS start, printf('%.4f', p_retailprice) AS price, len(string_split(p_type, ' '))::INT AS words FROM part""")
def q_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("_")).alias("underscored"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("digits"), scalars.after_last("p_type", " ").alias("last"), F.upper(F.left("p_name", F.lit(10))).alias("start"), F.format_string("%.4f", "p_retailprice").alias("price"), F.size(F.split("p_type", " ")).alias("words"))


@cat.add("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, year(ts)::INT AS year, (ts::DATE - DATE '2024-01-01')::INT AS days, (epoch_us(ts) // 1000000)::BIGINT AS seconds FROM events")
def q_dates(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.year("ts").alias("year"), F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("days"), F.unix_seconds(ts.cast("timestamp")).alias("seconds"))


@cat.add("SELECT event_id, round(ln(value), 9) AS ln, round(sqrt(value), 9) AS root, ceil(value)::BIGINT AS up, round(pow(0.94::DOUBLE, value / 100), 9) AS decay, round(abs(value - 250), 6) AS far FROM events")
def q_math(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.ln(v), 9).alias("ln"), F.round(F.sqrt(v), 9).alias("root"), F.ceil(v).alias("up"), F.round(F.pow(F.lit(0.94), v / 100), 9).alias("decay"), F.round(F.abs(v - 250), 6).alias("far"))


@cat.add("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS square, round(list_max(embedding)::DOUBLE, 6) AS most, len(embedding)::INT AS n FROM embeddings")
def q_arrays(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double") * v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("square"), F.round(F.array_max("embedding").cast("double"), 6).alias("most"), F.size("embedding").alias("n"))


@cat.add("SELECT p_partkey, sha256(p_name) AS hash, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT) AS number, replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM part")
def q_hash_cast(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("hash"), F.regexp_replace("p_brand", "[^0-9]", "").try_cast("int").alias("number"), scalars.escape_html("p_name").alias("escaped"))


@cat.add("""SELECT event_id, round(0.5 + z / sqrt(2 * pi()) * list_sum(list_transform(range(90), lambda k: (-1.0::DOUBLE) ** k * (z * z / 2) ** k / (gamma(k + 1.0) * (2 * k + 1)))), 9) AS cdf, CASE WHEN props IS NOT NULL THEN true END AS same FROM (SELECT *, (value - 250) / 100 AS z FROM events)""")
def q_normal_cdf(spark, d):
    """The normal distribution function of standardised event values, and a round trip through compression."""
    e = table(spark, d, "events").withColumn("z", (F.col("value") - 250) / 100)
    return e.select("event_id", F.round(scalars.normal_cdf("z"), 9).alias("cdf"), (scalars.decompress(scalars.compress("props")).cast("string") == F.col("props")).alias("same"))


@cat.add(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def q_table_index(spark, d):
    out = None
    for name in TABLES:
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out
