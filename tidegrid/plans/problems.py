"""Queries of the general data-preparation problems, pN_..., and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, grid, packed, rolling, snapshots, spikes
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
SERIES = ["basket", "symbol"]


def day(c: str = "date"):
    return F.date_format(c, "yyyy-MM-dd").alias("date")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.membership_changes(table(spark, d, "membership")).select("basket", day(), "ticker", "change")


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    """The same changes counted by kind and by the fields that changed."""
    changes = snapshots.membership_changes(table(spark, d, "membership"))
    return changes.groupBy("basket", "change", F.array_join("fields", ",").alias("changed_fields")).agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    known = asof.membership_as_known(table(spark, d, "prices"), table(spark, d, "membership"))
    return known.filter("present is null").select(*SERIES, day())


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Price keys per basket and symbol with the units known at each date summed up."""
    known = asof.membership_as_known(table(spark, d, "prices"), table(spark, d, "membership"))
    return known.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("days"), F.count("present").alias("member_days"), F.sum(F.col("units").cast("bigint")).alias("unit_days"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The weekdays of the grid that the regression and the bridges filled with a value."""
    return grid.feed_grid(table(spark, d, "markets"), table(spark, d, "vix")).filter("filled and value > 0").select("feed", "series", day())


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every weekday with its value; to 4 places, which two solutions of the same equations agree on."""
    return grid.feed_grid(table(spark, d, "markets"), table(spark, d, "vix")).select("feed", "series", day(), F.round("value", 4).alias("value"), "filled")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_prices(table(spark, d, "prices")).select(*SERIES, day())


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings by basket and reason."""
    return spikes.implausible_prices(table(spark, d, "prices")).groupBy("basket", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 3).alias("most"))


def trailing(spark: SparkSession, d: str) -> DataFrame:
    return rolling.trailing_totals(rolling.valid_daily(table(spark, d, "prices")), SERIES, "date", "value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.undefined_days(trailing(spark, d), SERIES, "date").select(*SERIES, day(), "days")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every day of every series; the averages are taken of the rounded totals, so that they compare exactly."""
    x = trailing(spark, d).withColumns({f"total_{n}": F.round(f"total_{n}", 4) for n in (7, 30)})
    return x.select(*SERIES, day(), *(c for n in (7, 30) for c in (f"n_{n}", f"total_{n}", F.try_divide(f"total_{n}", f"n_{n}").alias(f"avg_{n}"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "membership").select("snapshot_id", "tickers")
    return packed.explode_positions(packed.split_packed(rows, "tickers"), "values", value="ticker").select("snapshot_id", "pos", "ticker")


def p6_guided(spark: SparkSession, d: str) -> DataFrame:
    """The values of every delivery packed anew, unquoted, between ``;`` and with a blank before the share class, and cut by the dictionary of the column."""
    rows = table(spark, d, "membership").select("snapshot_id", "tickers")
    again = F.array_join(F.transform("values", lambda v: F.replace(v, F.lit("-"), F.lit(" "))), ";")
    packed_anew = packed.split_packed(rows, "tickers").select("snapshot_id", again.alias("packed"))
    cut = packed.split_packed(packed_anew, "packed", packed.value_dictionary(rows, "tickers"))
    return packed.explode_positions(cut, "values", value="ticker").select("snapshot_id", "pos", "ticker")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_fields, p2_found, p2_attributes, p3_found, p3_grid, p4_found, p4_reasons, p5_found, p5_totals, p6_found, p6_guided)}

_VALUES = """regexp_extract_all(tickers, '"[^"]*"|''[^'']*''|“[^”]*”|[^,;|，\\s\\x{00A0}\\[\\]{}"''“”]+')"""
_CANON = """replace(replace(replace(replace(replace(upper(trim({}, ' "''“”[]{{}}' || chr(9) || chr(160))), '.', '-'), '/', '-'), ',', '-'), ';', '-'), ' ', '-')"""
_PARTS = f"parts AS (SELECT *, list_transform({_VALUES}, lambda x: {_CANON.format('x')}) AS names FROM membership WHERE tickers IS NOT NULL), full_parts AS (SELECT * FROM parts WHERE len(names) > 0)"
_LAST = f"""{_PARTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY basket, date ORDER BY received_at DESC, snapshot_id DESC) AS rn FROM full_parts),
snaps AS (SELECT *, lag(date) OVER (PARTITION BY basket ORDER BY date) AS before FROM ranked WHERE rn = 1),
cells AS (SELECT basket, date, before, names[i] AS ticker, min_by(units[i], i) AS units, 1 AS here FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM snaps) GROUP BY ALL HAVING true)"""
_CHANGES = _LAST + """, diff AS (
SELECT coalesce(n.basket, o.basket) AS basket, coalesce(n.date, o.after) AS date, coalesce(n.ticker, o.ticker) AS ticker,
CASE WHEN o.ticker IS NULL THEN 'added' WHEN n.ticker IS NULL THEN 'removed' WHEN n.units IS DISTINCT FROM o.units THEN 'changed' END AS change
FROM (SELECT * FROM cells WHERE before IS NOT NULL) n FULL JOIN
(SELECT c.*, s.date AS after FROM cells c JOIN snaps s ON s.basket = c.basket AND s.before = c.date) o ON o.basket = n.basket AND o.after = n.date AND o.ticker = n.ticker)"""
_PRICE = f"""px AS (SELECT basket, {_CANON.format('symbol')} AS symbol, date, adjusted_close AS p, received_at FROM prices WHERE symbol IS NOT NULL AND date IS NOT NULL),
last_px AS (SELECT basket, symbol, date, arg_max(p, received_at) AS p, arg_max(coalesce(p::VARCHAR, 'null'), received_at) AS raw FROM px GROUP BY ALL),
valid AS (SELECT basket, symbol, date, p FROM last_px WHERE raw <> 'null' AND p > 0 AND isfinite(p))"""
_DENSE = _PRICE + """, spine AS (SELECT basket, symbol, unnest(range(min(date)::TIMESTAMP, max(date)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date FROM valid GROUP BY basket, symbol),
dense AS (SELECT s.basket, s.symbol, s.date, v.p FROM spine s LEFT JOIN valid v USING (basket, symbol, date)),
rolled AS (SELECT basket, symbol, date, count(p) OVER w7 AS n_7, sum(p) OVER w7 AS total_7, count(p) OVER w30 AS n_30, sum(p) OVER w30 AS total_30 FROM dense
WINDOW w7 AS (PARTITION BY basket, symbol ORDER BY date ROWS 6 PRECEDING), w30 AS (PARTITION BY basket, symbol ORDER BY date ROWS 29 PRECEDING))"""
_GRID = """reads AS (SELECT feed, 'SPY' AS series, date FROM markets WHERE SPY > 0 AND isfinite(SPY) AND feed IS NOT NULL AND date IS NOT NULL
UNION SELECT feed, 'VIX', "DATE" FROM vix WHERE "CLOSE" > 0 AND isfinite("CLOSE") AND feed IS NOT NULL AND "DATE" IS NOT NULL),
spine AS (SELECT feed, series, unnest(range(min(date)::TIMESTAMP, max(date)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date FROM reads GROUP BY feed, series)"""
_TERMS = 8  # intercept, trend, a weekly and two yearly harmonics


def _fit_sql() -> str:
    """CTEs: reads with values, normal equations with a ridge, Gauss-Jordan steps, and the grid with predictions and bridged residuals."""
    day = "(date - DATE '1970-01-01')"
    waves = [f"{f}({day} * (2 * pi() / {p}))" for p in (7.0, 365.25, 365.25 / 2) for f in ("sin", "cos")]
    x = f"[1.0::DOUBLE, (date - a) / greatest(z - a, 1)::DOUBLE * 2 - 1, {', '.join(waves)}]"
    n = range(1, _TERMS + 1)
    sums = ", ".join([f"sum(x[{i}] * x[{j}]) AS g{i}_{j}" for i in n for j in n] + [f"sum(x[{i}] * y) AS b{i}" for i in n])
    ridge = f"(1e-6 * ({' + '.join(f'g{i}_{i}' for i in n)}) / {_TERMS} + 1e-12)"
    start = ", ".join("[" + ", ".join(f"g{i}_{j}" + (f" + {ridge}" if i == j else "") for j in n) + f", b{i}] AS r{i}" for i in n)
    steps = ""
    for k in n:  # row k clears column k of the others
        rows = ", ".join(f"r{i}" if i == k else f"list_transform(list_zip(r{i}, r{k}), lambda v: v[1] - v[2] * (r{i}[{k}] / r{k}[{k}])) AS r{i}" for i in n)
        steps += f", m{k} AS (SELECT feed, series, {rows} FROM m{k - 1})"
    solved = ", ".join(f"r{i}[{_TERMS + 1}] / r{i}[{i}]" for i in n)
    return f"""vals AS (SELECT feed, 'SPY' AS series, date, ln(arg_max(SPY, (received_at, SPY))) AS y FROM markets WHERE SPY > 0 AND isfinite(SPY) AND feed IS NOT NULL AND date IS NOT NULL GROUP BY feed, date
UNION ALL SELECT feed, 'VIX', "DATE", ln(arg_max("CLOSE", (read_at, received_at, "CLOSE"))) FROM vix WHERE "CLOSE" > 0 AND isfinite("CLOSE") AND feed IS NOT NULL AND "DATE" IS NOT NULL GROUP BY feed, "DATE"),
ends AS (SELECT feed, series, min(date) AS a, max(date) AS z FROM vals GROUP BY ALL),
days AS (SELECT feed, series, a, z, unnest(range(a::TIMESTAMP, z::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date FROM ends),
terms AS (SELECT d.*, v.y, {x} AS x FROM days d LEFT JOIN vals v USING (feed, series, date)),
m AS (SELECT feed, series, {sums} FROM terms WHERE y IS NOT NULL GROUP BY ALL), m0 AS (SELECT feed, series, {start} FROM m){steps},
coef AS (SELECT feed, series, [{solved}] AS c FROM m{_TERMS}), fits AS (SELECT t.*, list_dot_product(x, c) AS fit FROM terms t JOIN coef USING (feed, series)),
near AS (SELECT *, last_value(y - fit IGNORE NULLS) OVER w AS rb, last_value(CASE WHEN y IS NOT NULL THEN date END IGNORE NULLS) OVER w AS db, first_value(y - fit IGNORE NULLS) OVER v AS ra, first_value(CASE WHEN y IS NOT NULL THEN date END IGNORE NULLS) OVER v AS da FROM fits
WINDOW w AS (PARTITION BY feed, series ORDER BY date ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY feed, series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


_KNOWN = f"""{_PARTS}, px AS (SELECT DISTINCT basket, {_CANON.format('symbol')} AS symbol, date FROM prices WHERE symbol IS NOT NULL AND date IS NOT NULL),
days AS (SELECT DISTINCT basket, date FROM px),
best AS (SELECT d.basket, d.date, arg_max(m.snapshot_id, (m.date, m.received_at, m.snapshot_id)) AS snapshot_id
FROM days d JOIN full_parts m ON m.basket = d.basket AND m.date <= d.date AND m.received_at < d.date + INTERVAL 1 DAY GROUP BY ALL),
members AS (SELECT snapshot_id, names[i] AS symbol, min_by(units[i], i) AS units FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM full_parts) GROUP BY ALL),
known AS (SELECT px.*, m.snapshot_id IS NOT NULL AS present, m.units FROM px LEFT JOIN best b USING (basket, date) LEFT JOIN members m ON m.snapshot_id = b.snapshot_id AND m.symbol = px.symbol)"""
_DAY = "strftime(date, '%Y-%m-%d') AS date"

SQL: dict[str, str] = {
    "p1_found": f"WITH {_CHANGES} SELECT basket, {_DAY}, ticker, change FROM diff WHERE change IS NOT NULL",
    "p1_fields": f"WITH {_CHANGES} SELECT basket, change, 'units' AS changed_fields, count(*) AS n FROM diff WHERE change IS NOT NULL GROUP BY ALL",
    "p2_found": f"WITH {_KNOWN} SELECT basket, symbol, {_DAY} FROM known WHERE NOT present",
    "p2_attributes": f"WITH {_KNOWN} SELECT basket, symbol, count(*) AS days, count(*) FILTER (present) AS member_days, sum(units)::BIGINT AS unit_days FROM known GROUP BY ALL",
    "p3_found": f"WITH {_GRID} SELECT feed, series, {_DAY} FROM (SELECT * FROM spine WHERE isodow(date) < 6) ANTI JOIN reads USING (feed, series, date)",
    "p3_grid": f"WITH {_fit_sql()} SELECT feed, series, {_DAY}, round(exp(coalesce(y, fit + rb + (ra - rb) * (date - db) / (da - db))), 4) AS value, y IS NULL AS filled FROM near WHERE isodow(date) < 6",
    "p5_found": f"WITH {_DENSE} SELECT basket, symbol, {_DAY}, 7 AS days FROM rolled WHERE n_7 = 0 UNION ALL SELECT basket, symbol, {_DAY}, 30 FROM rolled WHERE n_30 = 0",
    "p5_totals": f"WITH {_DENSE} SELECT basket, symbol, {_DAY}, n_7, round(total_7, 4) AS total_7, round(total_7, 4) / nullif(n_7, 0) AS avg_7, n_30, round(total_30, 4) AS total_30, round(total_30, 4) / nullif(n_30, 0) AS avg_30 FROM rolled",
    "p6_guided": f"""WITH {_PARTS}, one AS (SELECT DISTINCT snapshot_id, unnest(names) AS v FROM full_parts), known AS (SELECT v FROM one GROUP BY v HAVING count(*) >= 2),
vals AS (SELECT snapshot_id, i, names[i] AS v FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM full_parts)),
cut AS (SELECT snapshot_id, i, unnest(CASE WHEN k.v IS NOT NULL THEN [vals.v] ELSE list_filter(string_split(vals.v, '-'), lambda x: x <> '') END) AS ticker, unnest(range(CASE WHEN k.v IS NOT NULL THEN 1 ELSE len(list_filter(string_split(vals.v, '-'), lambda x: x <> '')) END)) AS j FROM vals LEFT JOIN known k ON k.v = vals.v)
SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY i, j)::INT AS pos, ticker FROM cut""",
    "p6_found": f"WITH {_PARTS} SELECT snapshot_id, i::INT AS pos, names[i] AS ticker FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM full_parts)",
}
