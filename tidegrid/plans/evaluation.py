"""Queries of evaluation operators: thresholds, metrics, splits, selection, bootstrap, false discovery, walk-forward."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timeline as t
from ..operators import calendars, evaluate, models
from ..session import cut
from .bases import DAY, REV, SCORED, Catalogue, scored, text_date

cat = Catalogue()
LABELLED = "label is not null"
BUDGETS = (0.01, 0.05, 0.10)
THRESHOLD = """thr AS (SELECT k, b AS budget, s[ceil((1 - b) * (n - 1))::INT + 1] AS threshold FROM (SELECT k, list(score ORDER BY score) AS s, count(*)::DOUBLE AS n FROM ev WHERE label = 0 GROUP BY k), (SELECT unnest([0.01::DOUBLE, 0.05, 0.10]) AS b))"""


def rank_sql(source: str, keys: str, label: str = "label", score: str = "score", where: str = "") -> str:
    """CTE rm: n, positives, prevalence, auroc, average_precision by ``keys`` of ``source``."""
    return f"""g AS (SELECT {keys}, {score} AS s, count(*) AS n, sum({label})::BIGINT AS kk FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL {where} GROUP BY ALL),
gg AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s) AS cn, sum(n) OVER (PARTITION BY {keys} ORDER BY s DESC) AS dn, sum(kk) OVER (PARTITION BY {keys} ORDER BY s DESC) AS dk, sum(n) OVER (PARTITION BY {keys})::DOUBLE AS nn, sum(kk) OVER (PARTITION BY {keys})::DOUBLE AS pp FROM g),
rm AS (SELECT {keys}, max(nn)::BIGINT AS n, max(pp)::BIGINT AS positives, max(pp) / max(nn) AS prevalence, (sum(kk * (cn - (n - 1) / 2)) - max(pp) * (max(pp) + 1) / 2) / nullif(max(pp) * (max(nn) - max(pp)), 0) AS auroc, sum(kk / nullif(pp, 0) * dk / dn) AS average_precision FROM gg GROUP BY ALL)"""


def rounded(df, *columns, digits: int = 9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@cat.add(f"WITH {SCORED}, {THRESHOLD} SELECT * FROM thr")
def q_alarm_threshold(spark, d):
    return evaluate.alarm_threshold(scored(spark, d), ["k"], BUDGETS)


@cat.add(f"WITH {SCORED}, {rank_sql('ev', 'k')} SELECT k, n, positives, round(prevalence, 9) AS prevalence, round(auroc, 9) AS auroc, round(average_precision, 9) AS average_precision FROM rm")
def q_auroc_ap(spark, d):
    return rounded(evaluate.rank_metrics(scored(spark, d), ["k"]), "prevalence", "auroc", "average_precision")


@cat.add(f"""WITH {SCORED}, a AS (SELECT *, (alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY k ORDER BY date), false))::INT AS s FROM ev WHERE label IS NOT NULL), b AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY date) AS e FROM a),
runs AS (SELECT k, e, max(label) AS hit FROM b WHERE alarm GROUP BY ALL), ep AS (SELECT k, count(*) AS alarm_episodes, count(*) FILTER (hit = 0) AS false_alarm_episodes FROM runs GROUP BY k),
c AS (SELECT k, count(*) AS n, count(*) FILTER (alarm AND label = 1) AS tp, count(*) FILTER (alarm AND label = 0) AS fp, count(*) FILTER (NOT alarm AND label = 1) AS fn, count(*) FILTER (NOT alarm AND label = 0) AS tn FROM b GROUP BY k)
SELECT c.*, coalesce(alarm_episodes, 0) AS alarm_episodes, coalesce(false_alarm_episodes, 0) AS false_alarm_episodes, round(fp / greatest(fp + tn, 1), 9) AS false_positive_rate, round(tp / greatest(tp + fn, 1), 9) AS recall, round(tp / greatest(tp + fp, 1), 9) AS precision, round((tp + fp) / n, 9) AS time_under_warning FROM c LEFT JOIN ep USING (k)""")
def q_alarm_metrics(spark, d):
    return rounded(evaluate.alarm_metrics(scored(spark, d).filter(LABELLED), ["k"]), "false_positive_rate", "recall", "precision", "time_under_warning")


@cat.add(f"WITH {SCORED}, y AS (SELECT *, year(date) AS year FROM ev), {rank_sql('y', 'k, year')} SELECT k, count(*) AS strata, round(sum(auroc * positives) / sum(positives), 9) AS auroc, round(sum(average_precision * positives) / sum(positives), 9) AS average_precision FROM rm WHERE auroc IS NOT NULL GROUP BY k")
def q_stratified(spark, d):
    return rounded(evaluate.stratified(scored(spark, d).withColumn("year", F.year("date")), ["k"], "year"), "auroc", "average_precision")


@cat.add(f"WITH {SCORED} SELECT k, round(avg((score - label) ** 2), 9) AS brier FROM ev WHERE label IS NOT NULL GROUP BY k")
def q_brier(spark, d):
    return rounded(evaluate.brier(scored(spark, d).filter(LABELLED), ["k"]), "brier")


@cat.add(f"WITH {SCORED}, {rank_sql('per', 'k, period').replace('FROM per WHERE', 'FROM (SELECT *, CASE WHEN year(date) < 1998 THEN 1995 ELSE 1998 END AS period FROM ev) per WHERE')} SELECT k, period::INT AS period, n, positives, round(auroc, 9) AS auroc FROM rm")
def q_period_metrics(spark, d):
    """Rank metrics of two half-open ranges of years."""
    x = scored(spark, d).withColumn("period", F.when(F.year("date") < 1998, 1995).otherwise(1998))
    return rounded(evaluate.rank_metrics(x, ["k", "period"]), "auroc").select("k", "period", "n", "positives", "auroc")


@cat.add(f"WITH {SCORED}, m AS (SELECT k, month(date)::INT AS m, count(*) AS n, avg(score) AS s FROM ev WHERE label = 1 GROUP BY ALL) SELECT k, round(sum(n * s) / sum(n), 9) AS weighted, round(avg(s), 9) AS plain FROM m GROUP BY k")
def q_weighted_average(spark, d):
    m = scored(spark, d).filter("label = 1").groupBy("k", F.month("date").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s"))
    return rounded(m.groupBy("k").agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("weighted"), F.avg("s").alias("plain")), "weighted", "plain")


@cat.add(f"WITH {SCORED} SELECT k, round(quantile_cont(score, 0.025), 9) AS low, round(median(score), 9) AS middle, round(quantile_cont(score, 0.975), 9) AS high FROM ev GROUP BY k")
def q_quantiles(spark, d):
    return rounded(scored(spark, d).groupBy("k").agg(F.percentile("score", 0.025).alias("low"), F.median("score").alias("middle"), F.percentile("score", 0.975).alias("high")), "low", "middle", "high")


SPLITS = f"""yrs AS (SELECT k, year(date) AS year, min(date) AS test_start, max(date) AS test_end FROM ev GROUP BY ALL),
kn AS (SELECT y.*, e.date AS d, e.label_end AS e, row_number() OVER (PARTITION BY y.k, y.year ORDER BY e.date DESC) AS r FROM yrs y JOIN ev e ON e.k = y.k AND e.label_end < make_date(y.year, 1, 1)),
kc AS (SELECT *, min(d) FILTER (r <= 252) OVER (PARTITION BY k, year) AS c FROM kn),
splits AS (SELECT k, year, test_start, test_end, count(*) AS known, count(*) FILTER (e < c) AS fit_rows, max(e) FILTER (e < c) AS fit_label_end, min(c) AS calibration_start, max(e) FILTER (d >= c) AS calibration_label_end FROM kc GROUP BY ALL HAVING known >= 525 AND fit_rows >= 252)"""


@cat.add(f"WITH {SCORED}, {SPLITS} SELECT k, year::INT AS year, known, fit_rows, " + ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in ("fit_label_end", "calibration_start", "calibration_label_end", "test_start", "test_end")) + " FROM splits")
def q_purged_splits(spark, d):
    x = evaluate.purged_splits(scored(spark, d), ["k"])
    return x.select("k", "year", "known", "fit_rows", *(text_date(c) for c in ("fit_label_end", "calibration_start", "calibration_label_end", "test_start", "test_end")))


@cat.add(f"""WITH {SCORED}, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ev), e AS (SELECT *, floor(n * 0.4) AS a FROM x),
b AS (SELECT *, CASE WHEN i >= a AND i < floor(a + (n - a) / 2) THEN 1 WHEN i >= floor(a + (n - a) / 2) THEN 2 END AS block FROM e), f AS (SELECT k, block, min(date) AS s, max(date) AS z, count(*) AS rows FROM b WHERE block IS NOT NULL GROUP BY ALL)
SELECT f.k, block::INT AS block, strftime(s, '%Y-%m-%d') AS start, strftime(z, '%Y-%m-%d') AS end, rows, count(*) FILTER (ev.label_end < s) AS train_rows FROM f JOIN ev ON ev.k = f.k GROUP BY ALL""")
def q_inner_folds(spark, d):
    x = evaluate.inner_folds(scored(spark, d), ["k"])
    return x.select("k", "block", text_date("start"), text_date("end"), "rows", "train_rows")


@cat.add(f"""WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM ev),
j AS (SELECT a.k, a.date, b.score, b.label, row_number() OVER (PARTITION BY a.k, a.date ORDER BY b.date DESC) AS r FROM n a LEFT JOIN n b ON b.k = a.k AND b.label_end < a.date)
SELECT k, {DAY}, count(score) AS known, coalesce(round(sum(score), 6), 0) AS sum_score, coalesce(sum(label), 0)::DOUBLE AS sum_label FROM j WHERE r <= 252 GROUP BY ALL""")
def q_latest_resolved252(spark, d):
    x = calendars.latest_resolved(scored(spark, d), ["k"], ["score", "label"], "date", "label_end")
    return x.select("k", text_date(), F.col("known").cast("bigint").alias("known"), *(F.coalesce(F.round(F.col(f"mean_{c}") * F.col("known"), 6), F.lit(0.0)).alias(f"sum_{c}") for c in ("score", "label")))


GRID = "SELECT s AS window_rows, c AS budget, row_number() OVER (ORDER BY s, c)::INT AS id FROM (SELECT unnest([20, 60, 120]) AS s) a, (SELECT unnest([0.01::DOUBLE, 0.05, 0.10]) AS c) b"


@cat.add(GRID)
def q_candidate_grid(spark, d):
    """Every combination of two fixed parameter lists, numbered: explodes of literals, no join."""
    x = spark.range(1).select(F.explode(F.array(*map(F.lit, (20, 60, 120)))).alias("window_rows")).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS))))
    return x.withColumn("id", F.row_number().over(Window.partitionBy().orderBy("window_rows", "budget")))


CANDIDATES = f"""cand AS (SELECT k, date, label, unnest([20, 60]) AS w, unnest([score, p]) AS score FROM ev), {rank_sql('cand', 'k, w')}"""


@cat.add(f"WITH {SCORED}, {CANDIDATES} SELECT k, w::INT AS w, round(average_precision, 9) AS average_precision FROM rm QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(average_precision, -1) DESC, w) = 1")
def q_select_best(spark, d):
    """The candidate score with the greatest average precision, the first of equals."""
    x = scored(spark, d).select("k", "label", F.explode(F.array(F.struct(F.lit(20).alias("w"), F.col("score").alias("s")), F.struct(F.lit(60).alias("w"), F.col("p").alias("s")))).alias("c")).select("k", "label", "c.w", "c.s")
    return rounded(evaluate.first_best(evaluate.rank_metrics(x, ["k", "w"], score="s"), ["k"], "average_precision", "w").select("k", "w", "average_precision"), "average_precision")


PVALUES = """pv AS (SELECT k, month(date)::INT AS m, round(greatest(1 / 501, least(1, 2 * least(avg(alarm::INT), 1 - avg(alarm::INT)))), 9) AS p FROM ev GROUP BY ALL)"""


@cat.add(f"""WITH {SCORED}, {PVALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, m) AS i, count(*) OVER (PARTITION BY k) AS n FROM pv),
q AS (SELECT k, m, p, least(1, min(p * n / i) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) SELECT k, m, p, round(q, 9) AS q_value_bh, q <= 0.05 AS significant FROM q""")
def q_bh_fdr(spark, d):
    share = F.avg(F.col("alarm").cast("int"))
    p = scored(spark, d).groupBy("k", F.month("date").alias("m")).agg(F.round(F.greatest(F.lit(1 / 501), F.least(F.lit(1.0), F.least(share, 1 - share) * 2)), 9).alias("p"))
    return rounded(evaluate.benjamini_hochberg(p, ["k"], "p", "m"), "q_value_bh")


def exact_mean(c: str):
    """The mean, in millionths, of values of 6 places: a sum of whole numbers, the same in any order."""
    return F.sum(F.round(F.col(c) * 1_000_000).cast("bigint")).cast("double") / F.count(F.lit(1))


DRAWS, BLOCKS = 500, (20, 60, 120)
BOOTSTRAP = f"""pr AS (SELECT date, max(label) AS label, sum(round(score * 1000000)::BIGINT)::DOUBLE / count(*) AS model, sum(round(p * 1000000)::BIGINT)::DOUBLE / count(*) AS reference, row_number() OVER (ORDER BY date) - 1 AS i FROM ev WHERE label IS NOT NULL GROUP BY date),
cnt AS (SELECT count(*) AS n FROM pr), bl AS (SELECT unnest({list(BLOCKS)}) AS bs), pl AS (SELECT bs, n, least(bs, n) AS b FROM bl, cnt),
st AS (SELECT bs, n, b, draw, k, (draw * 7919 + k * 104729 + (b * 31 + 42)) % 2147483647 + 1 AS a FROM (SELECT *, unnest(range((n + b - 1) // b)) AS k FROM pl), range({DRAWS}) d(draw)),
s1 AS (SELECT *, a * 48271 % 2147483647 AS x FROM st), s2 AS (SELECT * REPLACE ((x * x + a) % 2147483647 AS x) FROM s1), s3 AS (SELECT * REPLACE ((x * x + a) % 2147483647 AS x) FROM s2),
dr AS (SELECT bs, draw, x * (n - b + 1) // 2147483647 + o AS i FROM (SELECT *, unnest(range(b)) AS o FROM s3) WHERE k * b + o < n UNION ALL SELECT bs, -1, i FROM bl, pr),
bo AS (SELECT bs, draw, label, unnest(['m', 'r']) AS w, unnest([model, reference]) AS score FROM dr JOIN pr USING (i))"""


@cat.add(f"""WITH {SCORED}, {BOOTSTRAP}, {rank_sql('bo', 'bs, draw, w')}, dl AS (SELECT bs, draw, max(average_precision) FILTER (w = 'm') - max(average_precision) FILTER (w = 'r') AS d FROM rm WHERE auroc IS NOT NULL GROUP BY ALL),
ag AS (SELECT bs, count(*) FILTER (draw >= 0) AS draws, max(d) FILTER (draw < 0) AS w, list(d) FILTER (draw >= 0) AS l, avg((d > 0)::INT) FILTER (draw >= 0) AS s FROM dl GROUP BY bs)
SELECT bs::INT AS block_sessions, draws, round(w, 8) AS ap_difference, {', '.join(f"round(list_aggregate(l, 'quantile_cont', {q!r}), 8) AS {c}" for c, q in (('lower95', 0.025), ('upper95', 0.975), ('lower_bonferroni', 0.05 / 3 / 2), ('upper_bonferroni', 1 - 0.05 / 3 / 2)))}, round(s, 8) AS share_draws_favouring_model, round(greatest(1 / 501, least(1, 2 * least(s, 1 - s))), 8) AS p_approx FROM ag""")
def q_block_bootstrap(spark, d):
    """Difference in average precision of the drawdown and the price as scores, over moving blocks of the days' means."""
    x = scored(spark, d).filter(LABELLED).groupBy("date").agg(F.max("label").alias("label"), *(exact_mean(c).alias(n) for c, n in (("score", "model"), ("p", "reference"))))
    out = evaluate.bootstrap_difference(x, "model", "reference", "date", BLOCKS, DRAWS, family=3)
    return rounded(out, *(c for c in out.columns if c not in ("block_sessions", "draws")), digits=8)


@cat.add(f"""WITH {SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM ev),
j AS (SELECT a.k, a.date, a.score AS own, b.score, b.label, row_number() OVER (PARTITION BY a.k, a.date ORDER BY b.date DESC) AS r FROM n a JOIN n b ON b.k = a.k AND b.label_end < a.date),
l AS (SELECT k, date, any_value(own) AS own, list(score ORDER BY score) FILTER (label = 0) AS s FROM j WHERE r <= 252 GROUP BY ALL)
SELECT k, {DAY}, len(s) AS negatives, s[ceil(0.95::DOUBLE * (len(s) - 1))::INT + 1] AS threshold, own > s[ceil(0.95::DOUBLE * (len(s) - 1))::INT + 1] AS alarm FROM l WHERE len(s) >= 40""")
def q_rolling_threshold(spark, d):
    """Each day's threshold from the last 252 rows resolved before it, at the 5 % budget, with 40 negatives at least.

    The rows resolved before a day are a prefix of the series and end a fixed number of rows back where none is missing.
    """
    x = scored(spark, d)
    frame = REV.rows(-(252 + 20), -21)
    scores = F.sort_array(F.filter(F.collect_list(F.when(F.col("label") == 0, F.col("score"))).over(frame), lambda v: v.isNotNull()))
    y = x.withColumn("s", scores).withColumn("negatives", F.size("s").cast("bigint")).filter("negatives >= 40")
    y = y.withColumn("threshold", F.get("s", F.ceil(F.lit(0.95) * (F.col("negatives") - 1)).cast("int")))
    return y.select("k", text_date(), "negatives", "threshold", (F.col("score") > F.col("threshold")).alias("alarm"))


def features(spark, d):
    x = scored(spark, d)
    x = x.withColumns({"mom20": t.momentum(REV, "p", 20), "mom60": t.momentum(REV, "p", 60), "cv60": t.variation(REV, "p", 60), "z": t.causal_z(REV, "p", 252, 126), "r": t.log_return(REV, "p")})
    return x.withColumns({"vol20": t.annual_volatility(REV, "r"), "ratio60": t.ratio_to_mean(REV, "p", 60)})


GROUPS = {"market": ["mom20", "mom60", "score"], "risk": ["vol20", "cv60"], "combined": ["mom20", "mom60", "score", "vol20", "cv60", "z", "ratio60"]}


def walk(spark, d, penalty="l2"):
    return models.walk_forward(features(spark, d), ["k"], GROUPS, penalty=penalty)


@cat.add()
def q_walk_forward_lr(spark, d):
    """Annual purged walk-forward scores of three feature groups, with calibrated alarms and metrics at three budgets."""
    alarms = models.calibrated_alarms(walk(spark, d), ["k"])
    return evaluate.alarm_metrics(alarms.filter(LABELLED), ["k", "model", "budget"])


@cat.add()
def q_walk_forward_lasso(spark, d):
    return evaluate.rank_metrics(walk(spark, d, "l1").filter("part = 'test'"), ["k", "model"])


@cat.add()
def q_walk_forward_classic(spark, d):
    """The same with candidates chosen over two-class blocks only."""
    x = models.walk_forward(features(spark, d), ["k"], GROUPS, penalties=(0.1, 1.0), classic=True)
    return evaluate.rank_metrics(x.filter("part = 'test'"), ["k", "model"])


@cat.add()
def q_ensemble(spark, d):
    """The mean of two groups' scores, with thresholds of its own."""
    both = models.ensemble(walk(spark, d), ["k"], "market", "risk", "market+risk")
    return evaluate.alarm_metrics(models.calibrated_alarms(both, ["k"]).filter(LABELLED), ["k", "model", "budget"])


def tree_query(kind: str, spark, d):
    x = features(spark, d).dropna(subset=GROUPS["combined"])
    train = x.filter("label_end < date'1999-01-01' and label is not null")
    test = x.filter("date >= date'1999-01-01' and label is not null")
    return evaluate.rank_metrics(models.tree_scores(train, test, GROUPS["combined"], kind, depth=3, trees=40), ["k"])


@cat.add()
def q_forest_scores(spark, d):
    return tree_query("forest", spark, d)


@cat.add()
def q_boosted_scores(spark, d):
    return tree_query("boosted", spark, d)


@cat.add(f"WITH {SCORED}, w AS (SELECT *, CASE WHEN count(p) OVER a = 60 THEN avg(p) OVER a END AS m FROM ev WINDOW a AS (PARTITION BY k ORDER BY date ROWS 59 PRECEDING)) SELECT k, {DAY}, round(1 / (1 + exp(-(-2 + 30 * score - 0.5 * p / m))), 9) AS score FROM w WHERE m IS NOT NULL")
def q_frozen_scores(spark, d):
    """A logistic model of given coefficients applied as it stands."""
    x = scored(spark, d).withColumn("m", t.ratio_to_mean(REV, "p", 60)).filter("m is not null").withColumn("drawdown", F.col("score"))
    return models.frozen_scores({"drawdown": 30.0, "m": -0.5}, -2.0, x).select("k", text_date(), F.round("score", 9).alias("score"))


SOURCE = "1-URGENT"


@cat.add()
def q_frozen_transfer(spark, d):
    """Each year's models and 5 % thresholds of one priority applied unchanged to the others, with alarm metrics."""
    rows = cut(models.complete_rows(features(spark, d), ["k"], models.columns_of(GROUPS)))
    home = rows.filter(F.col("k") == SOURCE)
    splits = cut(evaluate.purged_splits(home, ["k"]))
    fits = cut(models.fit_years(home, splits, ["k"], GROUPS))
    held = models.parts(home, splits, ["k"]).filter("part = 'calibration'").join(fits, ["k", "year"]).withColumn("score", models.score_of(GROUPS))
    thresholds = evaluate.alarm_threshold(held, ["year", "model"], (0.05,))
    away = models.transfer(fits, thresholds, rows.filter(F.col("k") != SOURCE).select("k", "date", "label", *models.columns_of(GROUPS)), GROUPS)
    return evaluate.alarm_metrics(away.filter(LABELLED), ["k", "model"])


RAW = """raw AS (SELECT k, date, label, label_end, score FROM (SELECT k, date, label, label_end, lag(score) OVER (PARTITION BY k ORDER BY date) AS score FROM ev) WHERE score IS NOT NULL)"""
RAW_SPLITS = SPLITS.replace("FROM ev GROUP", "FROM raw GROUP").replace("JOIN ev e", "JOIN raw e")


@cat.add(f"""WITH {SCORED}, {RAW}, {RAW_SPLITS}, calib AS (SELECT s.k, s.year, r.label, r.score FROM splits s JOIN raw r ON r.k = s.k AND r.date >= s.calibration_start AND r.label_end < make_date(s.year, 1, 1)),
thr AS (SELECT k, year, b AS budget, q[ceil((1 - b) * (len(q) - 1))::INT + 1] AS threshold FROM (SELECT k, year, list(score ORDER BY score) AS q FROM calib WHERE label = 0 GROUP BY ALL), (SELECT unnest([0.01::DOUBLE, 0.05, 0.10]) AS b))
SELECT t.k, t.budget, count(*) AS n, count(*) FILTER (r.score > threshold AND label = 1) AS tp, count(*) FILTER (r.score > threshold AND label = 0) AS fp, count(*) FILTER (r.score <= threshold AND label = 1) AS fn, count(*) FILTER (r.score <= threshold AND label = 0) AS tn
FROM thr t JOIN raw r ON r.k = t.k AND year(r.date) = t.year WHERE label IS NOT NULL GROUP BY ALL""")
def q_raw_benchmark(spark, d):
    """The score of the day before, unfitted, with the thresholds that its own calibration rows give at three budgets."""
    x = scored(spark, d).withColumn("score", t.shifted(REV, "score", 1))
    alarms = models.calibrated_alarms(models.raw_benchmark(x, ["k"], "score", "raw"), ["k"])
    return evaluate.alarm_metrics(alarms.filter(LABELLED), ["k", "budget"]).select("k", "budget", "n", "tp", "fp", "fn", "tn")


@cat.add(f"WITH {SCORED}, a AS (SELECT k, avg(label) AS p FROM ev WHERE label_end < DATE '1998-01-01' GROUP BY k) SELECT e.k, round(a.p, 9) AS score, round(avg((a.p - e.label) ** 2), 9) AS brier, count(*) AS n FROM ev e JOIN a USING (k) WHERE e.date >= DATE '1998-01-01' AND label IS NOT NULL GROUP BY ALL")
def q_constant_benchmark(spark, d):
    """The training prevalence for every later day."""
    x = scored(spark, d)
    base = x.filter("label_end < date'1998-01-01'").groupBy("k").agg(F.avg("label").alias("score"))
    y = x.drop("score").filter("date >= date'1998-01-01' and label is not null").join(base, "k")
    return rounded(y.groupBy("k", "score").agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier"), F.count(F.lit(1)).alias("n")), "score", "brier")


COORDINATES, SPLIT = 200, "1998-01-01"
COORDS = f"""nu AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM ev), ar AS (SELECT k, date, label, label_end, list(score) OVER (PARTITION BY k ORDER BY date ROWS {COORDINATES - 1} PRECEDING) AS a, i FROM nu),
co AS (SELECT k, date, label, label_end, unnest(range({COORDINATES})) AS coordinate, unnest(list_reverse(a)) AS score FROM ar WHERE i >= {COORDINATES} AND label IS NOT NULL),
tr AS (SELECT * FROM co WHERE label_end < DATE '{SPLIT}'), {rank_sql('tr', 'k, coordinate')}, chosen AS (SELECT k, coordinate, round(greatest(auroc, 1 - auroc), 9) AS strength, CASE WHEN auroc >= 0.5 THEN 1 ELSE -1 END AS sign FROM rm
QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(round(greatest(auroc, 1 - auroc), 9), -1) DESC, coordinate) = 1)"""


@cat.add(f"WITH {SCORED}, {COORDS}, te AS (SELECT c.k, c.coordinate, strength, sign, label, sign * score AS score FROM chosen c JOIN co USING (k, coordinate) WHERE date >= DATE '{SPLIT}'), {rank_sql('te', 'k, coordinate, strength, sign').replace('g AS', 'g2 AS', 1).replace('gg AS', 'gg2 AS').replace('FROM g)', 'FROM g2)').replace('rm AS', 'rm2 AS').replace('FROM gg ', 'FROM gg2 ')} SELECT k, coordinate::INT AS coordinate, strength, sign, n, positives, round(auroc, 9) AS test_auroc, round(average_precision, 9) AS test_ap FROM rm2")
def q_best_coordinate(spark, d):
    """The coordinate, of each day's last 200 scores, that ranks the labels before a day best in either direction, and its metrics after it."""
    frame = REV.trailing(COORDINATES)
    x = scored(spark, d).withColumn("a", F.when(F.count("score").over(frame) == COORDINATES, F.reverse(F.collect_list("score").over(frame)))).filter("a is not null and label is not null")
    best = rounded(models.best_coordinate(x.filter(f"label_end < date'{SPLIT}'"), ["k"], "a", digits=9), "auroc")
    test = x.filter(f"date >= date'{SPLIT}'").join(best, "k").withColumn("s", F.col("sign") * F.get("a", F.col("coordinate")))
    strength = F.round(F.greatest("auroc", F.lit(1.0) - F.col("auroc")), 9)
    got = evaluate.rank_metrics(test.withColumn("strength", strength).drop("auroc"), ["k", "coordinate", "strength", "sign"], score="s")
    return rounded(got.select("k", "coordinate", "strength", "sign", "n", "positives", F.col("auroc").alias("test_auroc"), F.col("average_precision").alias("test_ap")), "test_auroc", "test_ap")


@cat.add(f"""WITH {SCORED}, {THRESHOLD}, old AS (SELECT k, budget, min(score) AS threshold FROM (SELECT e.k, t.budget, e.score, count(*) OVER (PARTITION BY e.k, t.budget ORDER BY e.score) AS upto, count(*) OVER (PARTITION BY e.k, t.budget)::DOUBLE AS n FROM ev e JOIN thr t USING (k) WHERE label = 0) WHERE upto > ceil((1 - budget) * (n - 1)) GROUP BY ALL)
SELECT e.k, n.budget, count(*) AS rows, round(max(abs(n.threshold - o.threshold)), 9) AS most, count(*) FILTER ((e.score > n.threshold) <> (e.score > o.threshold)) AS alarm_mismatches FROM thr n JOIN old o USING (k, budget) JOIN ev e ON e.k = n.k GROUP BY ALL""")
def q_reproduction_check(spark, d):
    """Alarms recomputed from sorted arrays of the negatives against those of the operator, joined by priority, day and budget."""
    x = scored(spark, d)
    alarms = lambda cut: x.join(cut, "k").select("k", "date", "budget", "threshold", (F.col("score") > F.col("threshold")).alias("alarm"))
    sorted_ = x.filter("label = 0").groupBy("k").agg(F.sort_array(F.collect_list("score")).alias("s")).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS))))
    again = sorted_.select("k", "budget", F.get("s", F.ceil((F.lit(1.0) - F.col("budget")) * (F.size("s") - 1)).cast("int")).alias("threshold"))
    return evaluate.reproduction(alarms(evaluate.alarm_threshold(x, ["k"], BUDGETS)), alarms(again), ["k", "date", "budget"], ["k", "budget"], "threshold", "alarm")
