"""Hand fixtures and properties of the series, panel and evaluation operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegrid.functions import timeline as t
from tidegrid.operators import calendars, evaluate, islands, models, panels

S = t.Series(["k"])
START = dt.date(2020, 1, 1)


def frame(spark, values, kind="double", key="a", start=START):
    return spark.createDataFrame([(key, start + dt.timedelta(i), v if v is None else float(v)) for i, v in enumerate(values)], f"k string, date date, x {kind}")


def column(df, c="y"):
    return [r[c] for r in df.orderBy("k", "date").collect()]


def test_broken_price_breaks_both_returns(spark):
    got = column(frame(spark, [1.0, 2.0, None, 4.0, 8.0]).withColumn("y", t.log_return(S, "x")))
    assert [v is None for v in got] == [True, False, True, True, False]


def test_full_windows_only(spark):
    df = frame(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert column(df.withColumn("y", t.rolling(S, "x", 2))) == [None, 1.5, None, None, 4.5, 5.5]
    assert column(df.withColumn("y", t.rolling(S, "x", 3, "sum", least=2))) == [None, 3.0, 3.0, 6.0, 9.0, 15.0]


def test_features_read_no_future(spark):
    values = np.exp(np.cumsum(np.random.default_rng(0).normal(0, 0.01, 350))).tolist()
    make = lambda df: df.withColumns({"z": t.causal_z(S, "x", 60, 40), "m": t.momentum(S, "x", 20), "d": t.drawdown(S, "x", 60), "v": t.variation(S, "x", 60)})
    whole, prefix = make(frame(spark, values)).orderBy("date").limit(300).collect(), make(frame(spark, values[:300])).orderBy("date").collect()
    assert whole == prefix


def test_forward_label(spark):
    df = frame(spark, [100.0, 96, 94, 100, 101]).withColumns({"y": t.forward_loss(S, "x", 0.05, 2), "e": t.label_end(S, 2)})
    assert column(df) == [1, 0, 0, None, None] and column(df, "e")[:2] == [START + dt.timedelta(2), START + dt.timedelta(3)]


def test_drawdown_events(spark):
    got = islands.drawdown_events(frame(spark, [100.0, 99, 89, 80, 101, 90, 102]), ["k"], "x").orderBy("event").collect()
    day = lambda n: START + dt.timedelta(n)
    assert [(r["onset"], r["recovery"], r["censored"]) for r in got] == [(day(2), day(4), False), (day(5), day(6), False)]
    assert islands.drawdown_events(frame(spark, [100.0, 80]), ["k"], "x").first()["censored"]


def test_episodes(spark):
    df = spark.createDataFrame([("a", START + dt.timedelta(i), a, y) for i, (a, y) in enumerate(zip([True, True, True, False, True], [0, 0, 1, 0, 0]))], "k string, date date, alarm boolean, label int")
    assert sorted((r["rows"], r["positive"]) for r in islands.episodes(df, ["k"], "alarm", positive="label").collect()) == [(1, 0), (3, 1)]
    m = evaluate.alarm_metrics(df, ["k"]).first()
    assert (m["alarm_episodes"], m["false_alarm_episodes"], m["tp"], m["fp"]) == (2, 1, 1, 3)


def test_as_of_forms(spark):
    cal = frame(spark, [0.0] * 10).select("k", "date")
    reads = spark.createDataFrame([("a", START, 1.0), ("a", START + dt.timedelta(7), 2.0)], "k string, date date, v double")
    assert column(calendars.as_of(cal, reads, ["k"], ["v"]), "v") == [1.0] * 7 + [2.0] * 3
    aligned = calendars.align(cal, reads, ["k", "date"])
    assert column(aligned.withColumn("y", calendars.as_of_bounded(aligned, ["k"], "v", 5))) == [None] + [1.0] * 6 + [None, 2.0, 2.0]
    assert column(calendars.nearest(cal, reads, ["k"], "v"), "v") == [1.0] * 4 + [2.0] * 6
    assert column(calendars.nearest(cal, reads.filter("false"), ["k"], "v"), "v") == [None] * 10


def test_membership_intervals(spark):
    members = spark.createDataFrame([("b", START + dt.timedelta(d), s) for d, ss in ((0, "AB"), (3, "A"), (5, "AB")) for s in ss], "basket string, date date, m string")
    got = rows(calendars.membership_intervals(members, members.select("basket", "date").distinct(), ["basket"], "m"))
    assert got == sorted([("b", "A", START, None), ("b", "B", START, START + dt.timedelta(3)), ("b", "B", START + dt.timedelta(5), None)], key=str)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 100, 251])
def test_threshold_is_the_higher_quantile(spark, n):
    p = np.random.default_rng(n).normal(size=n).round(1)
    df = spark.createDataFrame([("a", 0, float(v)) for v in p] + [("a", 1, 99.0)], "k string, label int, score double")
    got = {r["budget"]: r["threshold"] for r in evaluate.alarm_threshold(df, ["k"], (0.01, 0.05, 0.1)).collect()}
    assert got == {b: float(np.quantile(p, 1 - b, method="higher")) for b in got}
    assert all((p > v).mean() <= b for b, v in got.items())


def test_rank_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 9, 80) / 10
    got = evaluate.rank_metrics(spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, s)], "k string, label int, score double"), ["k"]).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    from tidegrid.functions.kernels import average_precision

    assert np.isclose(got["auroc"], np.mean(pairs)) and np.isclose(got["average_precision"], average_precision(y.astype(float), s))
    one = evaluate.rank_metrics(spark.createDataFrame([("a", 0, 1.0)], "k string, label int, score double"), ["k"]).first()
    assert one["auroc"] is None and one["average_precision"] is None


def test_purge(spark):
    df = frame(spark, [0.0] * 300).withColumn("label_end", t.label_end(S, 20))
    assert df.filter(F.col("label_end") < F.lit(START + dt.timedelta(200))).agg(F.max("date")).first()[0] == START + dt.timedelta(179)


def test_first_best_and_fdr(spark):
    c = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("a", 3, 0.5), ("b", 1, None), ("b", 2, None)], "k string, id int, ap double")
    assert rows(evaluate.first_best(c, ["k"], "ap", "id").select("k", "id")) == [("a", 2), ("b", 1)]
    p = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.5])], "k string, id int, p double")
    got = {r["id"]: round(r["q_value_bh"], 6) for r in evaluate.benjamini_hochberg(p, ["k"], "p", "id").collect()}
    assert got == {0: 0.04, 1: round(0.16 / 3, 6), 2: round(0.16 / 3, 6), 3: 0.5}


def test_bootstrap_agrees_with_direct(spark):
    from tidegrid.functions.kernels import average_precision

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 90)
    a, b = y + rng.normal(size=90), rng.normal(size=90)
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(90)], "row int, label int, m double, r double")
    here, joined = (evaluate.bootstrap_difference(df, "m", "r", "row", (20, 200), 50, most=most).orderBy("block_sessions").collect() for most in (1000, 0))
    for one, two in zip(here, joined):
        assert all(x == y or np.isclose(x, y) for x, y in zip(one, two))
    prime = 2147483647

    def start(draw, k):
        v = (draw * 7919 + k * 104729 + 20 * 31 + 42) % prime + 1
        x = v * 48271 % prime
        for _ in range(2):
            x = (x * x + v) % prime
        return x * 71 // prime

    d = []
    for draw in range(50):
        at = np.concatenate([start(draw, k) + np.arange(20) for k in range(5)])[:90]
        if 0 < y[at].sum() < 90:
            d.append(average_precision(y[at].astype(float), a[at]) - average_precision(y[at].astype(float), b[at]))
    got = here[0]
    assert got["draws"] == len(d) and np.isclose(got["lower95"], np.quantile(d, 0.025)) and np.isclose(got["share_draws_favouring_model"], (np.array(d) > 0).mean())
    assert here[1]["draws"] == 50 and np.isclose(here[1]["lower95"], got["ap_difference"])  # a block as long as the table is the table
    assert evaluate.bootstrap_difference(df.filter("false"), "m", "r", "row", draws=5).filter("draws > 0").count() == 0


def test_block_starts_spread_evenly(spark):
    got = evaluate.block_starts(spark, 1000, 10, 400).filter("position % 10 = 0").toPandas()
    count = np.histogram(got["row"], bins=10, range=(0, 991))[0]
    assert len(got) == 40_000 and count.min() > 3700 and count.max() < 4300
    by_draw = got.sort_values(["draw", "position"]).groupby("draw")["row"].apply(list)
    assert abs(np.corrcoef([x[:-1] for x in by_draw][0], [x[1:] for x in by_draw][0])[0, 1]) < 0.3 and abs(np.corrcoef([x[0] for x in by_draw], [x[1] for x in by_draw])[0, 1]) < 0.15


def test_walk_forward_reads_no_future(spark):
    rng = np.random.default_rng(0)
    n = 1300
    x = rng.normal(size=n)
    panel = [("a", START + dt.timedelta(i), float(x[i]), float(rng.normal()), int(x[i] + rng.normal() > 1) if i < n - 20 else None, START + dt.timedelta(i + 20) if i < n - 20 else None) for i in range(n)]
    schema = "k string, date date, f double, g double, label int, label_end date"
    run = lambda data: models.walk_forward(spark.createDataFrame(data, schema), ["k"], {"m": ["f", "g"]})
    whole = run(panel)
    again = run([(*p[:2], -p[2] if p[1] >= dt.date(2022, 6, 1) else p[2], *p[3:]) for p in panel])
    pick = lambda df: rows(df.filter("year = 2022 and date < date'2022-06-01'").select("part", "date", "score"))
    assert pick(whole) == pick(again) and len(pick(whole)) > 300
    alarms = models.calibrated_alarms(whole, ["k"]).filter("label is not null")
    assert evaluate.rank_metrics(whole.filter("part = 'test'"), ["k"]).first()["auroc"] > 0.7 and alarms.count() > 0


def test_ols_residual_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=120), rng.normal(size=120)
    df = spark.createDataFrame([("a", START + dt.timedelta(i), float(a[i]), float(b[i]) if i % 7 else None) for i in range(120)], "k string, date date, y double, x double")
    got = {r["date"]: r["residual"] for r in panels.ols_residual(df, ["k"], "y", ["x"]).collect()}
    at = 100
    use = [i for i in range(at - 60, at) if i % 7]
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(use)), b[use]]), a[use], rcond=None)[0]
    assert np.isclose(got[START + dt.timedelta(at)], a[at] - beta[0] - beta[1] * b[at]) and got[START + dt.timedelta(98)] is None and got[START + dt.timedelta(30)] is None


def test_correlation_forms_agree(spark):
    rng = np.random.default_rng(0)
    data = [("b", f"S{s}", START + dt.timedelta(i), float(np.exp(v))) for s in range(5) for i, v in enumerate(np.cumsum(rng.normal(0, 0.01, 90)))]
    data = [r for k, r in enumerate(data) if k != 130]  # one missing price breaks a window
    p = spark.createDataFrame(data, "basket string, symbol string, date date, p double")
    panel = panels.returns(panels.dense_panel(p, ["basket"], "symbol", "p"), ["basket"], "symbol", "p")
    a = {r["session"]: r["average"] for r in panels.correlation_pairs(panel, ["basket"], "symbol").collect()}
    b = {r["session"]: r["average"] for r in panels.correlation_sql(panel, ["basket"], "symbol").collect()}
    assert sorted(a) == sorted(b) and len(a) == 30 and np.allclose([a[s] for s in a], [b[s] for s in a])
