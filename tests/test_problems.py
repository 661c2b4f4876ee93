"""The general data-preparation operators on small dirty tables."""

import datetime as dt
import math

import numpy as np
import pytest

from tests.conftest import rows
from tidegrid.operators import asof, grid, rolling, snapshots, spikes

D = dt.date
T = lambda day, hour=12: dt.datetime(2024, 1, day, hour)
MEMBERSHIP = "snapshot_id bigint, basket string, date date, tickers string, units array<int>, received_at timestamp_ntz, extra string"
PRICES = "date date, symbol string, adjusted_close double, basket string, received_at timestamp_ntz, value int"


@pytest.fixture
def membership(spark):
    return spark.createDataFrame(
        [
            (1, "b", D(2024, 1, 1), "A1,B1,B1", [10, 20, 20], T(1), None),
            (2, "b", D(2024, 1, 3), "A1,C1", [10, 5], T(3, 8), None),
            (3, "b", D(2024, 1, 3), "A1 C1 D1", [11, 5], T(6), None),  # corrected later; D1 has no unit
            (4, "b", D(2024, 1, 5), None, None, T(5), None),
            (5, "b", D(2024, 1, 6), " , ", [], T(6), None),
            (6, "b", D(2024, 1, 7), "D1;'A1'", [None, 11], T(7), None),
            (7, None, D(2024, 1, 7), "A1", [1], T(7), None),
            (8, "b", None, "A1", [1], None, None),
        ],
        MEMBERSHIP,
    )


def test_snapshot_changes(spark, membership):
    got = rows(snapshots.membership_changes(membership).select("basket", "date", "ticker", "change", "fields"))
    d3, d7 = D(2024, 1, 3), D(2024, 1, 7)
    assert got == sorted(
        [
            ("b", d3, "A1", "changed", ["units"]),
            ("b", d3, "B1", "removed", ["units"]),
            ("b", d3, "C1", "added", ["units"]),
            ("b", d3, "D1", "added", ["units"]),
            ("b", d7, "C1", "removed", ["units"]),
        ],
        key=str,
    )
    assert snapshots.membership_changes(membership.filter("false")).count() == 0


def test_as_known(spark, membership):
    prices = spark.createDataFrame([(D(2024, 1, d), s, 1.0, "b", T(d), 0) for d in (1, 3, 5, 6, 8) for s in ("a1 ", "B1", "D1", "D1")] + [(None, "A1", 1.0, "b", T(1), 0), (D(2024, 1, 1), None, 1.0, "b", T(1), 0)], PRICES)
    got = rows(asof.membership_as_known(prices, membership))
    want = []
    for d, known in ((1, {"A1": 10, "B1": 20}), (3, {"A1": 10, "C1": 5}), (5, {"A1": 10, "C1": 5}), (6, {"A1": 11, "C1": 5, "D1": None}), (8, {"D1": None, "A1": 11})):
        want += [("b", s, D(2024, 1, d), True if s in known else None, known.get(s)) for s in ("A1", "B1", "D1")]
    assert got == sorted(want, key=str)
    assert asof.membership_as_known(prices, membership.filter("false")).filter("present is not null").count() == 0


def test_late_delivery_of_an_older_date_changes_nothing(spark):
    m = spark.createDataFrame([(1, "b", D(2024, 1, 5), "A1", [1], T(5), None), (2, "b", D(2024, 1, 2), "Z1", [1], T(9), None)], MEMBERSHIP)
    p = spark.createDataFrame([(D(2024, 1, d), "Z1", 1.0, "b", T(d), 0) for d in (3, 10)], PRICES)
    assert [r["present"] for r in asof.membership_as_known(p, m).collect()] == [None, None]


def test_rolling(spark):
    p = [(D(2024, 1, 1), " x.a", 10.0, "b", T(2), 0), (D(2024, 1, 1), "X-A", 20.0, "b", T(3), 0), (D(2024, 1, 4), "X/A", 4.0, "b", T(4), 0), (D(2024, 1, 4), "X/A", 6.0, "b", T(4), 0)]
    p += [(D(2024, 1, 6), "X-A", v, "b", None if math.isnan(v) else T(6), 0) for v in (math.nan, -1.0)] + [(D(2024, 1, 13), "X-A", 8.0, "b", None, 0), (D(2024, 1, 14), "X-A", None, "b", T(14), 0)]
    df = spark.createDataFrame(p, PRICES)
    x = rolling.trailing_totals(rolling.valid_daily(df), ["basket", "symbol"], "date", "value", (3, 7))
    got = {r["date"].day: (r["n_3"], r["total_3"], r["n_7"], r["avg_7"]) for r in x.collect()}
    assert sorted(got) == list(range(1, 14))
    assert got[1] == (1, 20.0, 1, 20.0) and got[4] == (1, 6.0, 2, 13.0) and got[7] == (0, None, 2, 13.0) and got[13] == (1, 8.0, 1, 8.0) and got[12] == (0, None, 0, None)
    assert {(r["date"].day, r["days"]) for r in rolling.undefined_days(x, ["basket", "symbol"], "date", (3, 7)).collect()} == {(d, 3) for d in range(7, 13)} | {(d, 7) for d in (11, 12)}
    assert rolling.trailing_totals(rolling.valid_daily(df.filter("false")), ["basket", "symbol"], "date", "value").count() == 0


def test_crowded_series_give_the_same(spark):
    df = spark.range(4000).selectExpr(
        "date_add(date'2024-01-01', cast(id % 30 as int)) as date", "if(id % 3 = 0, 'HOT', concat('S', id % 5)) as symbol", "cast(id % 97 as double) as adjusted_close", "'b' as basket",
        "cast(timestamp_seconds(1704067200 + (id * 7919) % 1000) as timestamp_ntz) as received_at",
    )
    plain, split, all_first = rolling.last_daily(df), rolling.last_daily(df, crowded=800), rolling.last_daily(df, crowded=100, most=1)
    assert rows(plain) == rows(split) == rows(all_first)


def test_a_crowded_series_in_many_spellings_is_found(spark):
    from pyspark.sql import functions as F

    spellings = F.array(*(F.lit(x + "hot" + y) for x in ("", " ", "'", '"') for y in ("", " ", "'", '"', "]")))
    df = spark.range(2000).select(F.get(spellings, (F.col("id") % 20).cast("int")).alias("symbol"), F.lit("b").alias("basket"))
    assert rolling.crowded_series(df, 1500, 10) == [("b", "HOT")] and rolling.crowded_series(df, 2500, 10) == []


def test_grid(spark):
    days = [D(2024, 1, 1) + dt.timedelta(n) for n in range(120)]
    kept = [d for k, d in enumerate(days) if k % 9 not in (4, 5, 6)]
    curve = lambda d: math.exp(4 + 0.002 * (d - days[0]).days)
    df = spark.createDataFrame([("f", d, curve(d)) for d in kept] + [("weekend", D(2024, 1, 6), 5.0)], "feed string, date date, value double")
    got = {r["date"]: r for r in grid.regular_grid(df, ["feed"], "date", "value").filter("feed = 'f'").collect()}
    week = [d for d in days if d.weekday() < 5 and kept[0] <= d <= kept[-1]]
    assert sorted(got) == week
    for d in week:
        assert got[d]["filled"] == (d not in kept) and abs(got[d]["value"] / curve(d) - 1) < (1e-3 if d not in kept else 1e-9)
    assert grid.regular_grid(df, ["feed"], "date", "value").filter("feed = 'weekend'").count() == 0
    assert grid.regular_grid(df.filter("false"), ["feed"], "date", "value").count() == 0


def test_feed_readings(spark):
    m = spark.createDataFrame([("f", D(2024, 1, 1), 5.0, T(1)), ("f", D(2024, 1, 1), 6.0, T(2)), ("f", D(2024, 1, 1), math.inf, T(3)), ("f", None, 6.0, T(2)), (None, D(2024, 1, 1), 6.0, T(2)), ("f", D(2024, 1, 2), -1.0, None)], "feed string, date date, SPY double, received_at timestamp_ntz")
    v = spark.createDataFrame([("f", D(2024, 1, 1), 5.0, T(1, 9), T(2)), ("f", D(2024, 1, 1), 7.0, T(1, 18), T(1)), ("f", D(2024, 1, 2), math.nan, T(2), T(2))], "feed string, DATE date, CLOSE double, read_at timestamp_ntz, received_at timestamp_ntz")
    assert rows(grid.feed_readings(m, v)) == [("f", "SPY", D(2024, 1, 1), 6.0), ("f", "VIX", D(2024, 1, 1), 7.0)]


def series(n=300, sigma=0.01, seed=0, quiet=0.0):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, sigma, n) * (rng.random(n) >= quiet)
    return 50 * np.exp(np.cumsum(r))


def reasons(p):
    reason, _ = spikes.judge(np.zeros(len(p), dtype=np.int64), np.asarray(p, dtype=float), spikes.Limits())
    return {k: np.flatnonzero(reason == k).tolist() for k in (1, 2, 3) if (reason == k).any()}


def test_plain_series_have_no_flags():
    for seed in range(30):
        assert reasons(series(seed=seed)) == {} and reasons(series(seed=seed, quiet=0.25)) == {}


def test_spikes_shifts_and_stuck():
    p = series()
    p[50] *= 1.5
    p[90:93] *= 0.7
    p[200:] *= 2  # a lasting change of level is none
    p[240:250] = p[240]
    p[120], p[121] = -1, np.inf
    assert reasons(p) == {1: [120, 121], 2: [50, 90, 91, 92], 3: list(range(241, 250))}


def test_adjacent_spikes_and_lively_times():
    p = series(seed=3)
    p[60] *= 10
    p[62] *= 1.4
    assert reasons(p) == {2: [60, 62]}
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.01, 300)
    r[100:140] *= 2.5
    assert reasons(50 * np.exp(np.cumsum(r))) == {}


def test_edges_and_short_series():
    p = series(seed=4)
    p[0] *= 1000
    p[-1] *= 100
    assert reasons(p) == {2: [0, 299]}
    assert reasons([1, 100, 1, 0]) == {1: [3]} and reasons([]) == {}
    assert reasons([5.0] * 50) == {}  # a series that never moves is as usual


def test_nearly_still():
    p = series(seed=5)
    p[100:115] = p[100] * (1 + 1e-5 * np.random.default_rng(0).normal(size=15))
    assert reasons(p) == {3: list(range(101, 115))}

def autoregressive(phi, n=400, seed=0, sigma=0.01):
    rng = np.random.default_rng(seed)
    r = np.zeros(n)
    for t, e in enumerate(rng.normal(0, sigma, n)):
        r[t] = phi * r[t - 1] + e
    return r


def test_moves_are_judged_by_the_autoregression(monkeypatch):
    p = 50 * np.exp(np.cumsum(autoregressive(0.8, seed=2)))
    r = np.diff(np.log(p))
    fit = spikes.fit_moves(np.log(p), np.zeros(len(p), dtype=np.int64), 1, spikes.Limits())
    assert abs(fit.phi[0] - 0.8) < 0.1 and abs(fit.scale[0] / 0.01 - 1) < 0.2 and fit.scale[0] < 0.8 * r.std()
    p[150] *= 1.13  # 13 usual residuals, but 8 usual moves
    assert reasons(p) == {2: [150]}
    plain = spikes.fit_moves

    def without(*args):
        fit = plain(*args)
        return spikes.Fit(fit.phi * 0, *(np.abs(fit_zero(*args[:3])) * k for k in (1.4826, 1.4826 * 10)))

    def fit_zero(x, sid, n):
        return spikes.group_quantiles(np.abs(np.diff(x)), sid[1:], n)[0]

    monkeypatch.setattr(spikes, "fit_moves", without)
    assert reasons(p) != {2: [150]}


@pytest.mark.parametrize("phi", [-0.4, 0.0, 0.4])
def test_planted_spells_of_any_length_are_found(phi):
    found = wrong = planted = 0
    for seed in range(40):
        rng = np.random.default_rng(1000 + seed)
        p = 50 * np.exp(np.cumsum(autoregressive(phi, seed=seed)))
        bad = set()
        for k, at in enumerate((40, 90, 140, 190, 240, 290, 340)):
            m = 1 + (seed + k) % 10
            p[at : at + m] *= np.exp(rng.choice([-1, 1]) * rng.uniform(0.25, 2.0))
            bad |= set(range(at, at + m))
        p[370:] *= 1.6  # lasting
        got = set(reasons(p).get(2, []))
        found, wrong, planted = found + len(got & bad), wrong + len(got - bad), planted + len(bad)
    assert found >= 0.99 * planted and wrong <= 0.01 * planted


def test_neighbours_of_opposite_sign():
    p = series(seed=6)
    p[100] *= 10
    p[101] /= 10
    p[200] *= 1.4
    p[201] /= 1.4
    assert reasons(p) == {2: [100, 101, 200, 201]}


def test_a_spell_longer_than_the_limit_is_a_change_of_level():
    p = series(seed=7)
    p[100:110] *= 3
    p[150:161] *= 3
    assert reasons(p) == {2: list(range(100, 110))}


def test_quantiles_of_groups():
    rng = np.random.default_rng(0)
    sid = np.sort(rng.integers(0, 5, 200))
    sid[sid == 3] = 4
    v = rng.normal(size=200)
    got = spikes.group_quantiles(v, sid, 6, (0.5, 0.9))
    for g in range(6):
        want = np.quantile(v[sid == g], (0.5, 0.9)) if (sid == g).any() else [np.nan] * 2
        assert np.allclose(got[:, g], want, equal_nan=True)


def test_many_series_as_one_each():
    parts = [series(n=n, seed=n) for n in (5, 60, 200, 9)]
    for p in parts[1:3]:
        p[30] *= 2
    sid = np.repeat(np.arange(4), [len(p) for p in parts])
    together, _ = spikes.judge(sid, np.concatenate(parts), spikes.Limits())
    alone = np.concatenate([spikes.judge(np.zeros(len(p), dtype=np.int64), p, spikes.Limits())[0] for p in parts])
    assert (together == alone).all() and (together == 2).sum() == 2


def test_flag_series(spark, monkeypatch):
    data, start = [], D(2023, 1, 1)
    for s in range(6):
        p = series(n=100, seed=s)
        p[40] *= 3
        data += [(start + dt.timedelta(k), f"S{s}", float(v), "b", T(1), 0) for k, v in enumerate(p)]
    df = spark.createDataFrame([*data, (start, "S9", None, "b", T(1), 0), (start, "S8", math.nan, "b", T(1), 0)], PRICES)
    got = spikes.implausible_prices(df)
    assert rows(got.select("symbol", "date", "reason")) == sorted([(f"S{s}", start + dt.timedelta(40), "spike") for s in range(6)] + [("S8", start, "limit")], key=str)
    assert spikes.implausible_prices(df.filter("false")).count() == 0
