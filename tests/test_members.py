"""Dated membership in the windows of a basket."""

import datetime as dt

import numpy as np

from tests.conftest import rows
from tidegrid.operators import asof, calendars, panels

START = dt.date(2020, 1, 1)
B = ["basket"]


def day(n):
    return START + dt.timedelta(n)


def moment(n):
    return dt.datetime.combine(day(n), dt.time(9))


def setting(spark):
    """Prices of A to E on 80 days; A, B, C and X, which has no prices, are members from day 0, E joins on day 70 and A leaves; D never is one."""
    rng = np.random.default_rng(0)
    data = [("b", s, day(i), float(np.exp(v))) for s in "ABCDE" for i, v in enumerate(np.cumsum(rng.normal(0, 0.01, 80)))]
    prices = spark.createDataFrame(data, "basket string, symbol string, date date, p double")
    deliveries = [(1, "b", day(0), "A,B,C,X", [1] * 4, moment(0)), (2, "b", day(68), "B,C,E,X", [1] * 4, moment(70))]
    membership = spark.createDataFrame(deliveries, "snapshot_id bigint, basket string, date date, tickers string, units array<int>, received_at timestamp")
    calendar = calendars.sessions(prices, B)
    return calendar, asof.member_spans(calendar, membership), panels.returns(panels.dense_panel(prices, B, "symbol", "p"), B, "symbol", "p")


def test_windows_hold_the_members_of_the_day(spark):
    _, spans, panel = setting(spark)
    got = {}
    for r in panels.spanning_trees(panels.with_members(panel, spans, B, "symbol"), B, "symbol", active="member_now").collect():
        got.setdefault(r["session"], set()).update((r["src"], r["dst"]))
    # session 71 is day 70, when the second delivery came: E has a full window at once, as its prices go back before it joined
    assert got == {s: set("ABC") if s < 71 else set("BCE") for s in range(61, 81)}
    pairs = panels.correlation_pairs(panels.with_members(panel, spans, B, "symbol"), B, "symbol", active="member_now").collect()
    assert {(r["session"], r["n"]) for r in pairs} == {(s, 3) for s in range(61, 81)}
    assert {r["n_assets"] for r in panels.topology_features(panels.with_members(panel, spans, B, "symbol"), B, "symbol", active="member_now").collect()} == {3}


def test_coverage_and_ledger_name_members_without_prices(spark):
    calendar, spans, panel = setting(spark)
    members = asof.members_by_session(calendar, spans)
    status = panels.member_status(members, panel.select("basket", "symbol").distinct(), panels.complete_windows(panel, B, "symbol"), B, "symbol")
    assert rows(status.filter("session = 61 and reason is not null").select("symbol", "reason")) == [("X", panels.UNRESOLVED)]
    assert {r["reason"] for r in status.filter("session = 60 and symbol <> 'X'").collect()} == {panels.INCOMPLETE}
    got = panels.member_coverage(calendar, status, B).filter("session = 75").first()
    assert [got[c] for c in ("expected_members", "mapped", "eligible", "missing_symbols", "excluded_incomplete_or_constant")] == [4, 3, 3, 1, 0]


def test_grid_has_every_feature_of_each_variant(spark):
    from pyspark.sql import functions as F

    from tidegrid.functions.values import capped_magnitude

    _, spans, panel = setting(spark)
    jump = F.when((F.col("symbol") == "B") & (F.col("session") == 75), F.lit(0.9)).otherwise(F.col("r"))
    panel = panels.with_members(panel, spans, B, "symbol").withColumn("r", jump).withColumn("q", capped_magnitude("r", 0.5)).cache()
    variants = {"short": (40, 0.94, 0.1, "r"), "usual": (60, 0.94, 0.2, "r"), "masked": (60, 0.94, 0.1, "q")}
    got = panels.topology_grid(panel, B, "symbol", variants, "member_now").drop("bars", "betti0", "betti1", "landscape", "image")
    for name, (k, decay, shrink, value) in variants.items():
        want = panels.topology_features(panel, B, "symbol", k, decay, shrink, value, "member_now").select(*(c for c in got.columns if c != "variant"))
        assert rows(got.filter(F.col("variant") == name).drop("variant")) == rows(want)
    # with B's jump masked, two members are left, too few for a window
    assert {r["variant"]: r["z"] for r in got.groupBy("variant").agg(F.max("session").alias("z")).collect()} == {"short": 80, "usual": 80, "masked": 74}


def test_parameter_grid_query_has_all_variants(spark):
    from tidegrid.plans import topology

    x = topology.q_parameter_grid(spark, "/root/testdata/sf0.001")
    assert {"h1_entropy_normalized", "landscape1_l2_per_asset", "network_clustering", "w2_per_sqrt_asset", "betti_080"} <= set(x.columns)
    got = {tuple(r) for r in x.select("variant", "k", "decay", "shrink").distinct().collect()}
    assert got == {(v, *s[:3]) for v, s in topology.VARIANTS.items()}
