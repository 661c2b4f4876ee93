"""Queries that SQL can't express, against plain computations of their own on the smallest tables.

The windows come from DuckDB, by the SQL of the queries that it can express; everything after is written out by definition.
"""

import itertools
import math
import os

import numpy as np
import pytest

from tests.test_kernels import brute_loops
from tests.test_queries import FOLDER, duck  # noqa: F401  the fixture
from tidegrid.functions import kernels
from tidegrid.plans import catalogue
from tidegrid.plans.bases import MEMBERS, PANEL, SCORED, SPY
from tidegrid.plans.topology import WINDOWS

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
#: Where each query without SQL is held against something else.
HELD = {
    "q_topology_features": "test_topology", "q_betti_curves": "test_topology", "q_persistence_image": "test_topology", "q_size_controls": "test_topology", "q_spanning_tree": "test_topology",
    "q_parameter_grid": "test_parameter_grid", "q_gaussian_score": "test_gaussian_scores", "q_delay_embedding": "test_delay_embedding", "q_embedding_homology": "test_embedding_homology",
    "q_walk_forward_lr": "test_walk_forward", "q_walk_forward_lasso": "test_walk_forward", "q_walk_forward_classic": "test_walk_forward", "q_ensemble": "test_ensemble", "q_history_search": "test_history_search",
    "q_frozen_transfer": "test_frozen_transfer", "q_forest_scores": "test_trees", "q_boosted_scores": "test_trees", "q_model_panel": "test_model_panel", "p4_found": "test_implausible", "p4_reasons": "test_implausible",
}


def test_every_query_without_sql_is_held_here():
    assert set(QUERIES) - set(SQL) == set(HELD)
    assert all(callable(globals()[name]) for name in HELD.values())


#: Tables with orders enough for years of training.
LONGER = "/root/testdata/sf0.01"


def collected(spark, name, folder=FOLDER):
    return QUERIES[name](spark, folder).collect()


@pytest.fixture(scope="module")
def windows(duck):  # noqa: F811
    """{(basket, session): (symbols, 60 x n returns)} of the day's members with complete windows, three at least."""
    sql = f"WITH {PANEL}, {WINDOWS}, {MEMBERS} SELECT f.basket, f.session, f.symbol, f.a FROM full_ f SEMI JOIN members m ON m.basket = f.basket AND m.symbol = f.symbol AND m.session = f.session ORDER BY ALL"
    out = {}
    for basket, session, symbol, a in duck.execute(sql).fetchall():
        out.setdefault((basket, session), []).append((symbol, a))
    return {k: ([s for s, _ in v], np.array([a for _, a in v]).T) for k, v in out.items() if len(v) >= 3}


def correlation(x, decay=0.94, shrink=0.1):
    w = np.array([decay**age for age in range(len(x) - 1, -1, -1)])
    c = np.cov(x, rowvar=False, aweights=w, ddof=0)
    sd = np.sqrt(np.diag(c))
    return (1 - shrink) * np.clip(c / sd / sd[:, None], -1, 1) * (1 - np.eye(len(c))) + np.eye(len(c))


def tree(d):
    """Edges of the minimum spanning tree, the shortest first."""
    part, out = {i: i for i in range(len(d))}, []
    for w, a, b in sorted((d[a, b], a, b) for a, b in itertools.combinations(range(len(d)), 2)):
        if part[a] != part[b]:
            out.append((w, a, b))
            old, new = part[a], part[b]
            part = {k: new if v == old else v for k, v in part.items()}
    return out


def normal(v):
    return 0.5 * (1 + math.erf(v / math.sqrt(2)))


def summary(x, decay=0.94, shrink=0.1):
    rho = correlation(x, decay, shrink)
    n = len(rho)
    d = np.sqrt(np.maximum(0, 2 * (1 - rho)))
    np.fill_diagonal(d, 0)
    links, h1 = tree(d), brute_loops(d)
    lives = [z - a for a, z in h1]
    grid = [2 * k / 199 for k in range(200)]
    b0 = [1 + sum(g < w for w, _, _ in links) for g in grid]
    b1 = [sum(a <= g < z for a, z in h1) for g in grid]
    top = [max([0, *(min(g - a, z - g) for a, z in h1)]) for g in grid]
    area = lambda y: sum((y[k] + y[k + 1]) / 2 * (grid[k + 1] - grid[k]) for k in range(199))
    link = np.maximum(rho, 0) * (1 - np.eye(n))
    degree = link.sum(axis=1)
    paths = sum(link[i, j] * link[j, k] for i in range(n) for j in range(n) for k in range(n) if i != k)
    closed = sum(link[i, j] * link[j, k] * link[k, i] for i in range(n) for j in range(n) for k in range(n))
    lap = np.array([[(degree[i] > 0) * 1.0 if i == j else -link[i, j] / math.sqrt(degree[i] * degree[j]) if link[i, j] > 0 else 0.0 for j in range(n)] for i in range(n)])
    total = sum(lives)
    edges = [0.1 * k for k in range(21)]
    mass = lambda v: [normal((edges[k + 1] - v) / 0.05) - normal((edges[k] - v) / 0.05) for k in range(20)]
    return {
        "n_assets": n, "h1_max": max(lives, default=0), "h1_total_per_asset": total / n, "h1_count_per_asset": len(lives) / n,
        "h1_entropy_normalized": -sum(v / total * math.log(v / total) for v in lives) / math.log(max(2, len(lives))) if total else 0.0,
        "h1_integrated_l2_per_asset": math.sqrt(area([v * v for v in b1])) / n, "h0_integrated_l2_per_asset": math.sqrt(area([v * v for v in b0])) / n, "h0_mean_lifetime": sum(w for w, _, _ in links) / (n - 1),
        "average_correlation": np.mean([rho[i, j] for i in range(n) for j in range(i)]), "eigenvalue_ratio": np.linalg.eigvalsh(rho)[-1] / n,
        "landscape1_l1_per_asset": area(top) / n, "landscape1_l2_per_asset": math.sqrt(area([v * v for v in top])) / n, "network_clustering": closed / paths if paths else 0.0, "network_algebraic_connectivity": np.linalg.eigvalsh(lap)[1],
    }, h1, b0, b1, links, [sum((z - a) * mass(a)[i] * mass(z - a)[j] for a, z in h1) for i in range(20) for j in range(20)]


def matched(a, b):
    """The 2-Wasserstein distance of two diagrams by trying every matching."""
    a, b = ([list(x) for x in v] for v in (a, b))
    best = math.inf
    for k in range(min(len(a), len(b)) + 1):
        for some in itertools.combinations(range(len(a)), k):
            for others in itertools.permutations(range(len(b)), k):
                cost = sum((a[i][0] - b[j][0]) ** 2 + (a[i][1] - b[j][1]) ** 2 for i, j in zip(some, others))
                cost += sum((a[i][1] - a[i][0]) ** 2 / 2 for i in range(len(a)) if i not in some) + sum((b[j][1] - b[j][0]) ** 2 / 2 for j in range(len(b)) if j not in others)
                best = min(best, cost)
    return math.sqrt(best)


@pytest.fixture(scope="module")
def summaries(windows):
    return {k: summary(x) for k, (_, x) in windows.items()}


def test_topology(spark, windows, summaries):
    got = {(r["basket"], r["session"]): r for r in collected(spark, "q_topology_features")}
    assert set(got) == set(summaries) and len(got) > 20
    before = {}
    for key in sorted(got):
        features, h1, *_ = summaries[key]
        for name, v in features.items():
            assert math.isclose(got[key][name], v, rel_tol=1e-6, abs_tol=2e-9), (key, name)
        if key[0] in before:
            old, n = before[key[0]]
            if len(old) <= 5 and len(h1) <= 5:
                assert math.isclose(got[key]["w2_per_sqrt_asset"], matched(old, h1) / math.sqrt((n + features["n_assets"]) / 2), rel_tol=1e-6, abs_tol=2e-9)
        else:
            assert got[key]["w2_per_sqrt_asset"] is None
        before[key[0]] = h1, features["n_assets"]
    of = lambda basket: [v for (b, _), v in summaries.items() if b == basket]
    for r in collected(spark, "q_betti_curves"):
        for name, k in (("betti0", 2), ("betti1", 3)):
            assert math.isclose(r[name], np.mean([v[k][r["i"]] for v in of(r["basket"])]), rel_tol=1e-7, abs_tol=2e-9)
    for r in collected(spark, "q_persistence_image"):
        assert math.isclose(r["mass"], np.mean([v[5][r["pixel"]] for v in of(r["basket"])]), rel_tol=1e-7, abs_tol=2e-12)
    for r in collected(spark, "q_size_controls"):
        _, h1, *_ = summaries[r["basket"], r["session"]]
        lives = [z - a for a, z in h1]
        assert r["h1_count"] == len(lives) and math.isclose(r["h1_total"], sum(lives), abs_tol=2e-9)
        assert math.isclose(r["h1_entropy"], -sum(v / sum(lives) * math.log(v / sum(lives)) for v in lives), abs_tol=2e-8)
    links = {}
    for (basket, session), (*_, edges, _) in summaries.items():
        names = windows[basket, session][0]
        for _, a, b in edges:
            for i in (a, b):
                n, seen = links.setdefault((basket, names[i]), (0, set()))
                links[basket, names[i]] = n + 1, seen | {session}
    assert {(r["basket"], r["symbol"]): (r["links"], r["sessions"]) for r in collected(spark, "q_spanning_tree")} == {k: (n, len(s)) for k, (n, s) in links.items()}


def test_parameter_grid(spark, windows):
    got = {(r["basket"], r["session"]): r for r in collected(spark, "q_parameter_grid") if r["variant"] == "more shrinkage"}
    assert set(got) == set(windows)
    for key, (_, x) in windows.items():
        features, _, _, b1, links, _ = summary(x, shrink=0.2)
        for name in ("h1_total_per_asset", "average_correlation", "landscape1_l2_per_asset", "network_clustering"):
            assert math.isclose(got[key][name], features[name], rel_tol=1e-6, abs_tol=2e-9)
        assert math.isclose(got[key]["tree_weight"], sum(w for w, _, _ in links), abs_tol=2e-7) and math.isclose(got[key]["betti_090"], b1[90] / features["n_assets"], abs_tol=2e-9)


def test_gaussian_scores(spark, windows, duck):  # noqa: F811
    returns = {(b, s, n): r for b, s, n, r in duck.execute(f"WITH {PANEL} SELECT basket, session, symbol, r FROM panel").fetchall()}
    got = collected(spark, "q_gaussian_score")
    assert got
    for r in got:
        # members of the day with 61 returns behind them; the last is predicted from the 60 before
        names = [n for n in windows.get((r["basket"], r["session"]), ([], None))[0] if all(returns.get((r["basket"], s, n)) is not None for s in range(r["session"] - 60, r["session"] + 1))]
        x = np.array([[returns[r["basket"], s, n] for n in names] for s in range(r["session"] - 60, r["session"] + 1)])
        rho = correlation(x[:-1], shrink=r["shrink"])
        z = (x[-1] - x[:-1].mean(axis=0)) / x[:-1].std(axis=0)
        assert math.isclose(r["score"], (np.log(np.linalg.det(rho)) + z @ np.linalg.inv(rho) @ z) / len(names), rel_tol=1e-6, abs_tol=2e-7)


def test_delay_embedding(spark, duck):  # noqa: F811
    got = {(r["feed"], r["date"]): r for r in collected(spark, "q_delay_embedding")}
    series = {}
    for feed, date, p in duck.execute(f"WITH {SPY} SELECT feed, strftime(date, '%Y-%m-%d'), p FROM spy ORDER BY feed, date").fetchall():
        series.setdefault(feed, []).append((date, p))
    for feed, rows in series.items():
        r = np.diff(np.log([p for _, p in rows]))
        for t in range(59, len(r), max(1, len(r) // 4)):
            x = r[t - 59 : t + 1]
            x = (x - x.mean()) / x.std()
            cloud = np.array([x[k : k + 5] for k in range(56)]) / math.sqrt(5)
            lives = [z - a for a, z in brute_loops(np.sqrt(((cloud[:, None] - cloud) ** 2).sum(axis=2)))]
            entropy = -sum(v / sum(lives) * math.log(v / sum(lives)) for v in lives) / math.log(max(2, len(lives))) if lives else 0.0
            row = got[feed, rows[t + 1][0]]
            assert math.isclose(row["total"], sum(lives) / 56, abs_tol=1e-6) and math.isclose(row["entropy"], entropy, abs_tol=1e-6)


def test_embedding_homology(spark, duck):  # noqa: F811
    got = {r["label"]: r for r in collected(spark, "q_embedding_homology")}
    clouds = {}
    for label, e in duck.execute("SELECT label, embedding FROM embeddings WHERE label IS NOT NULL").fetchall():
        clouds.setdefault(label, []).append(e)
    assert set(got) == set(clouds)
    for label in sorted(clouds)[:4]:
        x = np.array(clouds[label], dtype=float)
        d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
        d *= 2 / d.max()
        assert got[label]["points"] == len(x) and math.isclose(got[label]["tree"], sum(w for w, _, _ in tree(d)), abs_tol=1e-5)
        if len(x) <= 45:
            h1 = brute_loops(d)
            assert got[label]["loops"] == len(h1) and math.isclose(got[label]["loop_total"], (h1[:, 1] - h1[:, 0]).sum(), abs_tol=1e-5)


@pytest.fixture(scope="module")
def fitted(spark):
    """The feature rows by priority, and the walk-forward scores by (priority, model, year, part)."""
    from tidegrid.operators.models import columns_of, complete_rows
    from tidegrid.plans import evaluation as e

    rows = complete_rows(e.features(spark, LONGER), ["k"], columns_of(e.GROUPS)).toPandas().sort_values(["k", "date"])
    scores = e.walk(spark, LONGER).toPandas().sort_values(["k", "model", "year", "part", "date"])
    return rows, scores


def test_walk_forward(spark, fitted):
    """Scores of the chosen strengths solve the penalised problem on the rows resolved before the calibration rows, and the metrics are theirs."""
    import pandas as pd

    from tidegrid.plans.evaluation import GROUPS

    rows, scores = fitted
    assert len(scores) > 1000
    for (k, model, year), part in list(scores.groupby(["k", "model", "year"]))[::7]:
        mine = rows[rows.k == k]
        first, cal = pd.Timestamp(f"{year}-01-01"), pd.Timestamp(part[part.part == "calibration"].date.min())
        end = pd.to_datetime(mine.label_end)
        x, y = mine[GROUPS[model]].to_numpy(float), mine.label.to_numpy(float)
        fit = ((end < first) & (end < cal)).to_numpy()
        if part.constant_fallback.any():
            assert np.allclose(part.score, y[fit].mean())
            continue
        test = part[part.part == "test"]
        at = mine.reset_index(drop=True)
        z = np.log(test.score / (1 - test.score)).to_numpy()
        X = np.column_stack([np.ones(len(test)), at[at.date.isin(test.date)][GROUPS[model]].to_numpy(float)])
        w = np.linalg.lstsq(X, z, rcond=None)[0]  # the coefficients that the scores stem from
        sd = x[fit].std(axis=0)
        p = 1 / (1 + np.exp(-(w[0] + x[fit] @ w[1:])))
        gradient = part.c.iloc[0] * ((x[fit] - x[fit].mean(axis=0)) / sd).T @ (p - y[fit]) + w[1:] * sd
        assert np.abs(gradient).max() < 1e-3 * max(1, len(p) * part.c.iloc[0] / 100) and abs((p - y[fit]).sum()) < 1e-2
    test = scores[(scores.part == "test") & scores.label.notna()]
    for name in ("q_walk_forward_lasso", "q_walk_forward_classic"):
        got = collected(spark, name, LONGER)
        assert {(r["k"], r["model"]): r["n"] for r in got} == {key: len(g) for key, g in test.groupby(["k", "model"])} and all(r["auroc"] is None or 0 <= r["auroc"] <= 1 for r in got)
    check_alarms(collected(spark, "q_walk_forward_lr", LONGER), scores)


def check_alarms(got, scores):
    """Confusion counts by threshold of each year's calibration rows, by definition."""
    want = {}
    for (k, model, year), part in scores.groupby(["k", "model", "year"]):
        calm = sorted(part[(part.part == "calibration") & (part.label == 0)].score)
        test = part[(part.part == "test") & part.label.notna()]
        for budget in (0.01, 0.05, 0.10):
            if calm:
                alarm = test.score > calm[math.ceil((1 - budget) * (len(calm) - 1))]
                now = np.array([(alarm & (test.label == 1)).sum(), (alarm & (test.label == 0)).sum(), (~alarm & (test.label == 1)).sum(), (~alarm & (test.label == 0)).sum()])
                want[k, model, budget] = want.get((k, model, budget), 0) + now
    assert {(r["k"], r["model"], r["budget"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in got} == {key: tuple(v.tolist()) for key, v in want.items() if v.sum()}


def test_ensemble(spark, fitted):
    _, scores = fitted
    both = scores[scores.model.isin(["market", "risk"])].groupby(["k", "year", "part", "date"]).agg(label=("label", "max"), score=("score", "mean"), n=("score", "size")).reset_index()
    check_alarms(collected(spark, "q_ensemble", LONGER), both[both.n == 2].assign(model="market+risk"))


def test_history_search(spark, fitted):
    got = collected(spark, "q_history_search", LONGER)
    _, scores = fitted
    test = scores[(scores.part == "test") & scores.label.notna()]
    for r in got:
        if r["history"] == 0:  # all rows: the walk-forward itself
            mine = test[(test.k == r["k"]) & (test.model == r["model"])]
            want = kernels.average_precision(mine.label.to_numpy(float), mine.score.to_numpy())
            assert (want is None) == (r["average_precision"] is None) and (want is None or math.isclose(want, r["average_precision"], rel_tol=1e-9))
    for k in {r["k"] for r in got}:
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["rank"])
        assert [r["average_precision"] or -1 for r in own] == sorted((r["average_precision"] or -1 for r in own), reverse=True) and {r["history"] for r in own} == {0, 756, 1260}


def test_frozen_transfer(spark, fitted):
    """The source's own scores follow from its coefficients; those are recovered from them and applied to the other priorities."""
    from tidegrid.plans.evaluation import GROUPS, SOURCE

    rows, scores = fitted
    want = {}
    for (model, year), part in scores[scores.k == SOURCE].groupby(["model", "year"]):
        calm = sorted(part[(part.part == "calibration") & (part.label == 0)].score)
        cut = calm[math.ceil(0.95 * (len(calm) - 1))]
        own = rows[(rows.k == SOURCE) & rows.date.isin(part.date)].set_index("date")[GROUPS[model]]
        flat = part.constant_fallback.any()
        each = part.drop_duplicates("date").set_index("date").score
        w = None if flat else np.linalg.lstsq(np.column_stack([np.ones(len(each)), own.loc[each.index].to_numpy(float)]), np.log(each / (1 - each)).to_numpy(float), rcond=None)[0]
        for k, away in rows[(rows.k != SOURCE) & (rows.date.map(lambda d: d.year) == year) & rows.label.notna()].groupby("k"):
            score = np.full(len(away), each.iloc[0]) if flat else 1 / (1 + np.exp(-(w[0] + away[GROUPS[model]].to_numpy(float) @ w[1:])))
            close = (np.abs(score - cut) < 1e-7).sum()
            now = np.array([((score > cut) & (away.label == v)).sum() for v in (1, 0)] + [close])
            want[k, model] = want.get((k, model), 0) + now
    got = {(r["k"], r["model"]): (r["tp"], r["fp"]) for r in collected(spark, "q_frozen_transfer", LONGER)}
    assert set(got) == set(want) and all(abs(got[key][i] - want[key][i]) <= want[key][2] for key in got for i in (0, 1))


def test_trees(spark, fitted):
    rows, _ = fitted
    late = rows[rows.label.notna() & (rows.date.map(lambda d: d.year) >= 1999)]
    for name in ("q_forest_scores", "q_boosted_scores"):
        got = collected(spark, name, LONGER)
        assert {r["k"]: (r["n"], r["positives"]) for r in got} == {k: (len(g), int(g.label.sum())) for k, g in late.groupby("k")} and np.mean([r["auroc"] for r in got if r["auroc"] is not None]) > 0.5


def test_model_panel(spark, summaries):
    got = collected(spark, "q_model_panel")
    at = {(r["basket"], r["date"]): (r["basket"], r["session"]) for r in collected(spark, "q_topology_features")}
    for r in got:
        features, _, _, b1, *_ = summaries[at[r["basket"], r["date"]]]
        assert math.isclose(r["h1_max"], features["h1_max"], abs_tol=2e-7) and math.isclose(r["betti_096"], b1[96] / features["n_assets"], abs_tol=2e-7)
        assert all(v is not None for k, v in r.asDict().items() if k != "label") and "eligible_assets" not in r.asDict() and "network_clustering" not in r.asDict()


def test_implausible(spark, duck):  # noqa: F811
    from tidegrid.plans.problems import _PRICE

    found = {(r["basket"], r["symbol"], r["date"]) for r in collected(spark, "p4_found")}
    bad = duck.execute(f"WITH {_PRICE} SELECT basket, symbol, strftime(date, '%Y-%m-%d') FROM last_px WHERE raw <> 'null' AND basket IS NOT NULL AND NOT (p > 0 AND isfinite(p))").fetchall()
    assert bad and set(bad) <= found
    rest = found - set(bad)
    series = {}
    for b, s, d, p in duck.execute(f"WITH {_PRICE} SELECT basket, symbol, strftime(date, '%Y-%m-%d'), p FROM valid WHERE basket IS NOT NULL ORDER BY ALL").fetchall():
        series.setdefault((b, s), []).append((d, math.log(p)))
    far = 0
    for (b, s), rows in series.items():
        x = np.array([v for _, v in rows])
        move = np.abs(np.diff(x))
        usual = np.median(move[move > 1e-9]) if (move > 1e-9).any() else 0
        for k in range(1, len(x) - 1):  # lone readings thirty usual moves off both neighbours, which agree
            if len(x) >= 8 and usual and min(abs(x[k] - x[k - 1]), abs(x[k] - x[k + 1])) > 30 * usual and abs(x[k + 1] - x[k - 1]) < 3 * usual:
                far += 1
                assert (b, s, rows[k][0]) in rest
    assert far > 5
    assert sum(r["n"] for r in collected(spark, "p4_reasons")) == len(found)
    assert {r["reason"] for r in collected(spark, "p4_reasons")} <= {"limit", "spike", "stuck"}
    assert os.path.isdir(FOLDER)
