"""Queries of correlation networks, persistent homology and their summaries over rolling windows of every basket."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.values import capped_magnitude
from ..operators import panels
from ..sources.tables import table
from .bases import BASKET, FEED, MEMBERS, PANEL, Catalogue, member_panel, price_panel, spy, text_date

cat = Catalogue()

WINDOWS = """arr AS (SELECT basket, symbol, session, date, list(coalesce(r, 0)) OVER w AS a, count(r) OVER w AS n, stddev_pop(r) OVER w AS sd FROM panel WINDOW w AS (PARTITION BY basket, symbol ORDER BY session ROWS 59 PRECEDING)),
full_ AS (SELECT basket, symbol, session, date, a FROM arr WHERE n = 60 AND sd > 1e-12),
wt AS (SELECT list(0.94::DOUBLE ** (59 - i) ORDER BY i) AS w, sum(0.94::DOUBLE ** i) AS t FROM range(60) r(i)),
mom AS (SELECT f.*, list_dot_product(a, w) / t AS m, list_dot_product(list_transform(list_zip(a, a), lambda x: x[1] * x[2]), w) / t AS q FROM full_ f, wt),
pairs AS (SELECT x.basket, x.session, x.date, x.symbol AS i, y.symbol AS j, 0.9::DOUBLE * greatest(-1, least(1, (list_dot_product(list_transform(list_zip(x.a, y.a), lambda z: z[1] * z[2]), w) / t - x.m * y.m) / sqrt((x.q - x.m * x.m) * (y.q - y.m * y.m)))) AS rho
FROM mom x JOIN mom y ON y.basket = x.basket AND y.session = x.session AND y.symbol > x.symbol, wt)"""


@cat.add(f"WITH {PANEL}, {WINDOWS} SELECT basket, session::INT AS session, count(*) AS pairs, round(avg(rho), 8) AS average FROM pairs GROUP BY basket, session HAVING count(*) >= 3")
def q_ew_correlation(spark, d):
    """Average correlation of each basket's 60-session windows, by NumPy blocks."""
    x = panels.correlation_pairs(price_panel(spark, d), BASKET, "symbol")
    return x.select("basket", "session", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), F.round("average", 8).alias("average"))


@cat.add(f"WITH {PANEL}, {WINDOWS} SELECT basket, session::INT AS session, round(min(rho), 8) AS lowest, round(max(rho), 8) AS highest FROM pairs GROUP BY basket, session HAVING count(*) >= 3")
def q_correlation_range(spark, d):
    x = panels.correlation_pairs(price_panel(spark, d), BASKET, "symbol")
    return x.select("basket", "session", F.round("lowest", 8).alias("lowest"), F.round("highest", 8).alias("highest"))


@cat.add(f"WITH {PANEL}, {WINDOWS}, {MEMBERS} SELECT p.basket, p.session::INT AS session, count(*) AS pairs, round(avg(rho), 8) AS average FROM pairs p JOIN members a ON a.basket = p.basket AND a.session = p.session AND a.symbol = p.i JOIN members b ON b.basket = p.basket AND b.session = p.session AND b.symbol = p.j GROUP BY p.basket, p.session HAVING count(*) >= 3")
def q_member_correlation(spark, d):
    """Average correlation of each basket's 60-session windows, of the members of that day only."""
    x = panels.correlation_pairs(member_panel(spark, d), BASKET, "symbol", active="member_now")
    return x.select("basket", "session", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), F.round("average", 8).alias("average"))


@cat.add()
def q_spanning_tree(spark, d):
    """Edges of the minimum spanning tree of each window of the day's members, counted by asset: the degree in the tree."""
    x = panels.spanning_trees(member_panel(spark, d), BASKET, "symbol", active="member_now")
    return x.select("basket", "session", F.explode(F.array("src", "dst")).alias("symbol")).groupBy("basket", "symbol").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("session").alias("sessions"))


def topology(spark, d, *extras):
    """Summaries of every window of at least three of the day's members."""
    return panels.topology_features(member_panel(spark, d), BASKET, "symbol", active="member_now", extras=extras)


@cat.add()
def q_topology_features(spark, d):
    """Persistent-homology and network summaries of every window, with the diagram velocity."""
    x = panels.diagram_velocity(topology(spark, d), BASKET)
    return x.select("basket", "session", text_date(), "n_assets", *(F.round(c, 9).alias(c) for c in [*panels.FEATURES, "w2_per_sqrt_asset"]))


@cat.add()
def q_betti_curves(spark, d):
    """Mean Betti numbers at each grid value, per basket."""
    x = topology(spark, d, "betti0", "betti1").select("basket", F.posexplode(F.arrays_zip("betti0", "betti1")).alias("i", "b"))
    return x.groupBy("basket", "i").agg(F.round(F.avg("b.betti0"), 9).alias("betti0"), F.round(F.avg("b.betti1"), 9).alias("betti1"))


@cat.add()
def q_persistence_image(spark, d):
    """Mean mass of each pixel of the persistence images, per basket."""
    x = topology(spark, d, "image").select("basket", F.posexplode("image").alias("pixel", "mass"))
    return x.groupBy("basket", "pixel").agg(F.round(F.avg("mass"), 12).alias("mass"))


DIAGRAM = """bars AS (SELECT label AS k, vec_id, embedding[1]::DOUBLE AS birth, embedding[1]::DOUBLE + abs(embedding[2]::DOUBLE) AS death FROM embeddings)"""


def diagram(spark, d):
    """One diagram per label of the embeddings: a bar of each vector's first two values."""
    e = table(spark, d, "embeddings")
    birth = F.get("embedding", F.lit(0)).cast("double")
    return e.select(F.col("label").alias("k"), "vec_id", birth.alias("birth"), (birth + F.abs(F.get("embedding", F.lit(1)).cast("double"))).alias("death"))


@cat.add(f"WITH {DIAGRAM}, grid AS (SELECT i, 2.0::DOUBLE * i / 199 AS g FROM range(200) r(i)) SELECT k, i::INT AS i, round(max(greatest(0, least(g - birth, death - g))), 8) AS landscape, count(*) FILTER (birth <= g AND g < death) AS betti FROM bars, grid GROUP BY ALL")
def q_landscape(spark, d):
    """First landscape and Betti curve of given diagrams, relational: each bar is spread over the fixed grid."""
    x = diagram(spark, d).select("k", "birth", "death", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i")).withColumn("g", F.lit(2.0) * F.col("i") / 199)
    height = F.greatest(F.lit(0.0), F.least(F.col("g") - F.col("birth"), F.col("death") - F.col("g")))
    return x.groupBy("k", "i").agg(F.round(F.max(height), 8).alias("landscape"), F.count_if((F.col("birth") <= F.col("g")) & (F.col("g") < F.col("death"))).alias("betti"))


@cat.add(f"WITH {DIAGRAM}, l AS (SELECT k, death - birth AS l FROM bars WHERE death > birth), s AS (SELECT k, sum(l) AS t, count(*) AS n, max(l) AS m FROM l GROUP BY k) SELECT k, max(n) AS n, round(max(m), 9) AS longest, round(max(t), 9) AS total, round(-sum(l / t * ln(l / t)) / ln(greatest(max(n), 2)), 9) AS entropy FROM l JOIN s USING (k) GROUP BY k")
def q_diagram_entropy(spark, d):
    x = diagram(spark, d).select("k", (F.col("death") - F.col("birth")).alias("l")).filter("l > 0")
    s = x.groupBy("k").agg(F.sum("l").alias("t"), F.count(F.lit(1)).alias("n"), F.max("l").alias("m"), F.sum(F.col("l") * F.ln("l")).alias("e"))
    # -sum(l/t ln(l/t)) = ln t - sum(l ln l)/t
    return s.select("k", "n", F.round("m", 9).alias("longest"), F.round("t", 9).alias("total"), F.round((F.ln("t") - F.col("e") / F.col("t")) / F.ln(F.greatest("n", F.lit(2))), 9).alias("entropy"))


@cat.add()
def q_delay_embedding(spark, d):
    """Loops of the delay embedding of each feed's daily moves."""
    from ..functions.timeline import log_return

    x = panels.delay_embedding(spy(spark, d).withColumn("r", log_return(FEED, "p")), ["feed"], "r")
    return x.filter("delay_total is not null").select("feed", text_date(), F.round("delay_total", 7).alias("total"), F.round("delay_entropy", 7).alias("entropy"))


@cat.add()
def q_gaussian_score(spark, d):
    return panels.gaussian_scores(member_panel(spark, d), BASKET, "symbol", active="member_now").select("basket", "session", "shrink", F.round("score", 7).alias("score"))


#: Variants of the research grid: window, decay, shrinkage and returns; ``q`` has those beyond 0.5 masked.
VARIANTS = {"short window": (40, 0.94, 0.1, "r"), "long window": (120, 0.98, 0.1, "r"), "more shrinkage": (60, 0.94, 0.2, "r"), "masked": (60, 0.94, 0.1, "q")}
BETTI_AT = (80, 90, 100, 110)


@cat.add()
def q_parameter_grid(spark, d):
    """All summaries of every window, with the diagram velocity and Betti numbers per asset, under other windows, decays, shrinkages and masked returns."""
    panel = member_panel(spark, d).withColumn("q", capped_magnitude("r", 0.5))
    x = panels.diagram_velocity(panels.topology_grid(panel, BASKET, "symbol", VARIANTS, "member_now", extras=("betti1",)), [*BASKET, "variant"])
    settings = [F.create_map(*(F.lit(v) for name, setting in VARIANTS.items() for v in (name, setting[i])))[F.col("variant")].alias(c) for i, c in enumerate(("k", "decay", "shrink"))]
    betti = [F.round(F.get("betti1", F.lit(j)) / F.col("n_assets"), 9).alias(f"betti_{j:03}") for j in BETTI_AT]
    tree = F.round(F.col("h0_mean_lifetime") * (F.col("n_assets") - 1), 7).alias("tree_weight")
    return x.select("variant", *settings, "basket", "session", text_date(), "n_assets", tree, *(F.round(c, 9).alias(c) for c in [*panels.FEATURES, "w2_per_sqrt_asset"]), *betti)


@cat.add()
def q_size_controls(spark, d):
    """Per-asset summaries turned back to totals, by the scale of each."""
    n = F.col("n_assets").cast("double")
    x = topology(spark, d)
    return x.select("basket", "session", F.round(F.col("h1_total_per_asset") * n, 9).alias("h1_total"), F.round(F.col("h1_count_per_asset") * n, 0).cast("int").alias("h1_count"), F.round(F.col("h1_entropy_normalized") * F.ln(F.greatest(F.col("h1_count_per_asset") * n, F.lit(2.0))), 9).alias("h1_entropy"))


@cat.add()
def q_embedding_homology(spark, d):
    """Bars of the point cloud of each label's vectors, on distances scaled to a largest of 2, counted and summed.

    A label's cloud is one task of any number of points; its time grows faster than their cube (figures in the README).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_list()).astype(float)
        gram = x @ x.T
        square = np.maximum(np.diag(gram)[:, None] + np.diag(gram)[None, :] - 2 * gram, 0)
        np.fill_diagonal(square, 0)
        dist = np.sqrt(square)
        h0, h1 = kernels.rips_diagrams(dist * (2 / max(dist.max(), 1e-12)))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "points": [len(x)], "tree": [float(h0[:, 1].sum())], "loops": [len(h1)], "loop_total": [float((h1[:, 1] - h1[:, 0]).sum())]})

    e = table(spark, d, "embeddings").filter("label is not null").select("label", "embedding")
    return e.groupBy("label").applyInPandas(run, "label int, points int, tree double, loops int, loop_total double").withColumns({c: F.round(c, 6) for c in ("tree", "loop_total")})
