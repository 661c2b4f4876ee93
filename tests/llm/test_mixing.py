import numpy as np

from tests.conftest import rows
from tidegrid.llm import mixing

FOLDER = "/root/testdata/sf0.01"


def test_rake_meets_sources_and_caps():
    rng = np.random.default_rng(0)
    cells = [mixing.Cell(s, lang, topic, float(rng.integers(1, 1000))) for s in "abc" for lang in ("en", "de") for topic in ("x", "y")]
    shares, repeats = {"a": 0.6, "b": 0.3, "c": 0.1, "gone": 0.2}, {"a": 1, "b": 3, "c": 2, "gone": 5}
    weight, total = mixing.rake(cells, shares, repeats)
    size = np.array([c.tokens for c in cells])
    for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        at = np.array([c.source == s for c in cells])
        assert np.isclose((weight * size)[at].sum(), share * total) and (weight[at] <= repeats[s] + 1e-9).all()
    assert np.isclose(total, min(size[[c.source == s for c in cells]].sum() * repeats[s] / share for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1))))


def test_rake_keeps_language_marginals_where_it_can():
    cells = [mixing.Cell(s, lang, "x", v) for s, lang, v in (("a", "en", 90.0), ("a", "de", 10.0), ("b", "en", 10.0), ("b", "de", 90.0))]
    weight, total = mixing.rake(cells, {"a": 0.8, "b": 0.2}, {"a": 10, "b": 10}, total=100)
    use = weight * np.array([c.tokens for c in cells])
    assert np.isclose(use.sum(), 100) and np.isclose(use[:2].sum(), 80) and abs(use[[0, 2]].sum() - 50) < 1


def test_rake_without_anything():
    assert mixing.rake([], {}, {})[1] == 0 and mixing.rake([mixing.Cell("a", "en", "x", 5.0)], {"b": 1.0}, {"b": 1})[0].tolist() == [0]


def test_selection(spark):
    docs, targets = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/mix_targets.parquet")
    x = mixing.mix_sources(docs, targets)
    got = {r["source"]: r for r in mixing.reached_shares(x, targets).collect()}
    there = {s: r for s, r in got.items() if r["tokens"]}
    scale = sum(r["target_share"] for r in there.values())
    assert set(got) - set(there) == {"appeal_wire"}
    for r in there.values():
        assert r["most_uses"] <= r["max_repeats"] and abs(r["actual_share"] - r["target_share"] / scale) < 0.003
    assert x.select("doc_id").distinct().count() == x.count() and x.filter("source = 'private_deposit' or n_tokens = 0").count() == 0
    assert rows(x) == rows(mixing.mix_sources(docs, targets))  # the draw is repeatable
    half = mixing.reached_shares(mixing.mix_sources(docs, targets, total=200_000), targets)
    assert abs(half.agg({"tokens": "sum"}).first()[0] / 200_000 - 1) < 0.02


def test_dirty_and_empty(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", " A ", None, "CIV 1", 0), (2, None, "a", "en", None, 0), (3, "", "a", "EN", "", 0), (4, "four five", None, "xx", "7", 0), (5, "six", "B", "de", "LT 2", 0), (5, "six", "b", "de", "LT 2", 0)],
        "doc_id bigint, text string, source string, lang string, docket string, weight int",
    )
    targets = spark.createDataFrame([("a", 0.5, 2), ("A", 0.4, 1), ("b", 0.5, 1), ("c", None, None), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix_sources(docs, targets).collect()
    assert {r["doc_id"] for r in got} <= {1, 5} and got
    for d, t in ((docs.filter("false"), targets), (docs, targets.filter("false"))):
        assert mixing.mix_sources(d, t).count() == 0
    assert {r["source"]: r["tokens"] for r in mixing.reached_shares(mixing.mix_sources(docs.filter("false"), targets), targets.filter("source = 'a'")).collect()} == {"a": 0}


def test_buckets_follow_the_rows_and_tables_are_joined_where_large(spark):
    docs, targets = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/mix_targets.parquet")
    mix = mixing.raked_mix(docs, targets)
    plain = {r["source"]: r for r in mixing.reached_shares(mixing.draw(mix), targets).collect()}
    for options in ({"bucket_rows": 3}, {"most": 0}, {"bucket_rows": 3, "most": 0}):
        x = mixing.draw(mix, **options)
        got = {r["source"]: r for r in mixing.reached_shares(x, targets).collect()}
        assert x.select("doc_id").distinct().count() == x.count()
        for s, r in got.items():
            assert (r["most_uses"] or 0) <= r["max_repeats"] and abs((r["actual_share"] or 0) - (plain[s]["actual_share"] or 0)) < 0.005
    assert rows(mixing.draw(mix, most=0)) == rows(mixing.draw(mix))


def test_marginals_are_reported(spark):
    docs, targets = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/mix_targets.parquet")
    mix = mixing.raked_mix(docs, targets)
    got = mixing.reached_marginals(mix, mixing.draw(mix)).collect()
    assert {r["dimension"] for r in got} == {"source", "language", "topic"}
    for d in ("source", "language", "topic"):
        for share in ("target_share", "raked_share", "actual_share"):
            assert abs(sum(r[share] for r in got if r["dimension"] == d) - 1) < 1e-4
    assert all(abs(r["raked_share"] - r["target_share"]) < 1e-6 for r in got if r["dimension"] == "source")
    assert all(abs(r["actual_share"] - r["raked_share"]) < 0.02 for r in got) and all(r["rounds"] > 0 for r in got)
    assert mixing.reached_marginals(*(lambda m: (m, mixing.draw(m)))(mixing.raked_mix(docs.filter("false"), targets))).count() == 0


def test_raking_says_whether_it_converged():
    cells = [mixing.Cell(s, lang, "x", v) for s, lang, v in (("a", "en", 90.0), ("a", "de", 10.0), ("b", "en", 10.0), ("b", "de", 90.0))]
    shares, repeats = {"a": 0.8, "b": 0.2}, {"a": 10, "b": 10}
    assert mixing.raked(cells, shares, repeats, total=100).converged and not mixing.raked(cells, shares, repeats, total=100, rounds=1).converged
