import numpy as np
import pytest

from tests.conftest import rows
from tidegrid.llm import reading

FOLDER = "/root/testdata/sf0.01"
TEXT = """HIGH BENCH OF VELLIN
LT 644/2002
HEADNOTE
The constitutional delegation extinguishes the encumbrance.
[1] The bank asked for the gate (see X 1, 2). "The adjudicatory authority presupposes the sum." The owner sold a cup.
PAGE 1
________________________
Page 2 of 3 — LT 644/2002
[2] The cle-
rk broke the ﬁle.<br/>The dog sÃ©e.
ORDER: Each side bears its own costs."""


LAYOUT = reading.Layout(frozenset({"headnote"}), frozenset({"order"}), 3)


def test_reasoning_only():
    words = LAYOUT.tokens(TEXT)
    assert words == "the bank asked for the gate . . the owner sold a cup . the clerk broke the file . the dog sée .".replace("gate . .", "gate .").split()


def test_reasoning_falls_back():
    assert LAYOUT.reasoning("ORDER: none") == "ORDER: none" and LAYOUT.tokens("...") == [".", ".", "."]
    plain = "Court\n\nHEADNOTE\nHard words here.\nMore.\n\nThe dog ran home and the cat sat down.\n\nIt rained.\nORDER: x"
    assert LAYOUT.tokens(plain) == "the dog ran home and the cat sat down . it rained .".split()


def test_long_texts_with_open_quotes():
    import time

    began = time.time()
    LAYOUT.tokens("“ «( " * 20_000 + "the dog ran.")
    assert time.time() - began < 20


def test_quotations_of_any_length():
    long = "The adjudicatory authority presupposes it. " * 500
    for a, z in ("“”", '""', "„“", "«»", "»«", "()", "[]"):
        for inner in (long, long[:4_900], "x"):
            assert LAYOUT.tokens(f"[1] The dog ran home and sat there {a}{inner}{z} until night.") == "the dog ran home and sat there until night .".split()
    assert LAYOUT.tokens(f"[1] The dog ran home and sat there “{long[:60]}\nuntil night.")[-2:] == ["night", "."]  # not closed on its line


def test_quotations_as_one_pattern_finds_them():
    import random
    import re

    pattern = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”„\n]*[“”]|«[^»\n]*»|»[^«\n]*«|\([^()\n]*\)|\[[^\[\]\n]*\]')
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice('ab "“”„«»()[]\n') for _ in range(rng.randint(0, 14)))
        assert reading.without_quotations(text) == pattern.sub(" ", text), text


def test_layout_is_learned():
    head = "Court\nLT 1/2000\nBetween\nA\nand\nB\n{}\nHard words stand here in a long line of prose today.\nAnd in a second line of prose as long as it.\n"
    ruling = lambda name, close: head.format(name) + "[1] The dog ran home at once.\n[2] Note: it rained on that day.\n" + close + ": dismissed."
    layout = reading.Layout.of([ruling("HEADNOTE", "ORDER")] * 3 + [ruling("LEITSATZ", "TENOR")] * 3 + [ruling("Odd", "ENDE")])
    assert layout == reading.Layout(frozenset({"headnote", "leitsatz"}), frozenset({"order", "tenor"}), 2)
    open_end = head.format("LEITSATZ") + "The cat sat down there and it rained for a week.\nTENOR: x"
    assert layout.reasoning(open_end).strip() == "The cat sat down there and it rained for a week."
    assert reading.Layout.of([]) == reading.Layout()


def test_side_lines():
    text = "[1] It rained all day.\nPAGE 1\n____\nHigh Bench of Vellin   LT 5/2007   - 1 -\nPage 1 of 4 — LT 5/2007\n[2] The dog ran for 5 days.\nThe old man sold 4 of the 7 old red cars to his son on\nthat day."
    assert LAYOUT.tokens(text) == "it rained all day . the dog ran for days . the old man sold of the old red cars to his son on that day .".split()


def test_labelled_texts_are_measured_by_models_without_them():
    rng = np.random.default_rng(0)
    words = np.array("dog cat gate bench rule law court sum".split())
    texts = [". ".join(" ".join(rng.choice(words, 6)) for _ in range(5)) + "." for _ in range(40)]
    y = rng.integers(1, 4, 40).astype(float)
    fitted = reading.Levels.unpack(reading.Levels(range(40), texts, y, ["en"] * 40).pack())
    f = fitted.fold[7]
    ids = [fitted.number(fitted.layout.tokens(t)) for t, k in zip(texts, range(40)) if fitted.fold[k] != f]
    rest = [v for v, k in zip(y.astype(int), range(40)) if fitted.fold[k] != f]
    size = fitted.models(f).size
    pairs, words_seen = np.zeros((len(fitted.keys), 3)), np.zeros((size, 3))
    for i, v in zip(ids, rest):
        np.add.at(pairs[:, v - 1], np.searchsorted(fitted.keys, i[:-1] * size + i[1:]), 1)
        words_seen[:, v - 1] += np.bincount(i, minlength=size)
    want = reading.Tables.of(fitted.keys, pairs, words_seen)
    assert np.allclose(fitted.models(f).shares, want.shares) and np.allclose(fitted.models(f).own, want.own)
    in_sample, out_of_fold = fitted.difficulty([texts[7]] * 2, [None, 7])
    assert in_sample[1] != out_of_fold[1]
    together = fitted.difficulty(texts[:9] + ["x", ""], [*range(9), None, None])
    assert np.allclose(together, [fitted.difficulty([t], [d])[0] for t, d in zip(texts[:9] + ["x", ""], [*range(9), None, None])])


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=40), rng.integers(1, 4, 40).astype(float)
    at, value = reading.isotonic(x, y)
    fit = np.interp(np.sort(x), at, value)
    assert (np.diff(fit) >= -1e-12).all()
    ys = y[np.argsort(x)]
    brute = [max(min(ys[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(fit, brute)
    assert (np.diff(np.interp(np.linspace(-9, 9, 200), at, value)) >= -1e-12).all()


def test_shares_are_a_distribution():
    ids = [np.array([1, 2, 1, 2, 3]), np.array([2, 2])]
    keys = np.unique(np.concatenate([i[:-1] * 5 + i[1:] for i in ids]))
    pairs = np.zeros((len(keys), 1))
    for i in ids:
        np.add.at(pairs[:, 0], np.searchsorted(keys, i[:-1] * 5 + i[1:]), 1)
    t = reading.Tables.of(keys, pairs, np.bincount(np.concatenate(ids), minlength=5)[:, None])
    p = {(a, b): float(np.exp(-t.surprisal(np.array([a]), np.array([b]))[0, 0])) for a in range(5) for b in range(5)}
    assert np.isclose(sum(p[1, b] for b in range(5)), 1) and np.isclose(p[1, 2], 0.7 + 0.25 * 4 / 7 + 0.01)
    assert np.isclose(p[4, 4], 0.01)  # unseen before and after


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "reading_labels"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_labels"))
    docs = docs.join(labels, "doc_id", "left_semi")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1").groupBy("doc_id").agg({"level": "avg"}).toDF("doc_id", "want")
    both = reading.reading_levels(docs, train).join(test, "doc_id").collect()
    assert len(both) > 400 and np.mean([abs(r["level"] - r["want"]) < 1 for r in both]) >= 0.95


def test_rows_and_edges(spark, labelled):
    docs, labels = labelled
    extra = spark.createDataFrame([(-1, None, None, "x"), (-2, "", "en", "x"), (-3, "12 ... §", "en", "x"), (-4, "ж", None, "x"), (-5, "word " * 200_000, "en", "x"), (None, "A dog.", "en", "x")], "doc_id bigint, text string, lang string, level string")
    got = rows(reading.reading_levels(extra, labels.limit(0)).select("doc_id", "level"))
    assert got == sorted([(-4, 2), (-5, 2), (None, 2)], key=str)
    from pyspark.sql import functions as F

    mixed = docs.select("doc_id", "text", "lang").unionByName(extra.drop("level"))
    found = reading.reading_levels(mixed, labels)
    assert found.count() == mixed.filter(F.col("text").rlike(r"\p{L}")).count() and {r[0] for r in found.select("level").distinct().collect()} == {1, 2, 3}
    assert reading.reading_levels(docs.filter("false"), labels).count() == 0
    few = labels.withColumn("level", F.lit(None).cast("int"))
    assert reading.reading_levels(docs.limit(5), few).filter("level <> 2").count() == 0


@pytest.fixture(scope="module")
def many(spark):
    """4,600 short documents, 4,300 of them labelled, those of the greatest hashes as level 3 with words of their own."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    common = np.array("dog cat gate bench rule law court sum the of".split())
    late = {r[0] for r in spark.range(4300).orderBy(F.xxhash64("id").desc()).limit(290).collect()}
    level = [3 if k in late else 1 + k % 3 for k in range(4600)]
    texts = [". ".join(" ".join([*rng.choice(common, 3 + 2 * v), *(["estoppel"] if k in late or k >= 4500 else [])]) for _ in range(3)) + "." for k, v in enumerate(level)]
    docs = spark.createDataFrame([(k, t, ("en", "deu", "x")[k % 3]) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, v) for k, v in enumerate(level[:4300])] + [(0, 3), (0, 2)], "doc_id bigint, level int")
    return docs, labels, late


def test_every_label_is_learned_from(spark, many):
    docs, labels, late = many
    unlabelled = lambda found: {r["doc_id"]: (r["difficulty"], r["surprisal_gap"]) for r in found.filter("doc_id >= 4500").collect()}
    every = unlabelled(reading.reading_levels(docs, labels))
    fewer = unlabelled(reading.reading_levels(docs, labels.filter(~labels.doc_id.isin(list(late)))))
    assert len(every) == 100 and all(every[k] != fewer[k] for k in every)
    assert np.mean([every[k][1] for k in every]) > np.mean([fewer[k][1] for k in every]) + 0.05  # the word is known as demanding


@pytest.mark.parametrize("broadcast", [True, False])
def test_summed_by_spark_as_fitted_in_memory(spark, many, monkeypatch, request, broadcast):
    docs, labels, _ = many
    if not broadcast:
        monkeypatch.setattr(reading, "MAX_BROADCAST", 10)
        monkeypatch.setattr(reading, "BUCKET", 500)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    data = docs.join(reading.mean_levels(labels), "doc_id").select("doc_id", "text", "__level", reading.normal_language("lang"), "__fold").collect()
    ids, texts, y, langs, fold = zip(*data)
    assert len(ids) == 4300 and y[ids.index(0)] == 2 and np.ptp(np.bincount(fold, minlength=reading.FOLDS)) <= 9
    want = reading.Levels(ids, texts, y, [x or "" for x in langs], fold)
    packed, scales = reading.fit_levels(docs, reading.mean_levels(labels))
    got = reading.Levels.unpack(packed)
    assert (got.words, got.langs, got.layout) == (want.words, want.langs, want.layout)
    assert all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("keys", "pair_counts", "word_counts", "spoken"))
    assert got.word_counts.sum() == sum(len(want.layout.tokens(t)) for t in texts) and len(scales) == 2
    assert all(np.allclose(a.weights, b.weights) and np.allclose(a.center, b.center) for a, b in zip(scales, want.scales))
    found = {r["doc_id"]: r["difficulty"] for r in reading.reading_levels(docs, labels).collect()}
    assert len(found) == 4600
    assert np.allclose([found[k] for k in ids], want.difficulty(texts, ids)[:, 2])
    rest = docs.filter("doc_id >= 4300").collect()
    assert np.allclose([found[r["doc_id"]] for r in rest], want.difficulty([r["text"] for r in rest], [None] * len(rest))[:, 2])


def test_layout_from_counts_in_parts():
    rulings = [f"Court\n{head}\n" + "Hard words stand here in a long line of prose today.\n" * n + f"[1] The dog ran home at once.\n{end}: dismissed." for head, end, n in [("A", "X", 1), ("A", "X", 4), ("B", "Y", 2), ("A", "Y", 3)] * 30 + [("C", "Z", 9)] * 2]
    parts = [(*k, n) for some in (rulings[:50], rulings[50:]) for k, n in reading.Layout.found(some).items()]
    assert reading.Layout.made(parts) == reading.Layout.of(rulings) == reading.Layout(frozenset("ab"), frozenset("xy"), 4)


def test_equal_indexes_have_one_level():
    x, y = np.array([0.0, 0, 0, 1, 1]), np.array([1.0, 2, 3, 2, 3])
    for order in ([0, 1, 2, 3, 4], [2, 1, 0, 4, 3], [1, 4, 0, 2, 3]):
        at, value = reading.isotonic(x[order], y[order])
        assert np.allclose(np.interp([0, 1], at, value), [2, 2.5])
