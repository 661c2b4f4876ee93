import random

from tests.conftest import rows
from tidegrid.operators.packed import Segmenter, candidates, explode_positions, split_packed

KNOWN = ["QORVEX", "ZKOAT-A", "ZKOAT", "YTMKA"]
FIELDS = [
    ("QORVEX,ZKOAT.A;ytmka", ["QORVEX", "ZKOAT-A", "YTMKA"]),
    ("[QORVEX  'ZKOAT,A' “YTMKA”]", ["QORVEX", "ZKOAT-A", "YTMKA"]),
    ("QORVEX ZKOAT A | YTMKA", ["QORVEX", "ZKOAT-A", "YTMKA"]),  # the delimiter inside a known value is protected
    ("QORVEX ZKOAT B", ["QORVEX", "ZKOAT", "B"]),  # ZKOAT-B is not known
    ("QORVEX,,QORVEX, ,", ["QORVEX", "QORVEX"]),
    ('"QORVEX', ["QORVEX"]),  # a quote that never closes stands for nothing
    ("UNKNOWN-A\tOTHER", ["UNKNOWN-A", "OTHER"]),
    ("", []),
    (" \n[]", []),
    (None, None),
]


def test_segmenter():
    cut = Segmenter(KNOWN)
    for text, values in FIELDS:
        assert cut(text) == values


def test_long_field():
    names = [random.choice(KNOWN) for _ in range(20_000)]
    assert Segmenter(KNOWN)(",".join(names)) == names


def test_many_quotes_that_never_close():
    assert Segmenter(KNOWN)("“" * 300_000 + "QORVEX") == ["QORVEX"]


def test_broadcast_and_join_agree(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(FIELDS)], "id int, tickers string, values string")
    known = spark.createDataFrame([(k,) for k in KNOWN], "value string")
    small, large = (split_packed(df, "tickers", known, max_broadcast=m) for m in (1000, 1))
    assert [r["values"] for r in small.orderBy("id").collect()] == [v for _, v in FIELDS]
    assert rows(small.select("id", "values")) == rows(large.select("id", "values"))


def test_positions_and_empty(spark):
    df = spark.createDataFrame([(1, "A,,B,A")], "id int, tickers string")
    assert rows(explode_positions(split_packed(df, "tickers"), "values", value="v").select("id", "pos", "v")) == [(1, 1, "A"), (1, 2, "B"), (1, 3, "A")]
    assert split_packed(df.filter("false"), "tickers").count() == 0


def test_candidates():
    assert candidates("ZKOAT A,QX") == ["A", "A-QX", "QX", "ZKOAT", "ZKOAT-A"]
    assert candidates(None) == []


def test_broadcast_and_join_agree_on_values_of_three_parts(spark):
    fields = [("A,B,C;QX", ["A-B-C", "QX"]), ("A B C", ["A-B-C"]), ("A,B", ["A", "B"]), ("A;;B,C", ["A", "B", "C"]), ("D/E,F G", ["D-E-F-G"]), ("H,;I", ["H--I"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(fields)], "id int, tickers string")
    known = spark.createDataFrame([(k,) for k in ("A-B-C", "QX", "D-E-F-G", "H--I")], "value string")
    for most in (1000, 1):
        assert [r["values"] for r in split_packed(df, "tickers", known, max_broadcast=most).orderBy("id").collect()] == [v for _, v in fields]


def best_cover(text, known):
    """All covers of a field without quotes, tried one by one."""
    import itertools
    import re

    pieces = [(m.start(), m.end()) for m in re.finditer("[^,; |]+", text)]
    gaps = [text[z:a].strip(" ")[:1] or " " for (_, z), (a, _) in itertools.pairwise(pieces)]
    own = min(gaps, key=lambda g: (-gaps.count(g), g == " ", ",;|".find(g)), default=" ")
    canon = lambda a, z: text[a:z].upper().translate({ord(m): "-" for m in "./,; _"})
    best = None
    for cuts in itertools.product((False, True), repeat=max(0, len(pieces) - 1)):
        groups, now = [], [0]
        for k, cut in enumerate(cuts):
            if cut:
                groups.append(now)
                now = []
            now.append(k + 1)
        groups.append(now)
        values = [canon(pieces[g[0]][0], pieces[g[-1]][1]) for g in groups]
        if any(len(g) > 1 and v not in known for g, v in zip(groups, values)):
            continue
        chars = sum(sum(pieces[k][1] - pieces[k][0] for k in g) for g, v in zip(groups, values) if v in known)
        inside = sum(gaps[k] == own for g in groups for k in g[:-1])
        if best is None or (chars, -inside, -len(values)) > best[0]:
            best = ((chars, -inside, -len(values)), values)
    return best


def test_both_ways_give_the_best_of_all_covers(spark):
    rng = random.Random(7)
    texts, dictionaries = [], []
    for _ in range(60):
        known = {"-".join(rng.choice("ABC") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))} | {"A|B"}
        gap = rng.choice([",", ";", " ", ", ", "|"])
        text = "".join(rng.choice("abC") + (gap if rng.random() < 0.7 else rng.choice([" ", ",", ".", "; ", "|"])) for _ in range(rng.randint(1, 7))).rstrip(" ,;|.")
        texts.append(text)
        dictionaries.append(known)
    for text, known in zip(texts, dictionaries):
        score, _ = best_cover(text, known)
        got = Segmenter(known)(text)
        own = Segmenter({v for v in candidates(text, 9) if v in known})(text)  # what the way without a broadcast does with a field
        assert got == own, (text, known)
        assert len(got) == -score[2] and all(v in known for v in got if "-" in v and "." not in text), (text, known, got)
    union = set().union(*dictionaries)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tickers string")
    known = spark.createDataFrame([(k,) for k in union], "value string")
    small, large = (split_packed(df, "tickers", known, max_broadcast=m).orderBy("id").collect() for m in (1000, 1))
    assert [r["values"] for r in small] == [r["values"] for r in large]
    assert all(len(r["values"]) == -best_cover(r["tickers"], union)[0][2] for r in small)


def test_neighbours_are_not_swallowed():
    known = ["A", "B", "A-B"]
    assert Segmenter(known)("A,B,X") == ["A", "B", "X"]  # divided by the field's own mark
    assert Segmenter(known)("A B,X,Q") == ["A-B", "X", "Q"]
    assert Segmenter(["A", "A-B"])("A,B,X") == ["A-B", "X"]  # B alone is not known


def test_nul_and_odd_characters():
    assert Segmenter(KNOWN)("a\0b,'c\0d'") == ["A\0B", "C\0D"]
    assert Segmenter(["STRASSE-A"])("straße a,x") == ["STRASSE", "A", "X"]
