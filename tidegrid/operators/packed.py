"""Several values packed into one field: dictionary-guided segmentation.

A multi-pattern automaton finds every known whole value in the field that has a delimiter inside, dynamic programming over
the stretches between delimiters picks the cover that explains the most characters by known values, and what stays
uncovered is cut at delimiters. A delimiter inside a known or a quoted value is thus part of that value.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.symbols import AROUND, MARKS, canonical_symbol, canonical_text

#: Characters between values, besides the quotes and brackets around them.
DELIMITERS = ",;|， \t\r\n []{}"
#: Opening and closing quotes.
QUOTES = {'"': '"', "'": "'", "“": "”"}
#: A dictionary of up to so many values goes to every executor; a larger one is joined instead.
MAX_BROADCAST_VALUES = 200_000
#: A value is known from so many rows on.
MIN_SUPPORT = 2
_SPLIT = "[^" + "".join(f"\\u{ord(c):04x}" for c in DELIMITERS + "\"'“”") + "]+"
_PIECE = "\"[^\"]*\"|'[^']*'|“[^”]*”|" + _SPLIT


class Segmenter:
    """Cuts fields into canonical values by a dictionary of canonical values.

    Of all covers of an unquoted stretch that is best which explains most characters by known values, delimiters not
    counted; of equals the one with fewest of the field's own delimiters inside its values, then the one of fewest values.
    So a known ``X-Y`` doesn't swallow the known neighbours X and Y where the field divides its values by that very mark.
    """

    def __init__(self, known: Iterable[str]):
        import ahocorasick

        self.known = frozenset(v for v in known if v)
        self.spread = ahocorasick.Automaton()  # the values that may have a delimiter inside; others are whole stretches anyway
        for value in self.known:
            if _MAY_SPREAD.search(value):
                self.spread.add_word(value, len(value))
        if len(self.spread):
            self.spread.make_automaton()

    def __call__(self, text: str | None) -> list[str] | None:
        """The values in order; null gives null, a field without values gives an empty list."""
        if text is None:
            return None
        spans = self.spread_spans(text) if len(self.spread) else []
        if not spans and text.count("“", text.rfind("”") + 1) < 50:  # nothing to choose: one pattern cuts all (more open quotes would make it slow)
            pieces = _PIECES.findall(text)
            return canonical_pieces([p if p[0] not in QUOTES else p[1:-1].strip(AROUND) for p in pieces] if _OPENING.search(text) else pieces)
        out: list[str] = []
        start = 0
        for a, z in quoted_spans(text):
            out += self.cover(text, start, a, spans)
            out.append(canonical_text(text[a + 1 : z - 1]))
            start = z
        return [v for v in [*out, *self.cover(text, start, len(text), spans)] if v]

    def spread_spans(self, text: str) -> list[tuple[int, int]]:
        """Where known values with a delimiter inside lie between delimiters: their first characters and their ends."""
        found = []
        for last, size in self.spread.iter(canonical_inner(text)):
            a, z = last + 1 - size, last + 1
            if (a == 0 or text[a - 1] in _BREAK) and (z == len(text) or text[z] in _BREAK) and text[a] not in _BREAK and text[last] not in _BREAK and _BREAKS.search(text, a, z):
                found.append((a, z))
        return found

    def cover(self, text: str, start: int, end: int, spans: Sequence[tuple[int, int]]) -> list[str]:
        """The best cover of the unquoted stretch from ``start`` to ``end``."""
        inside = [(a, z) for a, z in spans if start <= a and z <= end]
        if not inside:
            return canonical_pieces(_STRETCH.findall(text, start, end))
        own = own_delimiter(text)
        pieces = [m.span() for m in _STRETCH.finditer(text, start, end)]
        values = canonical_pieces([text[a:z] for a, z in pieces])
        first, last = {a: i for i, (a, _) in enumerate(pieces)}, {z: i for i, (_, z) in enumerate(pieces)}
        joined: dict[int, list[int]] = {}
        for a, z in inside:
            joined.setdefault(last[z], []).append(first[a])
        size = list(accumulate((z - a for a, z in pieces), initial=0))
        marks = list(accumulate((gap_mark(text[z:a]) == own for (_, z), (a, _) in zip(pieces, pieces[1:])), initial=0))
        # best[j]: (characters of known values, own delimiters inside values negated, values negated) of the first j pieces
        best, back = [(0, 0, 0)], [0]
        for j, (a, z) in enumerate(pieces):
            c, d, n = best[j]
            top, came = (c + (z - a) * (values[j] in self.known), d, n - 1), j
            for i in joined.get(j, ()):
                c, d, n = best[i]
                if (mine := (c + size[j + 1] - size[i], d - (marks[j] - marks[i]), n - 1)) > top:
                    top, came = mine, i
            best.append(top)
            back.append(came)
        out, j = [], len(pieces)
        while j:
            i = back[j]
            out.append(values[i] if i == j - 1 else canonical_inner(text[pieces[i][0] : pieces[j - 1][1]]))
            j = i
        return out[::-1]


def quoted_spans(text: str) -> Iterator[tuple[int, int]]:
    """Quoted values with their quotes, from left to right. A quote opens at the start or behind a delimiter or quote; one that never closes stands for nothing."""
    at, never = 0, set()  # closing quotes that don't come any more, so that each is sought once in vain
    while m := _OPENING.search(text, at):
        at = m.start()
        close = QUOTES[text[at]]
        end = text.find(close, at + 1) if close not in never and (at == 0 or text[at - 1] in _BREAK) else -1
        if end >= 0:
            yield at, end + 1
            at = end + 1
        else:
            if at == 0 or text[at - 1] in _BREAK:
                never.add(close)
            at += 1


def gap_mark(gap: str) -> str:
    """The mark that a run of delimiters divides by: its first one that is no blank, bracket or quote, else a blank."""
    m = _MARK.search(gap)
    return m[0] if m else " "


def own_delimiter(text: str) -> str:
    """The mark by which a field mostly divides its values; of equals the first in ``DELIMITERS``, blanks last."""
    marks = Counter(map(gap_mark, _BREAKS.findall(text.strip(_EDGE))))
    return min(marks, key=lambda m: (-marks[m], m == " ", DELIMITERS.find(m)), default=" ")


def canonical_pieces(pieces: list[str]) -> list[str]:
    """The canonical forms of values without blanks, quotes or brackets around them, empty ones left out, all at once."""
    whole = "\0".join(pieces)
    if whole.count("\0") != len(pieces) - 1:
        return [v for v in map(canonical_text, pieces) if v]
    return [v for v in dashed(whole.upper()).split("\0") if v]


def dashed(text: str) -> str:
    """``text`` with every mark written ``-``."""
    for mark in MARKS:
        text = text.replace(mark, "-")
    return text


def canonical_inner(part: str) -> str:
    """Upper case with every mark written ``-``, character by character, so that positions stay."""
    up = part.upper()
    return dashed(up if len(up) == len(part) else "".join(c.upper() if len(c.upper()) == 1 else c for c in part))


_BREAK = frozenset([*DELIMITERS, *QUOTES, *QUOTES.values()])
_EDGE = "".join(sorted(_BREAK))
_BREAKS = re.compile(f"[{re.escape(_EDGE)}]+")
_STRETCH = re.compile(f"[^{re.escape(_EDGE)}]+")
_OPENING = re.compile(f"[{re.escape(''.join(QUOTES))}]")
_PIECES = re.compile("|".join(f"(?<![^{re.escape(_EDGE)}]){a}[^{z}]*{z}" for a, z in QUOTES.items()) + "|" + _STRETCH.pattern)
_MARK = re.compile("[,;|，]")
_MAY_SPREAD = re.compile(f"[-{re.escape(_EDGE)}]")


def value_dictionary(df: DataFrame, column: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Canonical values that stand quoted or between delimiters in at least ``min_support`` rows: one column ``value``."""
    piece = F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(_PIECE), F.lit(0))))
    return (
        df.select(piece.alias("piece"))
        .groupBy(canonical_symbol("piece").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("value").isNotNull() & (F.col("n") >= min_support))
        .select("value")
    )


def split_packed(df: DataFrame, column: str, dictionary: DataFrame | None = None, into: str = "values", max_broadcast: int = MAX_BROADCAST_VALUES) -> DataFrame:
    """``df`` with ``into``, the array of the canonical values packed in ``column``, in order and with repeats.

    Null gives null; a field of nothing but delimiters gives an empty array; very long fields cost time in proportion to
    their length. An existing column named ``into`` is replaced. ``dictionary`` (column ``value``) defaults to the values
    that ``column`` itself shows in several rows. It is broadcast only after its size was counted; a larger one is joined
    to the candidates of each field, which needs no bound.
    """
    dictionary = value_dictionary(df, column) if dictionary is None else dictionary
    known = [r[0] for r in dictionary.limit(max_broadcast + 1).collect()]
    if len(known) <= max_broadcast:
        shared = df.sparkSession.sparkContext.broadcast(known)
        cache: dict[str, Segmenter] = {}

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def cut(texts: pd.Series) -> pd.Series:
            seg = cache.get("s") or cache.setdefault("s", Segmenter(shared.value))
            return texts.map(seg, na_action="ignore").astype(object).where(texts.notna(), None)

        return df.withColumn(into, cut.asNondeterministic()(F.col(column)))  # said so that filters on the result don't cut every field twice
    return _split_joined(df, column, dictionary, into)


def candidates(text: str | None, most: int = 2) -> list[str]:
    """Canonical forms of every run of up to ``most`` neighbouring stretches with what stands between them."""
    if not text:
        return []
    inner = canonical_inner(text)
    spans = [m.span() for m in _STRETCH.finditer(text)]
    runs = {inner[a:z] for i, (a, _) in enumerate(spans) for _, z in spans[i : i + most]}
    return sorted(runs.union(canonical_pieces([text[a:z] for a, z in spans])))


def _split_joined(df: DataFrame, column: str, dictionary: DataFrame, into: str) -> DataFrame:
    """The way without a broadcast: candidates of each distinct field are joined to the dictionary.

    A known value may be cut at any of its marks, so runs of as many stretches are offered as any of them can have. Each
    field is then cut by those known values that occur in it, which gives what the whole dictionary would.
    """
    parts = F.length("value") - F.length(F.translate("value", "-" + _EDGE, "")) + 1
    most = dictionary.agg(F.max(parts)).first()[0] or 1

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def offer(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: candidates(t, most))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([Segmenter([] if k is None else list(k))(t) for t, k in zip(texts, known)], dtype=object)

    text = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("__text")).distinct()
    found = (
        text.select("__text", F.explode(offer("__text")).alias("value"))
        .join(dictionary.select("value").distinct(), "value", "left_semi")
        .groupBy("__text")
        .agg(F.collect_set("value").alias("__known"))
    )
    cuts = text.join(found, "__text", "left").select("__text", cut.asNondeterministic()("__text", "__known").alias("__values"))
    return df.drop(into).join(cuts, F.col(column) == F.col("__text"), "left").withColumnRenamed("__values", into).drop("__text")


def explode_positions(df: DataFrame, array: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value of ``array`` with its position from 1; rows with null or empty arrays give none."""
    keep: list[Column] = [F.col(f"`{c}`") for c in df.columns if c not in (array, pos, value)]
    return df.select(*keep, F.posexplode(array).alias("__p", value)).withColumn(pos, F.col("__p") + 1).drop("__p")
