"""Reading level: surprisal under interpolated n-gram models, mapped monotonically to graded difficulty.

Word models with sentence ends, one of each level, are trained on labelled documents. Over the sentences of a document's own
reasoning they give distributions: of how much less surprising a sentence is to the models of the higher levels, and of how
much surprisal it carries under the words of all texts. Means and quartiles of the two make one index of difficulty;
isotonic regression of the labels on the index, as the models give it for texts that they didn't see, gives the level.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many labelled ids are broadcast to the documents; with more, Spark chooses the join. The rows are the same.
MAX_BROADCAST = 4_000_000
#: About so many labelled ids are numbered by one task.
BUCKET = 100_000
#: Weights of the word pair, the word and the uniform model.
MIX = (0.7, 0.25, 0.05)
FOLDS = 5
#: A language is graded on its own from so many labelled documents of each level on, else with all others.
FEWEST = 8
#: A line of so many words is prose; headings, parties and page lines are shorter.
PROSE = 8
#: A heading is learned if this share of the labelled rulings (and two of them) have it.
HEADING_SHARE = 0.02
QUARTERS = (0.25, 0.5, 0.75)

NUMBER = re.compile(r"^[ \t]*(?:\[\d+\]|\(\d+\)|\d+[.\t]|§ ?\d+|\d+ )[^\n]{12}", re.M)
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[.;]")
LETTER = re.compile(r"[^\W\d_]")
LABEL = re.compile(r"^[ \t]*([^\W\d_]+)[ \t]*:", re.M)
SIDE_LINE = re.compile(r"""^(?=[^\n]*[\d_])(?![^\n]*[.;:!?)\]”»“"'’][ \t]*$)(?:[^A-Za-zÀ-ɏ\n]*+[A-Za-zÀ-ɏ]++){0,%d}+[^A-Za-zÀ-ɏ\n]*+$""" % (PROSE - 1), re.M)
BROKEN = re.compile(r"-\n(?=[a-zß-ÿ])")
MOJIBAKE = re.compile("[Â-ô][\u0080-¿]+")
MARK = re.compile('[\n"“”„«»()\\[\\]]')
#: Closing marks of each opening one, and marks that may not come between.
PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "(": ")", "[": "]"}
BARRED = {"„": "„", "(": "(", "[": "["}
#: Characters that stand for others or for nothing: ligatures, soft hyphen, byte order mark, no-break space.
PLAIN = {"ﬁ": "fi", "ﬂ": "fl", "­": "", "﻿": "", " ": " ", "<br/>": "\n"}


def _decoded(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m[0]


def plain(text: str) -> str:
    """``text`` without residue of scanning and encoding; words broken at line ends are joined."""
    for sign, better in PLAIN.items():
        if sign in text:
            text = text.replace(sign, better)
    if "Ã" in text or "Â" in text:
        text = MOJIBAKE.sub(_decoded, text)
    return BROKEN.sub("", text) if "-\n" in text else text


def without_quotations(text: str) -> str:
    """``text`` with a blank for every quotation and bracketed reference within one line, of any length.

    One pass from the right tells for every mark where on its line each kind comes next, so that marks that never close cost
    no search of their own.
    """
    marks = list(MARK.finditer(text))
    if not marks:
        return text
    ends = [-1] * len(marks)
    coming: dict[str, int] = {}
    for k in range(len(marks) - 1, -1, -1):
        c = marks[k][0]
        if c == "\n":
            coming.clear()
            continue
        if c in PAIRS:
            end = min((coming[z] for z in PAIRS[c] if z in coming), default=-1)
            barred = coming.get(BARRED.get(c, ""), -1)
            if end >= 0 and not 0 <= barred < end:
                ends[k] = end
        coming[c] = k
    out, at, k = [], 0, 0
    while k < len(marks):
        if ends[k] >= 0:
            out.append(text[at : marks[k].start()])
            at, k = marks[ends[k]].end(), ends[k]
        k += 1
    return " ".join([*out, text[at:]])


def is_prose(line: str) -> bool:
    """Whether a line has at least ``PROSE`` words."""
    return len(line) >= 2 * PROSE and sum(1 for _ in WORD.finditer(line)) >= PROSE


@dataclass(frozen=True)
class Layout:
    """How the rulings of a corpus are set, as its labelled documents show it."""

    headings: frozenset[str] = frozenset()  #: short lines that stand over a headnote
    closings: frozenset[str] = frozenset()  #: words that open the order at the end of a ruling
    lines: int = 0  #: lines of prose of the longest usual headnote

    @staticmethod
    def of(texts: Sequence[str]) -> Layout:
        """Learned from rulings with numbered paragraphs: what comes before the first number is no reasoning, so a short line
        over prose there is a heading, and the last ``word:`` at the start of a line opens the order."""
        return Layout.made([(*k, n) for k, n in Layout.found(texts).items()])

    @staticmethod
    def found(texts: Iterable[str]) -> Counter[tuple[str, str, int]]:
        """How often each is in the texts: ("numbered", "", 0), ("over", heading, lines of prose below it), ("last", word, 0)."""
        out: Counter[tuple[str, str, int]] = Counter()
        for text in map(plain, texts):
            if not (number := NUMBER.search(text)):
                continue
            out["numbered", "", 0] += 1
            lines = [x.strip() for x in text[: number.start()].split("\n") if x.strip()]
            prose = [is_prose(x) for x in lines]
            for k in range(len(lines) - 1):
                if prose[k + 1] and not prose[k]:
                    out["over", lines[k].casefold(), sum(prose[k + 1 :])] += 1
                    break
            labels = LABEL.findall(text, number.end())
            if labels:
                out["last", labels[-1].casefold(), 0] += 1
        return out

    @staticmethod
    def enough(numbered: int) -> float:
        """How many rulings must have a heading or a word."""
        return max(2, HEADING_SHARE * numbered)

    @staticmethod
    def made(found: Iterable[tuple[str, str, int, int]]) -> Layout:
        """The layout of what ``found`` counts, summed up by its three keys; what is too seldom may be left out before."""
        found = list(found)
        total: Counter[tuple[str, str]] = Counter()
        for kind, word, _, n in found:
            total[kind, word] += n
        enough = Layout.enough(total["numbered", ""])
        named = {kind: frozenset(w for (k, w), n in total.items() if k == kind and n >= enough) for kind in ("over", "last")}
        usual = sorted((lines, n) for kind, word, lines, n in found if kind == "over" and word in named["over"])
        upto = np.cumsum([n for _, n in usual])
        at = np.searchsorted(upto, np.ceil(0.95 * (upto[-1] - 1)), side="right") if usual else 0
        return Layout(named["over"], named["last"], usual[at][0] if usual else 0)

    def reasoning(self, text: str) -> str:
        """The ruling's own reasoning: no headers, headnotes, page lines, order, quotations or bracketed references.

        Numbered paragraphs begin the reasoning. Without numbers it begins behind the headnote, which ends at the first
        blank line or else has the usual number of lines, and without a headnote at the first line of prose. Lines of
        fewer than 8 words with a number or a rule and no sentence end are page lines. A text in which nothing is left
        is returned as a whole, so that every text with letters has something to be judged by.
        """
        text = plain(text)
        number = NUMBER.search(text)
        end = len(text)
        for m in LABEL.finditer(text, number.end() if number else 0):
            if m[1].casefold() in self.closings:
                end = m.start()
        start = number.start() if number else self.first_line(text, end)
        own = without_quotations(SIDE_LINE.sub("", text[start:end]))
        return own if LETTER.search(own) else text

    def first_line(self, text: str, end: int) -> int:
        """Where the reasoning of a ruling without numbers begins."""
        at, prose, after, seen, blank = 0, -1, -1, False, False
        for line in text[:end].splitlines(keepends=True):
            bare = line.strip()
            if after >= 0:  # inside the headnote: lines of prose left
                if blank and bare or not after and bare:
                    return at
                seen, blank = seen or bool(bare), seen and not bare
                after -= is_prose(line) and after > 0
            elif bare.casefold() in self.headings:
                after = self.lines
            elif prose < 0 and is_prose(line):
                prose = at
            at += len(line)
        return 0 if after >= 0 else max(prose, 0)

    def tokens(self, text: str) -> list[str]:
        """Lower-case words and sentence ends of the reasoning."""
        return TOKEN.findall(self.reasoning(text).lower())


@dataclass
class Tables:
    """Interpolated models, one a level, over one sorted table of word pairs, so that one search serves all of them."""

    size: int
    keys: np.ndarray
    shares: np.ndarray
    own: np.ndarray
    general: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, pairs: np.ndarray, words: np.ndarray) -> Tables:
        """Models of the counts of each pair (first x size + second, sorted) and each word by level."""
        size = len(words)
        before = np.stack([np.bincount(keys // size, weights=pairs[:, j], minlength=size) for j in range(pairs.shape[1])], axis=1)
        shares = np.zeros((len(keys) + 1, pairs.shape[1]))
        shares[:-1] = MIX[0] * pairs / np.maximum(before[keys // size], 1)
        own = MIX[2] / size + MIX[1] * words / np.maximum(words.sum(axis=0), 1)
        every = words.sum(axis=1)
        general = (MIX[2] / size + MIX[1] * every / max(1, every.sum())) / (MIX[1] + MIX[2])
        return Tables(size, np.append(keys, np.int64(1) << 62), shares, own, -np.log(general))

    def surprisal(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Surprisal in nats of every word, given the word before, under each model."""
        asked = before * self.size + words
        at = np.searchsorted(self.keys, asked)
        return -np.log(self.own[words] + np.where((self.keys[at] == asked)[:, None], self.shares[at], 0.0))


def seen_in(coded: Iterable[Sequence[str]]) -> Counter[str]:
    """In how many texts each word is."""
    return Counter(w for words in coded for w in set(words))


def vocabulary(seen: Counter[str]) -> list[str]:
    """The words of more than one text."""
    return sorted(w for w, n in seen.items() if n > 1)


class Numbers(dict):
    """The number of each word, 0 for words that are not in it."""

    def __missing__(self, word: str) -> int:
        return 0


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def quartiles(values: np.ndarray, group: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Interpolated quartiles of the values of each group; ``group`` is sorted, ``lengths`` are above 0."""
    v = values[np.lexsort((values, group))]
    at = starts_of(lengths)[:, None] + (lengths[:, None] - 1) * np.array(QUARTERS)
    low = at.astype(np.int64)
    return v[low] + (v[np.minimum(low + 1, len(v) - 1)] - v[low]) * (at - low)


def weighted_quartiles(values: np.ndarray, weights: np.ndarray, group: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The least values of each group up to which its whole-numbered weights hold a quarter, a half and three quarters."""
    order = np.lexsort((values, group))
    upto = np.cumsum(weights[order])
    first = starts_of(lengths)
    before = upto[first] - weights[order][first]
    goal = before[:, None] + np.array(QUARTERS) * (upto[first + lengths - 1] - before)[:, None]
    return values[order][np.searchsorted(upto, goal)]


class Levels:
    """The fitted models and the monotone map, as counts of words and of pairs of words by fold and level.

    Counts are kept by fold of the labelled documents: such a document is always measured by models without its fold, when
    the map is fitted and when it is graded; all others by models of all folds.
    """

    def __init__(self, docs: Sequence[int], texts: Sequence[str], levels: Sequence[float], langs: Sequence[str], fold: Sequence[int] | None = None):
        """Fitted on texts at hand; ``fit_levels`` does the same on a table."""
        self.layout = Layout.of(texts)
        coded = [self.layout.tokens(t) for t in texts]
        fold = np.arange(len(coded)) % FOLDS if fold is None else np.array(fold, dtype=int)
        self.fold = {d: int(f) for d, f in zip(docs, fold)}
        self.words = vocabulary(seen_in(coded))
        self.langs = sorted({x for x in langs if x}) or [""]
        self.prepare()
        ids, y = [self.number(words) for words in coded], np.array(levels, dtype=float)
        self.fill(*self.counted(ids, fold, y, langs))
        x, tongue = self.measure_by_fold(ids, fold)
        self.scales = scales(tongue, x, y, len(self.langs))

    @staticmethod
    def unfilled(layout: Layout, words: list[str], langs: list[str]) -> Levels:
        """Without counts and scales."""
        out = Levels.__new__(Levels)
        out.layout, out.words, out.langs, out.fold = layout, words, langs, {}
        out.prepare()
        return out

    def counted(self, ids: Sequence[np.ndarray], fold: np.ndarray, y: np.ndarray, langs: Sequence[str]) -> tuple[np.ndarray, ...]:
        """Kind (0 pair, 1 word, 2 word by language), key, cell and number of what occurs in texts; kind, key and cell are
        distinct. The cell of the first two is fold x 3 + level - 1, of the third the language."""
        size = len(self.words) + 1
        cell = np.asarray(fold, dtype=np.int64) * 3 + np.clip((y + 0.5).astype(np.int64), 1, 3) - 1
        tongue = np.array([self.langs.index(x) if x in self.langs else -1 for x in langs], dtype=np.int64)
        length = np.array([len(i) for i in ids], dtype=np.int64)
        words = np.concatenate([np.zeros(0, dtype=np.int64), *ids])
        owner = np.repeat(np.arange(len(ids)), length)
        second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        spoken = tongue[owner] >= 0
        every = []
        for kind, key, of, cells in (
            (0, words[second - 1] * size + words[second], cell[owner[second]], 3 * FOLDS),
            (1, words, cell[owner], 3 * FOLDS),
            (2, words[spoken], tongue[owner[spoken]], len(self.langs)),
        ):
            codes, n = np.unique(key * cells + of, return_counts=True)
            every.append((np.full(len(codes), kind, dtype=np.int64), codes // cells, codes % cells, n.astype(np.int64)))
        return tuple(np.concatenate(part) for part in zip(*every))

    def fill(self, kind: np.ndarray, key: np.ndarray, cell: np.ndarray, n: np.ndarray) -> None:
        """Takes what ``counted`` gives, summed over all texts."""
        size = len(self.words) + 1
        pair, word, spoken = (np.flatnonzero(kind == k) for k in range(3))
        self.keys = np.unique(key[pair])
        self.pair_counts = np.zeros((len(self.keys), FOLDS, 3), dtype=np.int64)
        self.pair_counts[np.searchsorted(self.keys, key[pair]), cell[pair] // 3, cell[pair] % 3] = n[pair]
        self.word_counts = np.zeros((size, FOLDS, 3), dtype=np.int64)
        self.word_counts[key[word], cell[word] // 3, cell[word] % 3] = n[word]
        self.spoken = np.zeros((len(self.langs), size), dtype=np.int64)
        self.spoken[cell[spoken], key[spoken]] = n[spoken]
        self.prepare()

    def prepare(self) -> None:
        """What is derived from the counts."""
        self.vocab = Numbers({w: i + 1 for i, w in enumerate(self.words)})
        self.end = self.vocab.get(".", -1)
        self.tables: dict[int | None, Tables] = {}
        if hasattr(self, "spoken"):
            counts = self.spoken + 0.5
            self.affinity = np.log(counts / counts.sum(axis=1, keepdims=True)).T.copy()

    def pack(self) -> bytes:
        kept = {k: v for k, v in self.__dict__.items() if k not in ("vocab", "tables", "affinity")}
        return zlib.compress(pickle.dumps(kept | {"keys": np.diff(self.keys, prepend=0)}), 9)

    @staticmethod
    def unpack(packed: bytes) -> Levels:
        out = Levels.__new__(Levels)
        out.__dict__ |= pickle.loads(zlib.decompress(packed))
        out.keys = np.cumsum(out.keys)
        out.prepare()
        return out

    def models(self, without: int | None) -> Tables:
        """The models of all folds but one."""
        if without not in self.tables:
            count = lambda c: c.sum(axis=1) - (c[:, without] if without is not None else 0)
            self.tables[without] = Tables.of(self.keys, count(self.pair_counts), count(self.word_counts))
        return self.tables[without]

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocab.__getitem__, words), np.int64, len(words))

    def measure(self, texts: Sequence[np.ndarray], without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Measures of the distributions of surprisal over the sentences of each text, a row each, and the languages.

        Means per word of easy less ordinary and of ordinary less demanding surprisal and the logarithm of that of an
        average sentence; quartiles of easy less demanding surprisal per word over the words, sentence by sentence; logarithms of
        the quartiles of the surprisal of sentences of more than two words. Texts of fewer than two words have zeros.
        """
        out, tongue = np.zeros((len(texts), MEASURES)), np.zeros(len(texts), dtype=int)
        use = np.array([k for k, t in enumerate(texts) if len(t) > 1], dtype=int)
        if not len(use):
            return out, tongue
        models = self.models(without)
        ids = np.concatenate([texts[k] for k in use])
        size = np.array([len(texts[k]) for k in use])
        begin = starts_of(size)
        inner = np.ones(len(ids), dtype=bool)
        inner[begin] = False  # a text's first word follows none
        at = np.flatnonzero(inner)
        text = np.repeat(np.arange(len(use)), size - 1)
        by_word, general = models.surprisal(ids[at - 1], ids[at]), models.general[ids[at]]
        new = np.r_[True, ids[at[:-1]] == self.end]
        new[starts_of(size - 1)] = True
        starts = np.flatnonzero(new)
        length = np.diff(np.r_[starts, len(at)])
        by_sentence, carried, own = np.add.reduceat(by_word, starts, axis=0), np.add.reduceat(general, starts), text[starts]
        count = np.bincount(own, minlength=len(use))
        total = np.add.reduceat(by_word, starts_of(size - 1), axis=0) / (size - 1)[:, None]
        sentences = 1 + np.add.reduceat((ids == self.end).astype(np.int64), begin)
        some = np.bincount(own[length > 2], minlength=len(use)) > 0
        real = (length > 2) | ~some[own]
        out[use] = np.column_stack(
            [
                total[:, 0] - total[:, 1],
                total[:, 1] - total[:, 2],
                np.log(1e-9 + np.add.reduceat(general, starts_of(size - 1)) / sentences),
                weighted_quartiles((by_sentence[:, 0] - by_sentence[:, 2]) / length, length, own, count),
                np.log(1e-9 + quartiles(carried[real], own[real], np.bincount(own[real], minlength=len(use)))),
            ]
        )
        tongue[use] = np.add.reduceat(self.affinity[ids], begin, axis=0).argmax(axis=1)
        return out, tongue

    def measure_by_fold(self, ids: Sequence[np.ndarray], fold: Sequence[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """``measure``, of every text by the models without its fold."""
        x, tongue = np.zeros((len(ids), MEASURES)), np.zeros(len(ids), dtype=int)
        for f in set(fold):
            mine = np.array([k for k, g in enumerate(fold) if g == f], dtype=int)
            x[mine], tongue[mine] = self.measure([ids[k] for k in mine], f)
        return x, tongue

    def difficulty(self, texts: Sequence[str], docs: Sequence[int | None]) -> np.ndarray:
        """``grades`` of texts by the folds of the documents that the models were fitted on."""
        return self.grades(texts, [self.fold.get(d) for d in docs])

    def grades(self, texts: Sequence[str], fold: Sequence[int | None]) -> np.ndarray:
        """A row for each text: easy less demanding surprisal per word, surprisal of an average sentence, difficulty from 1 to 3."""
        x, tongue = self.measure_by_fold([self.number(self.layout.tokens(t)) for t in texts], fold)
        out = np.column_stack([x[:, 0] + x[:, 1], np.exp(x[:, 2]), np.zeros(len(texts))])
        for lang in np.unique(tongue):
            out[tongue == lang, 2] = self.scales[lang](x[tongue == lang])
        return out


#: Measures of a text: two means and quartiles of what the levels differ by, a mean and quartiles of what sentences carry.
MEASURES = 3 + 2 * len(QUARTERS)
#: Texts that are measured at once, and characters from which on no more are added.
TOGETHER, TOGETHER_CHARS = 256, 1 << 20


class Scale:
    """The monotone way from the measures of a text to its difficulty: one index by ordinal regression, isotonic regression on it."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.center = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.spread = x.std(axis=0) + 1e-9 if len(x) else np.ones(x.shape[1])
        z = (x - self.center) / self.spread
        self.weights = ordinal_weights(z, y)
        self.steps = isotonic(z @ self.weights, y)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp((x - self.center) / self.spread @ self.weights, *self.steps)


def scales(tongue: np.ndarray, x: np.ndarray, y: np.ndarray, langs: int) -> list[Scale]:
    """The scale of each language; languages differ in how long sentences are."""
    own = {g: Scale(x[tongue == g], y[tongue == g]) for g in range(langs) if enough_labels(y[tongue == g])}
    everything = Scale(x, y) if len(own) < langs else None
    return [own.get(g, everything) for g in range(langs)]


def enough_labels(y: np.ndarray) -> bool:
    return min(np.count_nonzero(np.rint(y) == v) for v in (1, 2, 3)) >= FEWEST


def ordinal_weights(z: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 1500) -> np.ndarray:
    """Weights, none below 0, of a proportional-odds model of the levels, by projected gradient steps."""
    w, cut = np.ones(z.shape[1]), np.array([-1.0, 1.0])
    if not len(z):
        return w
    above = np.stack([y > 1.5, y > 2.5], axis=1).astype(float)
    rate = 1.5 / z.shape[1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((z @ w)[:, None] - cut, -30, 30)))
        off = p - above
        w = np.maximum(w - rate * (z.T @ off.sum(axis=1) / len(z) + ridge * w), 0)
        cut = cut + rate * off.mean(axis=0)
    return w


def isotonic(index: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nondecreasing fit of y on the index by pooling adjacent violators: right ends of blocks and their values."""
    order = np.lexsort((-y, index))  # one value for equal indexes
    blocks: list[list[float]] = []  # sum, count, left end, right end
    for i in order:
        blocks.append([float(y[i]), 1.0, float(index[i]), float(index[i])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, r = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], r]
    if not blocks:
        return np.array([0.0]), np.array([2.0])
    at = np.array([e for b in blocks for e in (b[2], b[3])])
    return at, np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def normal_language(c: str):
    """en, de or fr of a language column that is written in several ways; else null."""
    x = F.lower(F.trim(F.col(f"`{c}`")))
    return F.when(x.isin("en", "eng"), "en").when(x.isin("de", "deu", "ger"), "de").when(x.isin("fr", "fra", "fre"), "fr")


MEASURED = "tongue int, y double, " + ", ".join(f"x{k} double" for k in range(MEASURES))


def together(rows: Iterable[tuple], text: int, most: int = TOGETHER, chars: int = TOGETHER_CHARS) -> Iterator[list[tuple]]:
    """Lists of rows, cut behind ``most`` rows or ``chars`` characters of their text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text])
        if len(held) >= most or size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def record(columns: Sequence, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


def mean_levels(labels: DataFrame) -> DataFrame:
    """doc_id, ``__level``, the mean over raters, and ``__fold`` of the labelled ids, to be joined with documents.

    Folds are dealt out in the order of the ids' hashes, within buckets of about ``BUCKET`` ids, so that they are of one size.
    """
    mean = labels.filter("doc_id is not null and level between 1 and 3").groupBy("doc_id").agg(F.avg("level").alias("__level"))
    count, mark = mean.count(), F.xxhash64("doc_id")
    dealt = Window.partitionBy(F.pmod(mark, F.lit(count // BUCKET + 1))).orderBy(mark, "doc_id")
    folded = mean.select("doc_id", "__level", ((F.row_number().over(dealt) - 1) % FOLDS).alias("__fold"))
    return F.broadcast(folded) if count <= MAX_BROADCAST else folded


def fit_levels(documents: DataFrame, mean: DataFrame) -> tuple[bytes, list[Scale]]:
    """The packed ``Levels`` of all labelled documents with letters and their scales, by counts that Spark sums up.

    Four passes over the labelled documents: the layout, the words of the reasoning, the pairs of words by fold and level, and
    the measures by models without the fold. Texts and their words stay on the executors' disks. The counts meet in one task
    that packs them, the measures in a task of each language that fits its scale; the driver gets the layout, the words of
    more than one text, the packed counts and the scales.
    """
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.DISK_ONLY))
        return kept[-1]

    try:
        labelled = keep(
            documents.select("doc_id", "text", normal_language("lang").alias("__lang"))
            .filter(F.col("text").rlike(r"\p{L}"))
            .join(mean, "doc_id")
            .select("__fold", "__level", F.coalesce("__lang", F.lit("")).alias("__lang"), "text")
        )
        layout = learned_layout(keep(layout_counts(labelled)))
        words = keep(labelled.mapInArrow(words_of(layout), "fold int, level double, lang string, words string"))
        seen = words.select("words").mapInArrow(seen_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        known = [r["word"] for r in seen.filter("n > 1").select("word").collect()]
        langs = sorted(r["lang"] for r in words.select("lang").distinct().collect() if r["lang"]) or [""]
        unfilled = documents.sparkSession.sparkContext.broadcast((layout, sorted(known), langs))
        counts = words.mapInArrow(count_words(unfilled), "kind bigint, key bigint, cell bigint, n bigint")
        summed = counts.groupBy("kind", "key", "cell").agg(F.sum("n").alias("n")).repartition(1)
        packed = summed.mapInArrow(pack_counts(unfilled), "model binary").collect()
        if not packed:
            nothing = Levels([], [], [], [])
            return nothing.pack(), nothing.scales
        model = bytes(packed[0]["model"])
        shared = documents.sparkSession.sparkContext.broadcast(model)
        measured = keep(words.mapInArrow(measure_words(shared), MEASURED))
        fitted = measured.repartition(len(langs), "tongue").mapInArrow(fit_scales(True), "tongue int, scale binary").collect()
        own = {r["tongue"]: pickle.loads(r["scale"]) for r in fitted}
        everything = None
        if len(own) < len(langs):
            everything = pickle.loads(measured.repartition(1).mapInArrow(fit_scales(False), "tongue int, scale binary").collect()[0]["scale"])
        return model, [own.get(g, everything) for g in range(len(langs))]
    finally:
        for df in kept:
            df.unpersist()


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def layout_counts(labelled: DataFrame) -> DataFrame:
    """``Layout.found`` of all texts: kind, word, ``total`` and the pairs (lines, n) it is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := Layout.found(t.as_py() for t in batch.column(0)):
                yield record([*zip(*((*k, n) for k, n in found.items()))], "kind word lines n")

    found = labelled.select("text").mapInArrow(run, "kind string, word string, lines bigint, n bigint")
    summed = found.groupBy("kind", "word", "lines").agg(F.sum("n").alias("n"))
    return summed.groupBy("kind", "word").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lines", "n")).alias("by_lines"))


def learned_layout(counts: DataFrame) -> Layout:
    numbered = counts.filter("kind = 'numbered'").first()
    enough = counts.filter(F.col("total") >= Layout.enough(numbered["total"] if numbered else 0)).collect()
    return Layout.made((r["kind"], r["word"], lines, n) for r in enough for lines, n in r["by_lines"])


def words_of(layout: Layout) -> Kernel:
    """fold, level, lang and the words of the reasoning with blanks between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in together(rows_of(batch), 3):
                fold, level, lang, text = zip(*rows)
                yield record([pa.array(fold, pa.int32()), level, lang, [" ".join(layout.tokens(t)) for t in text]], "fold level lang words")

    return run


def seen_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if seen := seen_in(words.as_py().split() for words in batch.column(0)):
            yield record([[*seen], [*seen.values()]], "word n")


def count_words(unfilled) -> Kernel:
    """``Levels.counted`` of many texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels.unfilled(*unfilled.value)
        for batch in batches:
            for rows in together(rows_of(batch), 3, len(batch), 16 * TOGETHER_CHARS):
                fold, level, lang, words = zip(*rows)
                yield record(levels.counted([levels.number(w.split()) for w in words], np.array(fold), np.array(level), lang), "kind key cell n")

    return run


def pack_counts(unfilled) -> Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if len(b)]
        if parts:
            levels = Levels.unfilled(*unfilled.value)
            levels.fill(*map(np.concatenate, zip(*parts)))
            yield record([[levels.pack()]], "model")

    return run


def measure_words(model) -> Kernel:
    """The language, the label and the measures of each labelled document by models without its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels.unpack(model.value)
        for batch in batches:
            for rows in together(rows_of(batch), 3):
                fold, y, _, words = zip(*rows)
                x, tongue = levels.measure_by_fold([levels.number(w.split()) for w in words], fold)
                yield pa.RecordBatch.from_arrays([pa.array(tongue.astype(np.int32)), pa.array(y), *map(pa.array, x.T)], ["tongue", "y", *(f"x{k}" for k in range(MEASURES))])

    return run


def fit_scales(by_language: bool) -> Kernel:
    """The scale of each language of a partition that has enough labels, or of all rows as language 0; in an order of their own,
    so that the sums don't depend on how rows arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([c.to_numpy() for c in b.columns]) for b in batches if len(b)]
        rows = np.concatenate([np.zeros((0, MEASURES + 2)), *parts])
        del parts
        rows = rows[np.lexsort(rows.T[1 if not by_language else 0 :][::-1])]
        for g in np.unique(rows[:, 0]) if by_language else [None]:
            mine = rows if g is None else rows[rows[:, 0] == g]
            if g is None or enough_labels(mine[:, 1]):
                yield record([pa.array([int(g or 0)], pa.int32()), [pickle.dumps(Scale(np.ascontiguousarray(mine[:, 2:]), mine[:, 1].copy()))]], "tongue scale")

    return run


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ``level`` 1 to 3, ``difficulty``, ``surprisal_gap`` and ``sentence_surprisal`` of every text with a letter.

    Null, empty and letterless texts give no rows. Whole texts are read, of labels all; a document is labelled if any rater gave it
    a level. Without any labels every text gets level 2.
    """
    mean = mean_levels(labels)
    shared = documents.sparkSession.sparkContext.broadcast(fit_levels(documents, mean))
    fitted: list[Levels] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not fitted:
            model, found = shared.value
            fitted.append(Levels.unpack(model))
            fitted[0].scales = found
        for batch in batches:
            doc, text, fold = batch.columns
            written = ((d, t, f) for d, t, f in zip(doc.to_pylist(), (x.as_py() for x in text), fold.to_pylist()) if t is not None and LETTER.search(t))
            for rows in together(written, 1):
                yield graded(rows, doc.type)

    def graded(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        docs, texts, fold = zip(*rows)
        out = fitted[0].grades(texts, fold)
        level = np.clip(np.floor(out[:, 2] + 0.5), 1, 3).astype(np.int32)
        columns = [pa.array(docs, kind), pa.array(level), pa.array(out[:, 2]), pa.array(out[:, 0]), pa.array(out[:, 1])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "level", "difficulty", "surprisal_gap", "sentence_surprisal"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    marked = documents.select("doc_id", "text").join(mean, "doc_id", "left").select("doc_id", "text", "__fold")
    return marked.mapInArrow(run, f"doc_id {kind}, level int, difficulty double, surprisal_gap double, sentence_surprisal double")
