"""Implausible readings per source: spikes, stuck stretches and physically impossible values.

Each series' log moves get a robust first-order autoregression. Its residuals are tested in rounds: at every reading the size
of an additive outlier and that of a level shift are estimated from the residuals that either would leave, the likelier of
the two is taken out of the series where it is beyond what residuals of the series reach by chance, and the autoregression is
fitted anew to what is left. Outliers, and shifts that are undone soon, are spikes; lasting shifts are none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .rolling import last_daily


@dataclass(frozen=True)
class Limits:
    """Parameters of the tests; scales are those of the series itself."""

    chance: float = 1e-3  #: expected number of natural residuals (and of natural still stretches) beyond the limit in the whole series
    least: float = 6.0  #: a limit is never below so many usual moves
    back: float = 0.5  #: a spell is undone if what is left of it is at most this share of its least distance
    longest: int = 10  #: most readings of a spell that is undone; a longer one is a change of level
    edge: float = 1.6  #: log move that makes an outlier of the first or last readings, which nothing can undo (five-fold: splits are less)
    still: float = 0.008  #: usual moves up to which a reading has not moved; ordinary moves are so small once in 150
    fewest: int = 8  #: readings that a series needs to be judged by its own behaviour
    shortest: int = 5  #: moves of the shortest stuck stretch
    rounds: int = 30  #: most rounds of tests and fits; they end when nothing is found


def starts_of(sid: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]]) if len(sid) else np.zeros(0, dtype=np.int64)


def group_quantiles(values: np.ndarray, sid: np.ndarray, n: int, shares: Sequence[float] = (0.5,)) -> np.ndarray:
    """Quantiles of each group 0..n-1 (a row for each share), NaN for groups without values; ``sid`` is sorted."""
    out = np.full((len(shares), n), np.nan)
    if len(values):
        order = np.lexsort((values, sid))
        v, first = values[order], starts_of(sid)
        count = np.diff(np.r_[first, len(v)])
        for k, share in enumerate(shares):
            at = share * (count - 1)
            low = at.astype(np.int64)
            a, z = v[first + low], v[first + np.minimum(low + 1, count - 1)]
            out[k, sid[first]] = a + (z - a) * (at - low)
    return out


@dataclass
class Fit:
    """A robust autoregression of each series' moves: coefficient, scale of the residuals, and the limit that they don't reach by chance."""

    phi: np.ndarray
    scale: np.ndarray
    limit: np.ndarray


def residuals(x: np.ndarray, sid: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """What the autoregression of the moves leaves of each; a series' first reading has none, its second one is a move on its own."""
    inside = np.r_[False, sid[1:] == sid[:-1]]
    r = np.where(inside, np.diff(x, prepend=x[:1]), 0.0)
    return r - phi[sid] * np.r_[0.0, r[:-1]] * inside


def fit_moves(x: np.ndarray, sid: np.ndarray, n: int, lim: Limits, rounds: int = 2) -> Fit:
    """Huber-weighted fits of r[t] = phi r[t-1] + e[t]; moves of 0 set no scale.

    The limit continues the tail of |e| from its median and its 90 % quantile, which a tenth of outliers can't spoil, as an
    exponential one to the point that ``chance`` readings of the series are expected to pass.
    """
    inside = np.r_[False, sid[1:] == sid[:-1]]
    r = np.where(inside, np.diff(x, prepend=x[:1]), 0.0)
    moved = inside & (np.abs(r) > 1e-9)
    middle, tail = group_quantiles(np.abs(r[moved]), sid[moved], n, (0.5, 0.9))
    phi = np.zeros(n)
    pair = np.flatnonzero(inside & np.r_[False, inside[:-1]])
    now, before, g = r[pair], r[pair - 1], sid[pair]
    for _ in range(rounds):
        scale = 1.4826 * middle
        e = now - phi[g] * before
        with np.errstate(invalid="ignore", divide="ignore"):
            w = np.minimum(1, 1.5 * scale[g] / np.abs(e)) * np.minimum(1, 3 * scale[g] / np.abs(before))
        w = np.where(np.isfinite(w), w, 0)
        den = np.bincount(g, w * before * before, n)
        phi = np.clip(np.bincount(g, w * now * before, n) / np.where(den > 0, den, 1), -0.9, 0.9)
        e = np.abs(now - phi[g] * before)
        use = (e > 1e-9) & (np.abs(now) > 1e-9)
        fresh = group_quantiles(e[use], g[use], n, (0.5, 0.9))
        middle, tail = np.where(np.isfinite(fresh), fresh, [middle, tail])
    count = np.bincount(sid, minlength=n)
    limit = middle + (tail - middle) / np.log(5) * np.log(np.maximum(0.5 * count / lim.chance, 1))
    return Fit(phi, 1.4826 * middle, np.maximum(limit, lim.least * 1.4826 * middle))


def interventions(x: np.ndarray, sid: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(readings, sizes, whether of an additive outlier) of what the residuals show beyond the limits, each the strongest within two readings.

    An outlier of size w leaves residuals w (1, -(1 + phi), phi), a level shift w (1, -phi); sizes are least-squares
    estimates, and the one that explains more of the residuals is taken.
    """
    n = len(x)
    e, phi, bound = residuals(x, sid, fit.phi), fit.phi[sid], fit.limit[sid]
    some = np.abs(e) > bound / 2
    near = np.flatnonzero(some | np.r_[some[1:], False] | np.r_[some[2:], False, False])  # else no estimate can pass the limit
    ok = lambda k: np.where(near + k < n, sid[np.minimum(near + k, n - 1)] == sid[near], False)
    begin = near > 0
    begin[begin] = sid[near[begin]] == sid[near[begin] - 1]
    e0 = e[near]
    e1, e2 = (np.where(ok(k), e[np.minimum(near + k, n - 1)], 0.0) for k in (1, 2))
    f = phi[near]
    own, after = 1 + (1 + f) ** 2 * ok(1) + f * f * ok(2), 1 + f * f * ok(1)
    outlier, shift = (e0 - (1 + f) * e1 + f * e2) / own, (e0 - f * e1) / after
    a, z = np.abs(outlier) * np.sqrt(own), np.abs(shift) * np.sqrt(after)
    strength = np.where(begin & (np.maximum(a, z) > bound[near]), np.maximum(a, z), 0.0)
    full = np.zeros(n + 4)
    full[near + 2] = strength
    best = strength > 0
    for k in (1, 2):
        best &= (strength > full[near + 2 - k]) | (sid[near] != sid[np.maximum(near - k, 0)])
        best &= (strength >= full[near + 2 + k]) | ~ok(k)
    lone = ok(1) & (a >= z)
    return near[best], np.where(lone, outlier, shift)[best], lone[best]


def spikes(x: np.ndarray, sid: np.ndarray, size: np.ndarray, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(score of each log reading, 0 for none, in usual moves; scale of the usual moves of each series)."""
    n, groups = len(x), len(size)
    y = x.copy()
    fit = Fit(np.zeros(groups), np.full(groups, np.nan), np.full(groups, np.inf))
    active = size >= lim.fewest
    for _ in range(lim.rounds):
        rows = np.flatnonzero(active[sid])
        if not len(rows):
            break
        number = np.cumsum(active) - 1
        g = number[sid[rows]]
        now = fit_moves(y[rows], g, int(active.sum()), lim)
        for name in ("phi", "scale", "limit"):
            getattr(fit, name)[active] = getattr(now, name)
        now.limit = np.where(np.isfinite(now.limit), now.limit, np.inf)
        at, w, lone = interventions(y[rows], g, now)
        if not len(at):
            break
        off = np.zeros(len(rows))
        first = starts_of(g)
        np.add.at(off, at[~lone], w[~lone])
        off = np.cumsum(off)
        off -= np.r_[0.0, off][first][g] if len(first) else 0  # shifts end with their series
        off[at[lone]] += w[lone]
        y[rows] -= off
        active = np.bincount(sid[rows[at]], minlength=groups) > 0
    return spells(x, x - y, sid, size, fit, lim), fit.scale


def spells(x: np.ndarray, off: np.ndarray, sid: np.ndarray, size: np.ndarray, fit: Fit, lim: Limits) -> np.ndarray:
    """Scores of the readings in spells: stretches off the level around them, as the interventions ``off`` have it, that are undone soon."""
    n = len(x)
    score = np.zeros(n)
    bound, scale = fit.limit[sid] if n else x, fit.scale[sid] if n else x
    inside = np.r_[False, sid[1:] == sid[:-1]] if n else np.zeros(0, dtype=bool)
    change = np.flatnonzero(inside & (np.abs(np.diff(off, prepend=off[:1])) > 1e-12))
    first = starts_of(sid)
    ends = np.append(first[1:], n)
    until = -1
    for t in change.tolist():  # few: where outliers and shifts begin and end
        if t <= until:
            continue
        start, end = int(first[sid[t]]), int(ends[sid[t]])
        base, least = off[t - 1], np.inf
        for m in range(1, min(lim.longest, end - 1 - t) + 1):
            least = min(least, abs(off[t + m - 1] - base))
            if least < bound[t]:
                break
            if abs(off[t + m] - base) <= lim.back * least:
                score[t : t + m] = np.abs(off[t : t + m] - base) / scale[t]
                until = t + m
                break
        else:
            # nothing undoes a move near an end: only one far beyond any change of level is an outlier there
            move = abs(x[t] - x[t - 1])
            if move > max(lim.edge, 2.5 * bound[t]):
                if t - start <= lim.longest and (t - start) * 3 < size[sid[t]]:
                    score[start:t] = move / scale[t]
                elif end - t <= lim.longest and (end - t) * 3 < size[sid[t]]:
                    score[t:end] = move / scale[t]
                    until = end
    return score


def stuck(x: np.ndarray, sid: np.ndarray, scale: np.ndarray, size: np.ndarray, lim: Limits) -> np.ndarray:
    """Length of the stuck stretch that each reading continues, 0 for none.

    How often the series' natural stretches begin tells how likely a reading repeats the one before; a stretch is stuck
    if so long a one is not expected in a series of this length.
    """
    n = len(x)
    out = np.zeros(n)
    if not n:
        return out
    inside = np.r_[False, sid[1:] == sid[:-1]]
    tolerance = np.where(np.isfinite(scale[sid]), lim.still * scale[sid], 0.0) + 1e-12
    still = inside & (np.abs(np.diff(x, prepend=x[:1])) <= tolerance)
    begin = np.flatnonzero(still & ~np.r_[False, still[:-1]])
    end = np.flatnonzero(still & ~np.r_[still[1:], False]) + 1
    groups = len(size)
    runs, moves = np.bincount(sid[begin], minlength=groups), np.bincount(sid[inside & ~still], minlength=groups)
    q = np.clip((runs + 0.5) / (moves + 1), 1e-4, 0.95)
    longest = np.maximum(np.ceil(np.log(lim.chance / np.maximum(size, 1)) / np.log(q)), lim.shortest)
    for a, z in zip(begin, end):
        if z - a >= lim.shortest and z - a >= longest[sid[a]] and size[sid[a]] >= lim.fewest:
            out[a:z] = z - a
    return out


def judge(sid: np.ndarray, p: np.ndarray, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(reason, score) of each reading of the series ``sid`` (sorted, 0..), in order of time: 0 none, 1 limit, 2 spike, 3 stuck."""
    with np.errstate(invalid="ignore"):
        valid = np.isfinite(p) & (p > 0)
    reason, score = np.where(valid, 0, 1).astype(np.int8), np.zeros(len(p))
    at = np.flatnonzero(valid)
    groups = int(sid[-1]) + 1 if len(sid) else 0
    g, x = sid[at], np.log(p[at])
    size = np.bincount(g, minlength=groups)
    far, scale = spikes(x, g, size, lim)
    calm = np.flatnonzero(far == 0)
    still = stuck(x[calm], g[calm], scale, size, lim)
    reason[at[far > 0]], score[at[far > 0]] = 2, far[far > 0]
    hit = calm[still > 0]
    reason[at[hit]], score[at[hit]] = 3, still[still > 0]
    return reason, score


REASONS = ("", "limit", "spike", "stuck")
#: Readings that are judged at once; only whole series are, so a batch may be longer by one series.
BATCH = 150_000


def flag_series(daily: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """The implausible readings of ``daily`` (basket, symbol, date, p): these columns, ``reason`` and ``score``.

    ``daily`` has one reading per (basket, symbol, date), spread by (basket, symbol); null readings are none.
    ``reason``: ``limit`` (not finite or not above 0), ``spike`` (score: distance in usual moves), ``stuck`` (each reading
    after the first of the stretch; score: its moves). Series of fewer than 8 readings are held to the limits only; a
    series that never moves is not stuck, as that is its usual behaviour. Series are judged in whole, many at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                whole = pa.Table.from_batches(held).combine_chunks()
                sid, _ = series_numbers(whole)
                cut = int(np.searchsorted(sid, sid[-1])) if len(sid) else 0
                if cut:
                    yield from flagged(whole.slice(0, cut), sid[:cut])
                rest = whole.slice(cut)
                held, rows = rest.to_batches(), rest.num_rows
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from flagged(whole, series_numbers(whole)[0])

    def flagged(whole: pa.Table, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
        reason, score = judge(sid, whole.column("p").to_numpy(), lim)
        hit = np.flatnonzero(reason)
        out = whole.take(pa.array(hit)).append_column("reason", pa.array([REASONS[k] for k in reason[hit]], pa.string())).append_column("score", pa.array(score[hit]))
        yield from out.combine_chunks().to_batches()

    rows = daily.filter("p is not null").select("basket", "symbol", "date", "p").sortWithinPartitions("basket", "symbol", "date")
    return rows.mapInArrow(run, "basket string, symbol string, date date, p double, reason string, score double")


def series_numbers(whole: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's (basket, symbol), counting up from 0 as they come, and where each begins."""
    new = np.zeros(whole.num_rows, dtype=bool)
    new[:1] = True
    for name in ("basket", "symbol"):
        column = whole.column(name)
        if whole.num_rows:
            codes = pc.dictionary_encode(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)).indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def implausible_prices(prices: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """``flag_series`` of the last received price of each (basket, canonical symbol, date)."""
    return flag_series(last_daily(prices), lim)
