"""Return panels of many members: densifying, complete windows, coverage, and rolling matrices handed to NumPy kernels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.timeline import Series, log_return
from ..session import spread
from .calendars import sessions

#: A task turns at least so many sessions into windows, and so many times the window; it reads window - 1 sessions more, a quarter of its own.
CHUNK, CHUNK_WINDOWS = 20, 4


def chunk_of(k: int) -> int:
    """Sessions of a chunk for windows of k rows."""
    return max(CHUNK, CHUNK_WINDOWS * k)


def dense_panel(prices: DataFrame, entity: Sequence[str], member: str, price: str, date: str = "date", dates: bool = True) -> DataFrame:
    """Every member on every session of its entity from its first price on, missing prices null: entity, member, session, date, price.

    Sessions are the entity's distinct dates. Each price row is spread over the sessions up to the member's next one, by
    session numbers, so no cross join is made; after its last price a member has no rows. Without ``dates`` the rows between
    prices have no date, which saves a join of the whole panel with the calendar and the exchange behind it; the windows over it
    go by session.
    """
    calendar = sessions(prices, entity, date)
    at = prices.select(*entity, member, date, price).join(calendar, [*entity, date])
    s = Series([*entity, member], "session")
    gap = F.coalesce(F.lead("session").over(s.window()) - F.col("session"), F.lit(1))
    rows = at.withColumn("__gap", gap).withColumn("__k", F.explode(F.sequence(F.lit(0).cast(at.schema["session"].dataType), F.col("__gap") - 1)))
    own = lambda c: F.when(F.col("__k") == 0, F.col(c)).alias(c)
    rows = rows.select(*entity, member, (F.col("session") + F.col("__k")).alias("session"), own(date), own(price))
    return rows.drop(date).join(calendar, [*entity, "session"]) if dates else rows


def returns(dense: DataFrame, entity: Sequence[str], member: str, price: str) -> DataFrame:
    """``dense`` with ``r``, the log return; a missing price breaks both returns beside it."""
    return dense.withColumn("r", log_return(Series([*entity, member], "session"), price))


def complete_windows(panel: DataFrame, entity: Sequence[str], member: str, value: str = "r", k: int = 60, still: float = kernels.STILL) -> DataFrame:
    """``panel`` with ``complete``: the last k values are all there and not constant."""
    frame = Series([*entity, member], "session").trailing(k)
    whole = F.count(value).over(frame) == k
    return panel.withColumn("complete", whole & F.coalesce(F.stddev_pop(value).over(frame) > still, F.lit(False)))


def coverage(marked: DataFrame, entity: Sequence[str], member: str, price: str, by: str) -> DataFrame:
    """Coverage of a panel with ``complete`` by ``session`` or by member (``by`` = 'member')."""
    if by == "session":
        return marked.groupBy(*entity, "session").agg(F.count(F.lit(1)).alias("expected"), F.count(price).alias("priced"), F.count_if("complete").alias("eligible"), F.count_if(~F.col("complete")).alias("excluded"))
    out = marked.groupBy(*entity, member).agg(
        F.count(F.lit(1)).alias("sessions"), F.count(price).alias("valid_prices"), F.count_if("complete").alias("eligible_sessions"),
        F.min(F.when(F.col(price).isNotNull(), F.col("date"))).alias("first_valid"), F.max(F.when(F.col(price).isNotNull(), F.col("date"))).alias("last_valid"),
    )
    return out.withColumn("status", F.when(F.col("eligible_sessions") > 0, "used").when(F.col("valid_prices") == 0, "no valid prices").otherwise("no complete window"))


def with_members(panel: DataFrame, spans: DataFrame, entity: Sequence[str], member: str) -> DataFrame:
    """``panel`` with ``member_now``, whether the session lies in a span of the row's member; no row is dropped, as windows reach back before the joining.

    A member's spans (``first``, ``last``) come as one array, so the join keeps to the exchange that the returns need.
    """
    own = spans.groupBy(*entity, member).agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    inside = F.exists("__spans", lambda x: F.col("session").between(x["first"], x["last"]))
    return panel.join(own, [*entity, member], "left").withColumn("member_now", F.coalesce(inside, F.lit(False))).drop("__spans")


#: Why a member has no part in a session's window.
UNRESOLVED, INCOMPLETE = "unresolved price symbol", "incomplete 60-session returns or constant"


def member_status(members: DataFrame, listed: DataFrame, marked: DataFrame, entity: Sequence[str], member: str) -> DataFrame:
    """``members`` with ``reason``, null for the eligible: ``listed`` has the members with price rows, ``marked`` is a panel with ``complete``."""
    complete = marked.filter("complete").select(*entity, member, "session", F.lit(True).alias("__ok"))
    x = members.join(listed.select(*entity, member, F.lit(True).alias("__listed")), [*entity, member], "left").join(complete, [*entity, member, "session"], "left")
    return x.withColumn("reason", F.when(F.col("__listed").isNull(), UNRESOLVED).when(F.col("__ok").isNull(), INCOMPLETE)).drop("__listed", "__ok")


def member_coverage(calendar: DataFrame, status: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Expected, mapped, eligible, missing and excluded members of every session of ``calendar``, 0 where none was known."""
    missing, excluded = F.count_if(F.col("reason") == UNRESOLVED), F.count_if(F.col("reason") == INCOMPLETE)
    n = status.groupBy(*entity, "session").agg(F.count(F.lit(1)).alias("expected_members"), (F.count(F.lit(1)) - missing).alias("mapped"), F.count_if(F.col("reason").isNull()).alias("eligible"), missing.alias("missing_symbols"), excluded.alias("excluded_incomplete_or_constant"))
    return calendar.join(n, [*entity, "session"], "left").fillna(0, ["expected_members", "mapped", "eligible", "missing_symbols", "excluded_incomplete_or_constant"])


def member_sessions(members: DataFrame, marked: DataFrame, entity: Sequence[str], member: str, price: str) -> DataFrame:
    """``members`` (entity, member, session, date) with ``priced`` and ``eligible``, whether the panel has a price and a complete window there."""
    state = marked.select(*entity, member, "session", F.col(price).isNotNull().alias("__p"), F.col("complete").alias("__c"))
    x = members.join(state, [*entity, member, "session"], "left")
    return x.select(*members.columns, F.coalesce("__p", F.lit(False)).alias("priced"), F.coalesce("__c", F.lit(False)).alias("eligible"))


def asset_coverage(sessions_of: DataFrame, listed: DataFrame, daily: DataFrame, calendar: DataFrame, entity: Sequence[str], member: str) -> DataFrame:
    """Every member and every listed symbol of each entity, once, with one of five statuses.

    ``sessions_of`` is ``member_sessions``, ``listed`` has the symbols with price rows, ``daily`` their valid prices, ``calendar`` the
    sessions. The status is the first that holds: used (any eligible session), no dated membership match, missing price
    symbol, no valid prices during membership, no complete valid window.
    """
    keys = [*entity, member]
    own = sessions_of.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("membership_sessions"), F.min("date").alias("first_membership"), F.max("date").alias("last_membership"),
        F.count_if("priced").alias("valid_prices_during_membership"), F.count_if("eligible").alias("eligible_sessions"), F.max("session").alias("__last"),
    )
    valid = daily.groupBy(*keys).agg(F.min("date").alias("first_valid"), F.max("date").alias("last_valid"))
    ends = calendar.groupBy(*entity).agg(F.max("session").alias("__end"))
    x = own.join(listed.select(*keys, F.lit(True).alias("supplied")), keys, "full").join(valid, keys, "left").join(ends, list(entity), "left")
    status = F.when(F.col("eligible_sessions") > 0, "used").when(F.col("membership_sessions").isNull(), "no dated membership match").when(F.col("supplied").isNull(), "missing price symbol")
    status = status.when(F.col("valid_prices_during_membership") == 0, "no valid prices during membership").otherwise("no complete valid window")
    numbers = ("membership_sessions", "valid_prices_during_membership", "eligible_sessions")
    return x.withColumn("status", status).select(
        *keys, F.coalesce("supplied", F.lit(False)).alias("supplied"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), "first_membership", "last_membership", "first_valid", "last_valid",
        F.coalesce(F.col("__last") == F.col("__end"), F.lit(False)).alias("member_at_end"), "status",
    )


def survivorship(sessions_of: DataFrame, assets: DataFrame, calendar: DataFrame, entity: Sequence[str], member: str) -> DataFrame:
    """Every session of ``calendar`` with expected, matched, eligible members and the eligible ones that are no members at the end."""
    x = sessions_of.join(assets.select(*entity, member, "supplied", "member_at_end"), [*entity, member], "left")
    n = x.groupBy(*entity, "session").agg(F.count(F.lit(1)).alias("expected_members"), F.count_if("supplied").alias("matched_members"), F.count_if("eligible").alias("eligible_members"), F.count_if(F.col("eligible") & ~F.col("member_at_end")).alias("eligible_former_members"))
    return calendar.join(n, [*entity, "session"], "left").fillna(0, ["expected_members", "matched_members", "eligible_members", "eligible_former_members"])


def window_chunks(panel: DataFrame, entity: Sequence[str], k: int, chunk: int) -> DataFrame:
    """Each row once for every chunk of sessions whose windows of k rows hold it: with ``chunk`` numbered from 0.

    A task thus gets ``chunk`` + k - 1 sessions of one entity, however long or busy the entity is.
    """
    first = F.floor((F.col("session") - 1) / chunk)
    last = F.floor((F.col("session") + k - 2) / chunk)
    return panel.withColumn("chunk", F.explode(F.sequence(first, last)))


def matrix_windows(pdf: pd.DataFrame, member: str, value: str, k: int, chunk: int, least: int, still: float = kernels.STILL, active: str | None = None):
    """(session, date, members, k x n block) of every full session of one chunk with at least ``least`` complete members.

    ``active`` names a column that is true where a row's member belongs to its session; others have no part in its window.
    """
    number = int(pdf["chunk"].iloc[0])
    at_session = pdf["session"].to_numpy()
    column, names = pd.factorize(pdf[member], sort=True)
    first = int(at_session.min())
    block = np.full((int(at_session.max()) - first + 1, len(names)), np.nan)
    block[at_session - first, column] = pdf[value].to_numpy(dtype=float)
    use = np.full(block.shape, active is None)
    if active is not None:
        use[at_session - first, column] = pdf[active].to_numpy(dtype=bool)
    dates = dict(zip(at_session.tolist(), pdf["date"]))
    for session in range(number * chunk + 1, (number + 1) * chunk + 1):
        at = session - first
        if at - k + 1 < 0 or session not in dates:
            continue
        window = block[at - k + 1 : at + 1]
        ok = np.isfinite(window).all(axis=0) & use[at]
        ok[ok] = window[:, ok].std(axis=0) > still
        if ok.sum() >= least:
            yield session, dates[session], names[ok], window[:, ok]


def rolling_blocks(panel: DataFrame, entity: Sequence[str], member: str, kernel: Callable, schema: str, value: str = "r", k: int = 60, chunk: int | None = None, least: int = 3, active: str | None = None) -> DataFrame:
    """``kernel(session, date, members, block)`` -> rows (tuples) of ``schema`` for every window of every entity, of its ``active`` members if named."""
    keys, chunk = [*entity, "chunk"], chunk or chunk_of(k)
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key[:-1], *row) for window in matrix_windows(pdf, member, value, k, chunk, least, active=active) for row in kernel(*window)]
        return pd.DataFrame(rows, columns=names)

    full = ", ".join(f"{c} {kinds[c]}" for c in entity) + ", " + schema
    names = [part.strip().split(" ")[0].strip("`") for part in _split_schema(full)]
    rows = panel.filter(F.col(value).isNotNull()).select(*entity, member, "session", "date", value, *([active] if active else []))
    return spread(window_chunks(rows, entity, k, chunk), keys).groupBy(*keys).applyInPandas(run, full)


def _split_schema(schema: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += c
    return [*parts, now]


FEATURES = [
    "h1_entropy_normalized", "h1_max", "h1_total_per_asset", "h1_count_per_asset", "h1_integrated_l2_per_asset", "h0_integrated_l2_per_asset", "h0_mean_lifetime", "average_correlation",
    "eigenvalue_ratio", "landscape1_l1_per_asset", "landscape1_l2_per_asset", "network_clustering", "network_algebraic_connectivity",
]


#: Series and images of a window that are made only if asked for.
EXTRAS = {"betti0": "array<int>", "betti1": "array<int>", "landscape": "array<double>", "image": "array<double>"}


def _summary_schema(extras: Sequence[str]) -> str:
    return "session int, date date, n_assets int, " + ", ".join(f"{c} double" for c in FEATURES) + ", bars array<struct<birth:double,death:double>>" + "".join(f", {c} {EXTRAS[c]}" for c in extras)


def _summary_row(session, date, block: np.ndarray, decay: float, shrink: float, extras: Sequence[str]) -> tuple:
    features, bars, curves = kernels.topology_summary(block, decay, shrink)
    more = (kernels.persistence_image(bars) if c == "image" else curves[c] for c in extras)
    return (session, date, features["n_assets"], *(features[c] for c in FEATURES), [{"birth": b, "death": d} for b, d in bars.tolist()], *(x.tolist() for x in more))


def topology_features(panel: DataFrame, entity: Sequence[str], member: str, k: int = 60, decay: float = 0.94, shrink: float = 0.1, value: str = "r", active: str | None = None, extras: Sequence[str] = tuple(EXTRAS)) -> DataFrame:
    """Per entity and session: n_assets, the summary features, ``bars`` (dimension 1) and those of Betti curves, landscape and persistence image that are in ``extras``."""

    def kernel(session, date, members, block):
        yield _summary_row(session, date, block, decay, shrink, extras)

    return rolling_blocks(panel, entity, member, kernel, _summary_schema(extras), value, k, active=active)


def topology_grid(panel: DataFrame, entity: Sequence[str], member: str, variants: Mapping[str, tuple[int, float, float, str]], active: str | None = None, chunk: int | None = None, least: int = 3, extras: Sequence[str] = tuple(EXTRAS)) -> DataFrame:
    """``topology_features`` under each of ``variants``, name: (k, decay, shrink, value column), with the name as ``variant``.

    The chunks hold the rows of the longest window, so that the panel is spread once for all variants.
    """
    values = sorted({v for *_, v in variants.values()})
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}
    longest = max(k for k, *_ in variants.values())
    chunk = chunk or chunk_of(longest)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (*key[:-1], name, *_summary_row(session, date, block, decay, shrink, extras))
            for name, (k, decay, shrink, value) in variants.items()
            for session, date, _, block in matrix_windows(pdf, member, value, k, chunk, least, active=active)
        ]
        return pd.DataFrame(rows, columns=names)

    full = ", ".join(f"{c} {kinds[c]}" for c in entity) + ", variant string, " + _summary_schema(extras)
    names = [part.strip().split(" ")[0] for part in _split_schema(full)]
    rows = panel.filter(F.coalesce(*values).isNotNull()).select(*entity, member, "session", "date", *values, *([active] if active else []))
    return spread(window_chunks(rows, entity, longest, chunk), [*entity, "chunk"]).groupBy(*entity, "chunk").applyInPandas(run, full)


def diagram_velocity(topology: DataFrame, entity: Sequence[str]) -> DataFrame:
    """``topology`` with w2_per_sqrt_asset: Wasserstein distance to the session's predecessor over the root of the mean asset count; null for the first."""
    s = Series(entity, "session")

    @F.pandas_udf("double")
    def distance(now: pd.Series, before: pd.Series) -> pd.Series:
        arr = lambda bars: np.array([[b["birth"], b["death"]] for b in bars], dtype=float).reshape(-1, 2)
        return pd.Series([None if b is None else kernels.wasserstein(arr(b), arr(a)) for a, b in zip(now, before)], dtype="float64")

    x = topology.withColumns({"__bars": F.lag("bars").over(s.window()), "__n": F.lag("n_assets").over(s.window())})
    return x.withColumn("w2_per_sqrt_asset", distance("bars", "__bars") / F.sqrt((F.col("n_assets") + F.col("__n")) / 2)).drop("__bars", "__n")


def correlation_pairs(panel: DataFrame, entity: Sequence[str], member: str, k: int = 60, decay: float = 0.94, shrink: float = 0.1, value: str = "r", active: str | None = None) -> DataFrame:
    """Average, smallest and largest shrunk correlation of the pairs of each window: entity, session, date, n, average, lowest, highest."""

    def kernel(session, date, members, block):
        rho = kernels.weighted_correlation(block, decay, shrink)
        pairs = rho[np.triu_indices(len(rho), 1)]
        yield session, date, len(rho), float(pairs.mean()), float(pairs.min()), float(pairs.max())

    return rolling_blocks(panel, entity, member, kernel, "session int, date date, n int, average double, lowest double, highest double", value, k, active=active)


def spanning_trees(panel: DataFrame, entity: Sequence[str], member: str, k: int = 60, decay: float = 0.94, shrink: float = 0.1, value: str = "r", active: str | None = None) -> DataFrame:
    """The links of the minimum spanning tree of each window's distances: entity, session, date, ``src``, ``dst``, ``weight``."""

    def kernel(session, date, members, block):
        for a, b, w in kernels.spanning_tree(kernels.distance(kernels.weighted_correlation(block, decay, shrink))):
            yield session, date, str(members[a]), str(members[b]), w

    return rolling_blocks(panel, entity, member, kernel, "session int, date date, src string, dst string, weight double", value, k, active=active)


def correlation_sql(panel: DataFrame, entity: Sequence[str], member: str, k: int = 60, decay: float = 0.94, shrink: float = 0.1, value: str = "r") -> DataFrame:
    """The same average correlation by relational operators alone: weighted sums of pairs of members within one session.

    Each member's window is an array of its last k values, so that a pair is one row a session; entity, session, n, average.
    """
    s = Series([*entity, member], "session")
    w = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pow(F.lit(decay), F.lit(k - 1) - i))
    total = F.lit(sum(decay**i for i in range(k)))
    dot = lambda a, b: F.aggregate(F.zip_with(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), w, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x) / total
    mean = F.aggregate(F.zip_with(F.col("a"), w, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x) / total
    rows = complete_windows(panel, entity, member, value, k).withColumn("a", F.collect_list(value).over(s.trailing(k))).filter("complete").withColumn("m", mean)
    rows = rows.withColumn("v", dot("a", "a") - F.col("m") * F.col("m")).select(*entity, "session", "date", member, "a", "m", "v")
    other = rows.select(*entity, "session", F.col(member).alias("__o"), F.col("a").alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dot("a", "b") - F.col("m") * F.col("mb")) / F.sqrt(F.col("v") * F.col("vb")))) * (1 - shrink)
    pairs = rows.join(other, [*entity, "session"]).filter(F.col(member) < F.col("__o")).select(*entity, "session", "date", rho.alias("rho"))
    return pairs.groupBy(*entity, "session", "date").agg(F.count(F.lit(1)).alias("pairs"), F.avg("rho").alias("average")).filter("pairs >= 3")


def gaussian_scores(panel: DataFrame, entity: Sequence[str], member: str, k: int = 60, every: int = 63, shrinks: Sequence[float] = (0.01, 0.1, 0.2), active: str | None = None) -> DataFrame:
    """How well the shrunk correlation of the k sessions before predicts every ``every``-th session: entity, session, date, shrink, score."""

    def kernel(session, date, members, block):
        if session % every == 0 and (block[:-1].std(axis=0) > kernels.STILL).all():
            for shrink in shrinks:
                yield session, date, float(shrink), kernels.gaussian_score(block[:-1], block[-1], shrink)

    return rolling_blocks(panel, entity, member, kernel, "session int, date date, shrink double, score double", k=k + 1, active=active)


def delay_embedding(series: DataFrame, keys: Sequence[str], value: str, k: int = 60, order: str = "date") -> DataFrame:
    """``series`` with delay_total and delay_entropy of the last k values, null for windows not full, not finite or constant."""
    frame = Series(keys, order).trailing(k)

    @F.pandas_udf("struct<total:double,entropy:double>")
    def summary(windows: pd.Series) -> pd.DataFrame:
        rows = [None if w is None or len(w) < k else kernels.delay_summary(np.asarray(w, dtype=float)) for w in windows]
        return pd.DataFrame([r or (None, None) for r in rows], columns=["total", "entropy"], dtype="float64")

    x = series.withColumn("__w", F.when(F.count(value).over(frame) == k, F.collect_list(value).over(frame))).withColumn("__s", summary("__w"))
    return x.select(*series.columns, F.col("__s.total").alias("delay_total"), F.col("__s.entropy").alias("delay_entropy"))


def kendall_trend(series: DataFrame, keys: Sequence[str], value: str, k: int = 60, order: str = "date") -> DataFrame:
    """``series`` with ``tau``: Kendall's tau-b of the last k values against time; null for windows not full or constant."""
    frame = Series(keys, order).trailing(k)

    @F.pandas_udf("double")
    def tau(windows: pd.Series) -> pd.Series:
        out = np.full(len(windows), np.nan)
        full = np.array([w is not None for w in windows])
        if full.any():
            out[full] = kernels.kendall_tau_b(np.stack(windows[full].to_list()))
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return series.withColumn("__w", F.when(F.count(value).over(frame) == k, F.collect_list(value).over(frame))).withColumn("tau", tau("__w")).drop("__w")


def ols_residual(series: DataFrame, keys: Sequence[str], target: str, regressors: Sequence[str], k: int = 60, least: int = 40, order: str = "date") -> DataFrame:
    """``series`` with ``residual``: the target less its least-squares prediction from the complete rows among the k before it."""
    frame = Series(keys, order).preceding(k)
    whole = target + " is not null and " + " and ".join(f"{c} is not null" for c in regressors)
    row = F.array(F.col(target), *regressors)

    @F.pandas_udf("double")
    def residual(history: pd.Series, now: pd.Series) -> pd.Series:
        size = np.array([0 if x is None or h is None else len(h) for h, x in zip(history, now)])
        out = np.full(len(size), np.nan)
        for n in np.unique(size[size >= least]):  # windows of one length are solved together
            at = np.flatnonzero(size == n)
            a = np.array([np.stack(history.iloc[i]) for i in at], dtype=float)
            x = np.array([now.iloc[i] for i in at], dtype=float)
            design = np.concatenate([np.ones((len(at), n, 1)), a[:, :, 1:]], axis=2)
            beta = np.linalg.pinv(design, rcond=np.finfo(float).eps * max(design.shape[1:])) @ a[:, :, :1]
            out[at] = x[:, 0] - beta[:, 0, 0] - (x[:, None, 1:] @ beta[:, 1:])[:, 0, 0]
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    x = series.withColumn("__x", F.when(F.expr(whole), row))
    return x.withColumn("__h", F.collect_list("__x").over(frame)).withColumn("residual", residual("__h", "__x")).drop("__x", "__h")


