"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import canonical_symbol
from .calendars import as_of
from .snapshots import signed_changes, deliveries_with_values


def known_versions(deliveries: DataFrame, entity: Sequence[str], date: str, received: str, tie: str, items: str = "items") -> DataFrame:
    """The versions of each entity that became the known one, with ``known_from``, the first day on which they were, and
    ``__next``, that of the following version.

    A delivery is known from the later of its ``date`` and the day of ``received``. Of the known ones the greatest
    (``date``, ``received``, ``tie``) holds, so a late delivery of an older date never replaces a newer one. Only the best
    delivery of each day is kept before the running maximum, whose window holds days and ranks alone, one small row per
    entity and day; what it keeps is joined back to the contents (``items``, an array) by entity and day. Deliveries
    without a day count for nothing.
    """
    rest = [c for c in deliveries.columns if c not in {*entity, date, received, tie}]
    order = [date, received, tie]
    dated = deliveries.withColumn("known_from", F.greatest(F.col(date), F.to_date(received))).filter("known_from is not null")
    daily = dated.groupBy(*entity, "known_from").agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__v")).select(*entity, "known_from", "__v.*")
    w = Window.partitionBy(*entity).orderBy("known_from")
    rank = F.struct(*order)
    before = F.max(rank).over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = daily.filter(F.size(items) >= 0).select(*entity, "known_from", *order).withColumn("__before", before).filter(F.col("__before").isNull() | (rank > F.col("__before")))
    return daily.join(held.select(*entity, "known_from", F.lead("known_from").over(w).alias("__next")), [*entity, "known_from"])


def change_histories(versions: DataFrame, entity: Sequence[str], key: str, fields: Mapping[str, str]) -> DataFrame:
    """One independent history per attribute: entity, key, ``day``, ``attribute``, ``value``.

    ``versions`` has ``known_from``, ``__next`` and ``items``. The attribute ``present`` is 'true' from the day a key appears and null
    from the day it leaves; each of ``fields`` gets a row only on days on which its own value changed. Nothing is
    repeated for attributes that did not change, so no wide version rows arise.
    """
    changes = signed_changes(versions, entity, "known_from", "items", key, list(fields), first=True)
    gone = F.col("change") == "removed"
    cells = [
        F.struct(F.lit("present").alias("attribute"), F.when(gone, None).otherwise(F.lit("true")).alias("value"), (F.col("change") != "changed").alias("use")),
        *(F.struct(F.lit(f).alias("attribute"), F.when(~gone, F.col("now")[f]).alias("value"), (gone | F.array_contains("fields", f)).alias("use")) for f in fields),
    ]
    return changes.select(*entity, key, F.col("known_from").alias("day"), F.explode(F.array(*cells)).alias("c")).filter("c.use").select(*entity, key, "day", "c.attribute", "c.value")


def attach_known(events: DataFrame, histories: DataFrame, keys: Sequence[str], day: str, attributes: Mapping[str, str]) -> DataFrame:
    """``events`` (columns ``keys`` and ``day``) with each attribute's value as known on that day, null where none was.

    ``histories`` has keys, ``day``, ``attribute``, ``value`` (string; a null value ends the last one); ``attributes``
    gives the type of each. A change on the very day is known. Histories and events are laid under one another and
    every attribute is matched on its own by a last-known window over its own changes; the pivot back to columns is
    the select that holds those windows, so there is one exchange by ``keys`` and no range join. Rows are kept one to one.
    """
    w = Window.partitionBy(*keys).orderBy("__day", "__event").rowsBetween(Window.unboundedPreceding, 0)
    changes = histories.select(*keys, F.col("day").alias("__day"), F.lit(0).alias("__event"), "attribute", F.struct("value").alias("value"))
    asked = events.select(*keys, F.col(day).alias("__day"), F.lit(1).alias("__event"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("struct<value:string>").alias("value"))
    last = lambda a: F.last(F.when(F.col("attribute") == a, F.col("value")), ignorenulls=True).over(w)["value"]
    return changes.unionByName(asked).select(*keys, "__day", "__event", *(last(a).cast(t).alias(a) for a, t in attributes.items())).filter("__event = 1").select(*keys, F.col("__day").alias(day), *attributes)


def series_days(prices: DataFrame) -> DataFrame:
    """The distinct (basket, symbol, date) of price rows with a date and a symbol, spread by (basket, symbol).

    Days are gathered into one bitmap per series and month before anything is shuffled, so that repeated deliveries
    and long series cost one small row a month, and are opened again behind the exchange.
    """
    months = (
        prices.filter("date is not null and symbol is not null and basket is not null")
        .groupBy("basket", "symbol", F.trunc("date", "month").alias("m"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth("date"))).alias("bits"))
        .select("basket", canonical_symbol("symbol").alias("symbol"), "m", "bits")
        .filter("symbol is not null")
        .repartition("basket", "symbol")
        .groupBy("basket", "symbol", "m")
        .agg(F.bit_or("bits").alias("bits"))
    )
    days = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda d: F.getbit("bits", d) == 1)
    return months.select("basket", "symbol", "m", F.explode(days).alias("d")).select("basket", "symbol", F.date_add("m", F.col("d") - 1).alias("date"))


def membership_as_known(prices: DataFrame, membership: DataFrame) -> DataFrame:
    """Every distinct key of ``prices`` with its membership as known by the end of that date.

    Columns basket, symbol, date, ``present`` (true, or null when not a member or nothing was known), ``units``.
    """
    versions = known_versions(deliveries_with_values(membership), ["basket"], "date", "received_at", "snapshot_id")
    histories = change_histories(versions, ["basket"], "ticker", {"units": "int"})
    histories = histories.withColumnRenamed("ticker", "symbol")
    return attach_known(series_days(prices), histories, ["basket", "symbol"], "date", {"present": "boolean", "units": "int"})


def member_spans(calendar: DataFrame, membership: DataFrame) -> DataFrame:
    """The sessions from ``first`` to ``last`` on which one version of a basket's members was the known one: basket, symbol, first, last.

    ``calendar`` has basket, date and session; a delivery counts by the end of the day from which it is known. Members without
    any price are there too; sessions on which no delivery was known lie in no span. Sessions are matched to versions by
    basket alone, before a version's names are spread.
    """
    versions = known_versions(deliveries_with_values(membership), ["basket"], "date", "received_at", "snapshot_id").select("basket", "known_from", "items")
    matched = as_of(calendar, versions.select("basket", F.col("known_from").alias("date"), "known_from"), ["basket"], ["known_from"]).filter("known_from is not null")
    spans = matched.groupBy("basket", "known_from").agg(F.min("session").alias("first"), F.max("session").alias("last"))
    return spans.join(versions, ["basket", "known_from"]).select("basket", F.explode(F.array_distinct("items.ticker")).alias("symbol"), "first", "last").filter("symbol is not null")


def members_by_session(calendar: DataFrame, spans: DataFrame) -> DataFrame:
    """The members of each basket on each of its sessions: basket, symbol, session, date."""
    return spans.select("basket", "symbol", F.explode(F.sequence("first", "last")).alias("session")).join(calendar.select("basket", "session", "date"), ["basket", "session"])
