"""What changed between consecutive full snapshots: signed cells whose grouped sums that are not 0 tell the changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import split_packed

#: The name of the cell that marks the presence of a key; no field may be called so.
PRESENT = "__present"


def neighbours(snapshots: DataFrame, entity: Sequence[str], version: str, items: str) -> DataFrame:
    """``snapshots`` with ``__next``, the entity's following version, and ``__first``, whether the version is its first.

    Only the pairs of entity and version are ordered within an entity; what was found is joined to the snapshots by both, so
    that an entity's contents never pass through one task. The size of ``items`` is asked for on both sides, so that both
    read one exchange.
    """
    w = Window.partitionBy(*entity).orderBy(version)
    at = snapshots.filter(F.size(items) >= 0).select(*entity, version)
    order = at.withColumns({"__next": F.lead(version).over(w), "__first": F.row_number().over(w) == 1})
    return snapshots.join(order, [*entity, version])


def snapshot_changes(snapshots: DataFrame, entity: Sequence[str], version: str, items: str, key: str, fields: Sequence[str], first: bool = False) -> DataFrame:
    """Records added, removed or changed between each snapshot and the preceding one of its entity.

    ``snapshots`` has one row per entity and version with ``items``, an array of structs of ``key`` and ``fields``; it may
    be empty but not null. Versions are compared in the order of ``version``. A key given several times in one snapshot
    counts once, with its first fields; null keys count for nothing; null fields equal each other. With ``first`` the
    entity's first snapshot adds all its keys, else it gives no rows. Other columns are ignored; no rows give no rows.

    Result: entity, version, key, ``change`` (added, removed, changed), ``fields`` (sorted names of the changed fields,
    all of them for added and removed), ``now`` (map of those fields to their values in the later snapshot, as strings). Every
    snapshot is unpivoted into cells (key, field, value) that count +1 for their own version and -1 for the next one, so that
    equal cells cancel; the sums that stay tell what differs. Versions are numbered apart from their contents. A key's
    fields travel once, to the task of (entity, key), and are unpivoted there; so no entity is one task, and a key there
    holds one small row a version.
    """
    assert PRESENT not in fields
    return signed_changes(neighbours(snapshots.select(*entity, version, items), entity, version, items), entity, version, items, key, fields, first)


def signed_changes(numbered: DataFrame, entity: Sequence[str], version: str, items: str, key: str, fields: Sequence[str], first: bool) -> DataFrame:
    """``snapshot_changes`` of snapshots that have ``__next`` and, unless ``first``, ``__first``."""
    key_of = lambda x: x[key]
    once = F.filter(items, lambda x, i: key_of(x).isNotNull() & (F.array_position(F.transform(items, key_of), key_of(x)) == i + 1))
    own = F.lit(True) if first else ~F.col("__first")
    rows = numbered.select(*entity, F.when(own, F.col(version)).alias("__own"), "__next", F.explode(once).alias("__i"))
    rows = rows.select(*entity, F.col(f"__i.{key}").alias(key), "__own", "__next", *(F.col(f"__i.{f}").cast("string").alias(f"__f{i}") for i, f in enumerate(fields))).repartition(*entity, key)
    versions = F.filter(F.array(F.struct(F.col("__own").alias("v"), F.lit(1).alias("sign")), F.struct(F.col("__next").alias("v"), F.lit(-1).alias("sign"))), lambda x: x["v"].isNotNull())
    cells = F.array(F.struct(F.lit(PRESENT).alias("field"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(f).alias("field"), F.col(f"__f{i}").alias("value")) for i, f in enumerate(fields)))
    signed = rows.select(*entity, key, cells.alias("__cells"), F.explode(versions).alias("__v")).select(*entity, key, F.col("__v.v").alias(version), F.col("__v.sign").alias("__sign"), F.explode("__cells").alias("__c"))
    left = (
        signed.groupBy(*entity, version, key, F.col("__c.field").alias("__field"), F.col("__c.value").alias("__value"))  # this grouping and the next keep to the exchange above
        .agg(F.sum("__sign").alias("__sum"))
        .filter(F.col("__sum") != 0)
    )
    entry = F.when((F.col("__field") != PRESENT) & (F.col("__sum") > 0), F.struct("__field", "__value"))
    here = F.coalesce(F.max(F.when(F.col("__field") == PRESENT, F.col("__sum"))), F.lit(0))
    return (
        left.groupBy(*entity, version, key)
        .agg(here.alias("__here"), F.sort_array(F.collect_set(F.when(F.col("__field") != PRESENT, F.col("__field")))).alias("fields"), F.map_from_entries(F.collect_list(entry)).alias("now"))
        .select(*entity, version, key, F.when(F.col("__here") > 0, "added").when(F.col("__here") < 0, "removed").otherwise("changed").alias("change"), "fields", "now")
    )


def deliveries_with_values(membership: DataFrame) -> DataFrame:
    """Membership deliveries that hold any value: basket, date, received_at, snapshot_id and ``items``, an array of (ticker, units).

    ``units[i]`` belongs to the i-th value; a value without a unit, or an array that is null or too short, has null units.
    Rows without basket or date count for nothing.
    """
    rows = membership.select("snapshot_id", "basket", "date", "received_at", "tickers", "units").filter("basket is not null and date is not null and tickers is not null")
    return (
        split_packed(rows, "tickers", into="names")
        .filter(F.size("names") > 0)
        .select("basket", "date", "received_at", "snapshot_id", F.transform("names", lambda n, i: F.struct(n.alias("ticker"), F.get("units", i).alias("units"))).alias("items"))
    )


def last_received(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``: combined on the map side, so repeats of one key never meet in one task."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    best = F.max_by(F.struct(*order, *rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def membership_changes(membership: DataFrame) -> DataFrame:
    """Added, removed and changed members between successive snapshots of each basket: basket, date, ticker, change, fields.

    The snapshot of a (basket, date) is its last received delivery with values (then the greatest snapshot_id).
    """
    last = last_received(deliveries_with_values(membership), ["basket", "date"], ["received_at", "snapshot_id"])
    return snapshot_changes(last, ["basket"], "date", "items", "ticker", ["units"])
