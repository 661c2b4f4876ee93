"""Contracts on input tables: violations as rows, and refusal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import positive


class ContractError(ValueError):
    """A table breaks its contract."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows share, with ``n``; null keys count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def quarantine(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the value null where it is not finite and above 0, the rows whose value was replaced)."""
    bad = F.col(value).isNotNull() & positive(value).isNull()
    return df.withColumn(value, positive(value)), df.filter(bad)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, rows: how many rows break each rule (a rule is broken where it is not true). One pass over the table."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n in rules))).alias("r")).select("r.*")


def refuse(df: DataFrame, what: str) -> None:
    """Raises ContractError if ``df`` has any row, showing the first few."""
    rows = df.take(3)
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns {missing}")


def require_real(manifest: Mapping[str, object], symbols: DataFrame, symbol: str = "symbol") -> None:
    """Refuses input whose manifest does not call it real, or that holds made-up symbols (SYN and three digits or more)."""
    if manifest.get("data_kind") != "real":
        raise ContractError("the manifest does not say data_kind real")
    refuse(symbols.filter(F.col(symbol).rlike(r"^SYN\d{3,}$")).select(symbol).distinct(), "made-up symbols")


def membership_contract(snapshots: DataFrame, array: str, entity: Sequence[str], date: str) -> DataFrame:
    """rule, rows: null arrays, repeated names within a snapshot, and (entity, date) given several times."""
    own = violations(snapshots, {"null": F.col(array).isNotNull(), "repeated name": F.size(F.array_distinct(array)) == F.size(array)})
    return own.unionByName(duplicate_keys(snapshots, [*entity, date]).agg(F.lit("repeated snapshot").alias("rule"), F.count(F.lit(1)).alias("rows")).select("rule", "rows"))


def against_reference(found: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, expected: str, most: float = 0.02) -> DataFrame:
    """Every row of ``reference`` with ``status``: not_available where ``found`` has no value, mismatch beyond ``most``, else match."""
    x = reference.join(found.select(*keys, value), list(keys), "left")
    off = ~(F.abs(F.col(value) - F.col(expected)) <= most)
    return x.withColumn("status", F.when(F.col(value).isNull(), "not_available").when(F.coalesce(off, F.lit(True)) | F.isnan(expected), "mismatch").otherwise("match"))


def series_contract(df: DataFrame, keys: Sequence[str], date: str, value: str, start: str, name: str) -> DataFrame:
    """rule, rows of a series table: values that are not finite and above 0 are not asked for here, only nulls; repeated dates of a key; keys that begin after ``start``."""
    own = violations(df, {f"{name} null": F.col(value).isNotNull() & F.col(date).isNotNull()})
    twice = duplicate_keys(df.filter(F.col(date).isNotNull()), [*keys, date]).agg(F.lit(f"{name} repeated").alias("rule"), F.count(F.lit(1)).alias("rows"))
    late = df.groupBy(*keys).agg(F.min(date).alias("__first")).agg(F.lit(f"{name} late").alias("rule"), F.count_if(~F.coalesce(F.col("__first") <= F.lit(start).cast("date"), F.lit(False))).alias("rows"))
    return own.unionByName(twice).unionByName(late)
