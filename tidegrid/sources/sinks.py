"""Sinks: table directories with an index, atomic replacement, upsert, export, documents, manifests and Markdown."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tables: Mapping[str, DataFrame], folder: str, documents: Mapping[str, object] | None = None) -> None:
    """Writes every table as parquet under ``folder`` with ``table_index`` (table, rows) and ``documents`` (name, content).

    Each table is written beside its place and swapped in whole.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        replace(df, f"{folder}/{name}")
    counts = [(name, spark.read.parquet(f"{folder}/{name}").count()) for name in tables]
    replace(spark.createDataFrame(counts, "table string, rows bigint"), f"{folder}/table_index")
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in (documents or {}).items()]
    replace(spark.createDataFrame(rows, "name string, content string"), f"{folder}/documents")


def replace(df: DataFrame, path: str) -> None:
    """Writes parquet beside ``path`` and swaps it in: the old table is renamed aside, the new one in, and the old one is removed last.

    A failed swap puts the old table back. One that was broken off between the renames leaves the old table aside; the
    next call puts it back before it writes. Between the renames ``path`` is missing for an instant, never half written.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    new, old, target = (jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", ".old", ""))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)
    df.write.mode("overwrite").parquet(path + ".new")
    aside = fs.exists(target)
    if aside and not fs.rename(target, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, target):
        if aside:
            fs.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    if aside:
        fs.delete(old, True)


def save_models(fits: DataFrame, groups: Mapping[str, Sequence[str]], folder: str) -> None:
    """Fitted models (rows of coefficients) with the columns of their groups, as two tables under ``folder``."""
    replace(fits, f"{folder}/fits")
    replace(fits.sparkSession.createDataFrame([(k, list(v)) for k, v in groups.items()], "model string, columns array<string>"), f"{folder}/groups")


def load_models(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """What ``save_models`` wrote: the fits and the columns of each group."""
    return spark.read.parquet(f"{folder}/fits"), {r["model"]: list(r["columns"]) for r in spark.read.parquet(f"{folder}/groups").collect()}


def published(spark: SparkSession, folder: str) -> list[str]:
    return sorted(r[0] for r in spark.read.parquet(f"{folder}/table_index").select("table").collect())


def export_csv(spark: SparkSession, folder: str, name: str, path: str) -> None:
    """One published table as CSV with a header; names that are not in the index are refused."""
    if name not in published(spark, folder):
        raise ValueError(f"{name} is not published")
    spark.read.parquet(f"{folder}/{name}").write.mode("overwrite").option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it does not have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def release_manifest(spark: SparkSession, folder: str, **facts: object) -> dict[str, object]:
    """What a release holds: its tables with their rows, the files with lengths and hashes, and ``facts`` such as versions or settings."""
    rows = spark.read.parquet(f"{folder}/table_index").orderBy("table").collect()
    files = manifest(spark, f"{folder}/*/*.parquet").orderBy("path").collect()
    held = [{"path": "/".join(r["path"].rsplit("/", 2)[1:]), "length": r["length"], "sha256": r["sha256"]} for r in files]
    return {"tables": {r["table"]: r["rows"] for r in rows}, "files": held, "spark": spark.version, **facts}


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown, floats with 4 decimals; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(text, r)) + " |" for r in rows)])
