"""File sources: CSV under a schema, header probe, text lines, JSON documents, array archives and SQLite tables."""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a header under a fixed schema, malformed rows refused; only ``columns`` are parsed. Large files are split natively."""
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST", dateFormat=date_format, enforceSchema=False).csv(path)
    return df.select(*columns) if columns else df


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The column names in the header of a CSV file, without reading its rows."""
    return spark.read.option("header", True).csv(path).columns


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file that are not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON documents; a wrong one is refused."""
    reader = spark.read.options(multiLine=True, mode="FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The one- and two-dimensional arrays of .npz archives: path, name, row, values ARRAY<DOUBLE>; a vector is row 0."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    for key in archive.files:
                        block = np.atleast_2d(np.asarray(archive[key], dtype=float))
                        rows += [(name, key, i, block[i].tolist()) for i in range(len(block))]
            yield pd.DataFrame(rows, columns=["path", "name", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, row int, values array<double>")


class SqliteRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    """Reads one table in ranges of its row numbers, one per task."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.names = options["path"], options["table"], schema.fieldNames()
        self.parts = int(options.get("partitions", "4"))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [SqliteRange(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [SqliteRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join(quoted(n) for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").options(path=..., table=..., partitions=...)``: a table of a SQLite file on storage all tasks see."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            info = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not info:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], kinds.get(r[2].upper(), T.StringType())) for r in info])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, name: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=name, partitions=partitions).load()
