"""Structured Streaming forms over event tables: tumbling windows, gap sessions and alarm episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpoint_folder


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder, or over one file, in the schema of those there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def moments(events: DataFrame, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Events with ``at``, a timestamp with a watermark; without one (``late`` None) no row is ever late, and state is never dropped."""
    x = events.withColumn("at", F.col(ts).cast("timestamp"))
    return x.withWatermark("at", late) if late else x


def windowed_counts(events: DataFrame, key: str, value: str, width: str = "1 day") -> DataFrame:
    """key, start, n, total per tumbling window."""
    x = events.groupBy(key, F.window("at", width)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return x.select(key, F.col("window.start").alias("start"), "n", "total")


def session_counts(events: DataFrame, key: str, gap: str = "6 hours") -> DataFrame:
    """key, start, end, n per session of events no further apart than ``gap``.

    In append mode only sessions behind the watermark come out; in complete mode, without one, the open ones do as well.
    """
    x = events.groupBy(key, F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return x.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_high(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, high, n after each batch: a custom state per key (the high-water mark and the number of events)."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, n = state.get if state.exists else (float("-inf"), 0)
        for pdf in batches:
            high, n = max(high, float(pdf[value].max())), n + len(pdf)
        state.update((high, n))
        yield pd.DataFrame({key: [k[0]], "high": [high], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, high double, n bigint", "high double, n bigint", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, in the shared folder, and returns what it wrote (``batch`` numbers the triggers)."""
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/streams/{name}-{spark.sparkContext.applicationId}-{id(stream)}"
    out = f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("number")
