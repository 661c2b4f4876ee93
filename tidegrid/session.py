"""Session helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where the session names none, a temporary folder serves a session that runs in one process, as in tests; on a cluster, whose
    executors could not see it, the setting is asked for.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidegrid-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` by ``keys`` in a number of partitions that work, not bytes, asks for: groups that cost much time are small in bytes, and few large partitions would leave cores idle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
