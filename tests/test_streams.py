"""The streams over a table of several files that are not in the order of time."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegrid.plans import streams


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for part in (2, 0, 3, 1):  # the latest stretches first
        e.withColumn("part", F.ntile(4).over(Window.orderBy("ts"))).filter(F.col("part") == part + 1).drop("part").coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["q_stream_windows", "q_stream_sessions"])
@pytest.mark.parametrize("files", [1, 1_000])
def test_no_row_is_late(spark, folder, name, files, monkeypatch):
    monkeypatch.setattr(streams, "ALL_FILES", files)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    result = db.execute(streams.cat.sql[name])
    names = [c[0] for c in result.description]
    plain = lambda t: tuple(f"{v:.6g}" if isinstance(v, float) else v for v in t)
    assert sorted(map(plain, rows(streams.cat.queries[name](spark, folder).select(*names))), key=str) == sorted(map(plain, result.fetchall()), key=str)
