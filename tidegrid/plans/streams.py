"""Queries that run the streaming forms over the events table until all of it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as ev
from .bases import Catalogue

cat = Catalogue()


def source(spark, d):
    """The events without a watermark: files come in any order of time, and no row of the table is to be late."""
    return ev.moments(ev.read_events(spark, f"{d}/events.parquet", ALL_FILES), late=None)


#: Files a batch: more than any table has, so that what is there is one batch.
ALL_FILES = 1_000_000_000


@cat.add("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_stream_windows(spark, d):
    """Daily counts and totals by event type; the last result of each window counts."""
    out = ev.run_available(ev.windowed_counts(source(spark, d), "event_type", "value"), "windows", "update")
    last = out.groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
    return last.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


@cat.add("""WITH e AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true)::INT AS first FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def q_stream_sessions(spark, d):
    """Sessions per user, those still open at the end included: the last batch holds them all."""
    out = ev.run_available(ev.session_counts(source(spark, d), "user_id"), "sessions", "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@cat.add("SELECT user_id, round(max(value), 4) AS high, count(*) AS n FROM events GROUP BY user_id")
def q_stream_running_high(spark, d):
    """The high-water mark of each user, kept as custom state."""
    out = ev.run_available(ev.running_high(source(spark, d), "user_id", "value"), "highs", "update")
    return out.groupBy("user_id").agg(F.round(F.max("high"), 4).alias("high"), F.max("n").alias("n"))
