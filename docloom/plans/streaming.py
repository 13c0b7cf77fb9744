"""Streams over the event, order and line tables, run to their present end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Tables
from ..streaming import streams
from .registry import query


def _stream(t: Tables, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream; the pattern lets it be one file or a folder of files."""
    return streams.source(t.spark, f"{t.folder}/{name}.parque[t]", getattr(t, name).schema, files_per_batch)


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_type_counts(t: Tables) -> DataFrame:
    return streams.latest(streams.type_counts(_stream(t, "events"), "event_type"), "stream_types")


@query("SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling(t: Tables) -> DataFrame:
    """Days that the watermark has passed."""
    days = streams.tumbling(_stream(t, "events"), "ts", "1 day", "1 hour", "event_type")
    return _plain(streams.appended(days, "stream_days"), "window_start", "window_end")


@query(
    """WITH d AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_session(t: Tables) -> DataFrame:
    """Sessions that the watermark has passed."""
    own = streams.sessions(_stream(t, "events"), "ts", "30 minutes", "1 hour", "user_id")
    return _plain(streams.appended(own, "stream_sessions"), "session_start", "session_end")


@query("SELECT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def stream_late_binding(t: Tables) -> DataFrame:
    """Lines bound to their orders, whichever stream brings its row first."""
    lines = _stream(t, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey")
    orders = _stream(t, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return streams.appended(streams.late_binding(lines, orders, ["l_orderkey"]), "stream_bound")
