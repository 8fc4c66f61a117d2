"""Catalogue: the streaming operators, fed with a table's files and run until all are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.tables import table
from marlstone.scratch import scratch
from marlstone.streaming import incremental


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    kind = table(spark, d, name).schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{d}/{name}*.parquet")


def stream_incremental_postings(spark: SparkSession, d: str) -> DataFrame:
    out, mark = scratch(spark, "postings"), scratch(spark, "mark")
    chunks = _stream(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    incremental.incremental_postings(chunks, out, mark)
    return spark.read.parquet(out).select("chunk_id", "term", "tf")


def stream_event_dedupe(spark: SparkSession, d: str) -> DataFrame:
    out, mark = scratch(spark, "events"), scratch(spark, "mark")
    e = _stream(spark, d, "events").select(F.col("user_id").alias("session_id"), F.date_trunc("hour", "ts").cast("string").alias("id"))
    incremental.append_events(e, out, mark)
    return spark.read.parquet(out).groupBy("session_id").agg(F.count("*").alias("hours"))


def stream_session_counters(spark: SparkSession, d: str) -> DataFrame:
    out, mark = scratch(spark, "counters"), scratch(spark, "mark")
    e = _stream(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("type"))
    incremental.session_counters(e, out, mark)
    rows = spark.read.parquet(out)
    return rows.groupBy("session_id").agg(F.max_by("events", "batch").alias("events"), F.max_by("users", "batch").alias("users"))


def event_time_windows(spark: SparkSession, d: str) -> DataFrame:
    w = incremental.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = incremental.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return s.select("user_id", at("session_start").alias("session_start"), at("last").alias("last"), "n")


QUERIES = {f.__name__: f for f in (stream_incremental_postings, stream_event_dedupe, stream_session_counters, event_time_windows, session_windows)}

ORACLES = {
    "stream_incremental_postings": "SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS term FROM documents) GROUP BY ALL",
    "stream_event_dedupe": "SELECT user_id AS session_id, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY user_id",
    "stream_session_counters": "SELECT conv_id AS session_id, count(*) AS events, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id",
    "event_time_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "session_windows": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM s GROUP BY user_id, k""",
}
