"""Streams: change feeds of files, incremental postings, exactly-once event appends, stateful projections, time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.lexical import postings


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feeds all that is there to ``batch``, in micro-batches, then stops; what a checkpoint has seen isn't fed again."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def watch(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 2.0, suffixes: tuple[str, ...] = ("py", "md", "js", "ts", "go", "java")) -> StreamingQuery:
    """Calls ``handle`` with the new files of each ``seconds``; dotted paths are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    shown = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes) & ~F.contains("path", F.lit("/.")))
    return shown.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def incremental_postings(chunks: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the postings of new chunks to the table at ``path``, a folder for each batch, so that a batch that is fed again replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        postings(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(chunks, batch, checkpoint)


def append_events(events: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("session_id", "id")) -> None:
    """Appends each event once by its keys, within a batch and against all before. Keys that were seen are the stream's state, held by partition
    beside its checkpoint, so a batch costs its own rows alone, however long the log is."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(events.dropDuplicates(list(keys)), batch, checkpoint)


def session_counters(events: DataFrame, path: str, checkpoint: str) -> None:
    """A stateful projection: running counts by session and type; ``path`` holds the changed sessions of each batch, the latest of which wins."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(("events", "users"), state.get, strict=True)) if state.exists else {"events": 0, "users": 0}
        for f in frames:
            held["events"] += len(f)
            held["users"] += int((f["type"] == "user").sum())
        state.update((held["events"], held["users"]))
        yield pd.DataFrame({"session_id": [key[0]], "events": [held["events"]], "users": [held["users"]]})

    kind = events.schema["session_id"].dataType.simpleString()
    counted = events.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, events long, users long", "events long, users long", "update", "NoTimeout")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = counted.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def tumbling(events: DataFrame, ts: str, width: str, *by: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows; for streams, rows later than ``late`` may be dropped."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = rows.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each ``by`` that end after a ``gap`` without events."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    w = rows.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return w.select(by, F.col("session_window.start").alias("session_start"), "last", "n")
