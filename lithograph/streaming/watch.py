"""Streams: event-time aggregates, and a watcher that turns snapshots into change plans.

Instead of a polling loop, the snapshots are a file stream: each micro-batch is
diffed with the state table of the last one, and the plan goes to ``on_plan``. Writes are idempotent by
batch id, so a batch that is run again after a failure leaves the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lithograph.operators.graph import cut
from lithograph.operators.ingest import snapshot_diff


def _timed(events: DataFrame, late: str) -> DataFrame:
    """The events with a watermark; times stored without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; rows later than the watermark are left out."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return _timed(events, late).groupBy("event_type", span.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """One row for each run of a user's events without a gap."""
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def watch(snapshots: DataFrame, state: str, checkpoint: str, on_plan: Callable[[DataFrame, int], None], once: bool = True, settle: bool = False) -> StreamingQuery:
    """Diffs snapshots(path, sha) with the state before them.

    A column ``snapshot`` (numbers that rise) tells apart the snapshots of one micro-batch, which are
    then planned one after the other; without it a micro-batch is one snapshot. ``settle``: of the
    snapshots that came together only the last is planned, against the state before all of them; what
    was changed and changed back is then no change. ``state``: a folder with one Parquet table a batch;
    the newest one before a batch is its old state, whichever batches left one.
    ``once``: catch up on what is there and end; else poll every five seconds.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        make = spark._jvm.org.apache.hadoop.fs.Path
        fs = make(state).getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(make(state))] if fs.exists(make(state)) else []
        before = max((n for n in done if n < number), default=None)
        rows = batch if "snapshot" in batch.columns else batch.withColumn("snapshot", F.lit(0))
        rows = cut(rows.groupBy("snapshot", "path").agg(F.max("sha").alias("sha")))
        new = rows.select("path", "sha").limit(0)
        old = new if before is None else spark.read.schema(new.schema).parquet(f"{state}/batch={before}")
        numbers = [r["snapshot"] for r in rows.select("snapshot").distinct().orderBy("snapshot").collect()]
        for n in numbers[-1:] if settle else numbers:
            new = rows.where(F.col("snapshot") == n).select("path", "sha")
            on_plan(snapshot_diff(old, new).where("change <> 'unchanged'"), number)
            old = new
        if numbers:
            new.write.mode("overwrite").parquet(f"{state}/batch={number}")

    writer = snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
