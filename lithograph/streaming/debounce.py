"""Debounced plans: the changes of a repository are emitted as one plan once it has been quiet for a time.

Keyed state with timers (`transformWithState`): for each repository a map of its pending changes by time
and path (state is written by entry, not whole), and a timer behind each change that might be a plan's
last. Time is the events' own, moved on by the watermark that events of any repository raise: when a timer
fires, all changes up to it have come, so it is known whether it was quiet. Plans therefore do not depend
on how rows fall into micro-batches, and a restart from the checkpoint goes on with what was pending. The
state store is RocksDB, as this needs it.

Defined cases: rows without repository, path or time are left out; of several changes of a path the
last by time counts, of equal times the greater text; changes back to back keep a plan open; rows behind the
watermark are late and left out by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLAN = "repo string, until timestamp, path string, change string"


class Pending(StatefulProcessor):
    """The pending changes of one repository."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long, path string", "change string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, str], str] = {}
        for batch in rows:
            for path, at, change in zip(batch["path"], batch["at"], batch["change"], strict=True):
                found[int(at), path] = max(found.get((int(at), path), ""), change)
        for at_path, change in found.items():
            before = self.pending.getValue(at_path)[0] if self.pending.containsKey(at_path) else ""
            self.pending.updateValue(at_path, (max(before, change),))
        times = sorted({at for at, _ in found})
        for at, after in zip(times, [*times[1:], None], strict=True):
            if after is None or after > at + self.quiet:  # else a later change of this batch keeps the plan open
                self.handle.registerTimer(at + self.quiet)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() - self.quiet
        entries = sorted((at, path, value[0]) for (at, path), value in self.pending.iterator())
        due = [x for x in entries if x[0] <= until]
        if due and due[-1][0] == until and not any(until < at <= until + self.quiet for at, _, _ in entries):
            last = {path: change for _, path, change in due}
            for at, path, _ in due:
                self.pending.removeKey((at, path))
            yield pd.DataFrame({"repo": [key[0]] * len(last), "until": [pd.Timestamp(until, unit="ms")] * len(last), "path": list(last), "change": list(last.values())})

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> None:
    """Sets the state store of streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def debounced(changes: DataFrame, quiet_ms: int, late: str = "0 seconds") -> DataFrame:
    """repo, until, path, change: the plans of a stream changes(repo, path, change, ts); until is the time of a plan's last change.

    A plan is whole once no change came for ``quiet_ms``; its rows come together in one micro-batch.
    """
    prepared(changes.sparkSession)
    rows = changes.where("repo is not null and path is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("repo", "path", F.coalesce("change", F.lit("")).alias("change"), F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("repo").transformWithStateInPandas(Pending(quiet_ms), PLAN, "Append", "EventTime")
