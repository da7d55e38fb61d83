"""Pulls of a fixed width without gaps: a window that nothing fell into is given too, once.

Each source has a keyed state: where its next window starts, and the counts of
the windows that are open.  An event-time timer stands at the end of the next
window; when the watermark has passed it, that window and all others that have
ended are given, with their counts or zero, and the timer moves on.  So
windows come out in order, none twice, and a source that has gone silent keeps
giving empty ones as long as time passes elsewhere.

The first window of a source is its baseline: what is seen in it was there
before it was watched.

Defined cases: rows without a time take no part; a null source is a source of
its own; rows for windows that have been given are late and are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "source string, started timestamp, n long, baseline boolean"


class Pulls(StatefulProcessor):
    """Counts rows by window, and gives each window that has ended."""

    def __init__(self, width_ms: int):
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pulls", "next long, first long, counts string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        for batch in rows:
            starts = batch["started_ms"].to_numpy()
            for start, n in zip(*[x.tolist() for x in pd.Series(starts).value_counts().reset_index().to_numpy().T], strict=True):
                counts[start] = counts.get(start, 0) + n
        if self.state.exists():
            following, first, held = self.state.get()
        else:
            following = first = min(counts)
            held = "{}"
            self.handle.registerTimer(following + self.width)
        open_ = {int(k): v for k, v in json.loads(held).items()}
        for start, n in counts.items():
            if start >= following:
                open_[start] = open_.get(start, 0) + n
        self.state.update((following, first, json.dumps(open_)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        following, first, held = self.state.get()
        open_ = {int(k): v for k, v in json.loads(held).items()}
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while following + self.width <= now:
            out.append((key[0], pd.Timestamp(following, unit="ms"), open_.pop(following, 0), following == first))
            following += self.width
        self.state.update((following, first, json.dumps(open_)))
        self.handle.registerTimer(following + self.width)
        return iter([pd.DataFrame(out, columns=["source", "started", "n", "baseline"])] if out else [])

    def close(self) -> None:
        pass


def pulls_without_gaps(events: DataFrame, source: str, at: str, lateness: str, minutes: int = 15) -> DataFrame:
    """source, started, n, baseline: each closed window of each source from its first on.  The session has to keep state in STATE_STORE."""
    width = minutes * 60_000
    timed = events.select(F.col(source).cast("string").alias("source"), F.col(at).cast("timestamp").alias("at")).where("at is not null").withWatermark("at", lateness)
    told = timed.withColumn("started_ms", F.floor(F.unix_millis("at") / width).cast("long") * width)
    return told.groupBy("source").transformWithStateInPandas(Pulls(width), OUTPUT, "Append", "EventTime")
