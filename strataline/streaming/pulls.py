"""Streams: quarter-hour pulls, snapshot changes and a refusal breaker.

All take a streaming DataFrame and give one, or a started query; nothing here
knows where a stream comes from or goes to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataline.operators import lifecycle


def quarter_hours(events: DataFrame, at: str, lateness: str, counts: dict[str, Column]) -> DataFrame:
    """started and counts for each closed quarter of an hour; a window is given once, after the watermark has passed it."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", lateness)
    rows = timed.groupBy(F.window("__at", "15 minutes").alias("w")).agg(*[c.alias(n) for n, c in counts.items()])
    return rows.select(F.col("w.start").alias("started"), *counts)


def sliding(events: DataFrame, at: str, lateness: str, width: str, slide: str, counts: dict[str, Column]) -> DataFrame:
    """Counts in overlapping windows."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", lateness)
    rows = timed.groupBy(F.window("__at", width, slide).alias("w")).agg(*[c.alias(n) for n, c in counts.items()])
    return rows.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *counts)


def activity(events: DataFrame, at: str, lateness: str, board: str, failed: Column) -> DataFrame:
    """started, boards (distinct ones; an hour's are its state), attempts, failures for each closed hour."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", lateness)
    rows = timed.groupBy(F.window("__at", "1 hour").alias("w")).agg(F.size(F.collect_set(board)).cast("long").alias("boards"), F.count("*").alias("attempts"), F.count_if(failed).alias("failures"))
    return rows.select(F.col("w.start").alias("started"), "boards", "attempts", "failures")


def snapshot_changes(stream: DataFrame, keys: list[str], digest: str, state_folder: str, changes_folder: str, checkpoint: str) -> StreamingQuery:
    """Runs what has landed: each batch is diffed against the saved state and its changes are appended.

    The state of batch n is written to a folder of its own before it counts,
    so a batch that is run again after a failure reads the same state and
    writes the same changes.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        incoming = lifecycle.last_of(batch, keys, [F.desc("position")]) if "position" in batch.columns else batch.dropDuplicates(keys)
        incoming = incoming.select(*keys, F.col(digest).alias("content_hash"))
        schema = incoming.withColumn("is_active", F.lit(True)).schema
        stored = spark.read.schema(schema).parquet(f"{state_folder}/{n - 1}") if n else spark.createDataFrame([], schema)
        changes = lifecycle.snapshot_diff(stored, incoming, keys, complete=False)
        changes.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{changes_folder}/batch={n}")
        kept = stored.join(incoming.select(*keys), keys, "left_anti")
        kept.unionByName(incoming.withColumn("is_active", F.lit(True))).write.mode("overwrite").parquet(f"{state_folder}/{n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_window_alerts(windows: DataFrame, now: Callable[[], Column], send: Callable[[DataFrame, int], None], checkpoint: str, oldest: str = "12 hours") -> StreamingQuery:
    """Hands each closed window's row to `send` once; windows older than `oldest` are left out."""

    def emit(batch: DataFrame, n: int) -> None:
        send(batch.where(F.col("started") >= now() - F.expr(f"interval {oldest}")), n)

    return windows.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refusal_breaker(events: DataFrame, lane: str, at: str, refused: str, most: int = 3, within_s: int = 300, first_pause_s: int = 600, longest_pause_s: int = 7200) -> DataFrame:
    """lane, paused_at, pause_s, trips: a pause whenever `most` refusals come within `within_s` seconds without an answer.

    Each further trip doubles the pause up to the longest; an answer clears
    the run of refusals and the doubling.  State is one small row for a lane.
    A task holds two numbers for each event of a lane in one batch, so bound a
    batch by the source (maxFilesPerTrigger).
    """
    import numpy as np
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent, trips, until = state.get if state.exists else ("", 0, 0.0)
        times = [float(x) for x in recent.split(",") if x]
        told = [(b["at_s"].to_numpy(np.float64), b["refused"].to_numpy(bool)) for b in batches]
        at_s, no_s = (np.concatenate(x) for x in zip(*told, strict=True))
        order = np.argsort(at_s, kind="stable")
        out = []
        for t, no in zip(at_s[order].tolist(), no_s[order].tolist(), strict=True):
            if not no:
                times, trips = [], 0
                continue
            if t < until:
                continue
            times = [x for x in times if t - x <= within_s] + [t]
            if len(times) >= most:
                pause = min(first_pause_s * 2**trips, longest_pause_s)
                trips, until, times = trips + 1, t + pause, []
                out.append((key[0], t, pause, trips))
        state.update((",".join(map(str, times)), trips, until))
        yield pd.DataFrame(out, columns=["lane", "paused_at", "pause_s", "trips"])

    told = events.select(F.col(lane).cast("string").alias("lane"), F.unix_micros(F.col(at).cast("timestamp")).cast("double").alias("us"), F.coalesce(F.col(refused).cast("boolean"), F.lit(False)).alias("refused"))
    told = told.select("lane", (F.col("us") / 1e6).alias("at_s"), "refused")
    return told.groupBy("lane").applyInPandasWithState(step, "lane string, paused_at double, pause_s long, trips long", "recent string, trips long, until double", "append", "NoTimeout")
