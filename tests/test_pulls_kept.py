"""Windows without gaps against a full spine, with a restart in the middle."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from strataline.streaming import pulls_kept

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pulls_kept.STATE_STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_empty_windows_are_given_once(rocks, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    parts = [[("a", at(1)), ("a", at(2)), ("b", at(20)), (None, at(5)), ("a", None)], [("a", at(70)), ("b", at(71))], [("a", at(3)), ("a", at(200))], [("b", at(400))]]
    stream = lambda: rocks.readStream.schema("source string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run():
        rows = pulls_kept.pulls_without_gaps(stream(), "source", "at", "10 minutes")
        rows.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    for part in parts:  # the stream ends and starts again after each file
        rocks.createDataFrame(part, "source string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    got = Counter((r.source, r.started, r.n, r.baseline) for r in rocks.read.parquet(f"{tmp_path}/out").collect())
    end = 400 - 10
    counts = Counter((s, m // 15) for s, m in [("a", 1), ("a", 2), ("b", 20), (None, 5), ("a", 70), ("b", 71), ("a", 200), ("b", 400)])
    want = Counter((s, at(15 * w), counts[s, w], w == first) for s, first in (("a", 0), ("b", 1), (None, 0)) for w in range(first, end // 15))
    assert got == want
