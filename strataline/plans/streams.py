"""Queries that run a stream over the landed events to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.plans.registry import query
from strataline.session import Scratch
from strataline.sources.tables import table
from strataline.streaming import pulls, pulls_kept


def _stream(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.options(**options).schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")


def _drained(stream: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    out = scratch.folder(name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder("checkpoint")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS started, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1
HAVING time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulls.quarter_hours(_stream(spark, sf_dir), "ts", "10 minutes", {"n": F.count("*"), "failed": F.count_if(F.col("event_type") == "error")})
    return _drained(rows, "windows", Scratch(spark, "stream")).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("""SELECT 'NEW' AS change, count(DISTINCT user_id) AS n FROM events""")
def stream_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stream")
    stream = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("position"), F.md5(F.concat_ws("|", "event_type", "value")).alias("digest"))
    changes = scratch.folder("changes")
    pulls.snapshot_changes(stream, ["user_id"], "digest", scratch.folder("state"), changes, scratch.folder("checkpoint")).awaitTermination()
    return spark.read.schema("user_id long, change string, batch int").parquet(changes).groupBy("change").agg(F.count("*").alias("n"))


@query()
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, maxFilesPerTrigger="8").withColumn("lane", F.col("user_id")).withColumn("refused", F.col("event_type") == "error")
    return _drained(pulls.refusal_breaker(events, "lane", "ts", "refused", most=2, within_s=3600), "breaker", Scratch(spark, "stream"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, count(DISTINCT user_id) AS boards, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1
HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pulls.activity(_stream(spark, sf_dir), "ts", "10 minutes", "user_id", F.col("event_type") == "error")
    return _drained(rows, "activity", Scratch(spark, "stream")).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT event_type AS source, time_bucket(INTERVAL 15 MINUTE, ts) AS started FROM events WHERE event_id % 7 < 2),
f AS (SELECT source, min(started) AS first FROM e GROUP BY 1), last AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_id % 7 < 2),
spine AS (SELECT source, first, unnest(generate_series(first, (SELECT mark FROM last), INTERVAL 15 MINUTE)) AS started FROM f)
SELECT s.source, s.started, count(e.started) AS n, s.started = s.first AS baseline FROM spine s LEFT JOIN e ON e.source = s.source AND e.started = s.started
WHERE s.started + INTERVAL 15 MINUTE <= (SELECT mark FROM last) GROUP BY s.source, s.started, s.first""")
def stream_pulls_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter of an hour of each kind of two sevenths of the events, so that many are empty."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, pulls_kept.STATE_STORE)
    try:
        rows = pulls_kept.pulls_without_gaps(_stream(spark, sf_dir).where("event_id % 7 < 2"), "event_type", "ts", "10 minutes")
        return _drained(rows, "pulls", Scratch(spark, "stream")).withColumn("started", F.col("started").cast("timestamp_ntz"))
    finally:
        spark.conf.set(name, before)
