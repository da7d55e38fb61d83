"""Kept tables after several updates, against the same rows worked out at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import eligibility, incremental
from strataline.plans.gate import _FAMILY, _POSTINGS, _postings
from strataline.plans.registry import query
from strataline.session import Scratch
from strataline.sources.tables import table

EVALUATED = "doc_id long, family string, priority string"


def _evaluate(jobs: DataFrame) -> DataFrame:
    rows = jobs.select("doc_id", eligibility.role_family(F.col("title")).alias("family"))
    return rows.withColumn("priority", eligibility.role_priority(F.col("family")))


@query(f"""WITH {_POSTINGS}, f AS (SELECT doc_id, {_FAMILY} AS family FROM (SELECT doc_id, lower(title) AS t FROM p))
SELECT doc_id, family, CASE WHEN family IN ('SOFTWARE_ENGINEERING', 'AI_ML_ENGINEERING') THEN 'PRIMARY' WHEN family IN ('FORWARD_DEPLOYED_ENGINEERING', 'DATA_ENGINEERING', 'DATA_SCIENCE') THEN 'SECONDARY' ELSE 'NONE' END AS priority FROM f""")
def evaluations_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the postings are evaluated first, half of them under other titles; then all, so that some are new and some have changed."""
    path = Scratch(spark, "evaluations").folder("table")
    jobs = _postings(spark, sf_dir).select("doc_id", "title")
    early = jobs.where("doc_id % 3 <> 0").withColumn("title", F.when(F.col("doc_id") % 2 == 0, "Nurse").otherwise(F.col("title")))
    for rows in (early, jobs):
        incremental.bring_up_to_date(rows, path, "doc_id", ["title"], _evaluate, EVALUATED, "1", buckets=8)
    return incremental.evaluations(spark, path, EVALUATED).select("doc_id", "family", "priority")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from states of each day: first without a tenth of the rows, which come late to days that have been summed up."""
    path = Scratch(spark, "days").folder("table")
    events = table(spark, sf_dir, "events")
    states = {"n": F.count("*"), "total": F.sum("value"), "first_at": F.min("ts"), "last_at": F.max("ts"), "seen": F.collect_set("user_id")}  # a day's own users
    for rows in (events.where("event_id % 10 <> 0 or day(ts) > 20"), events):
        incremental.refresh_days(rows, path, "ts", ["event_type"], states)
    every = incremental.merged(spark, path, ["event_type"], {"n": F.sum("n"), "total": F.round(F.sum("total"), 4), "first_at": F.min("first_at"), "last_at": F.max("last_at")})
    users = spark.read.parquet(path).select("event_type", F.explode("seen").alias("u")).groupBy("event_type").agg(F.count_distinct("u").alias("users"))
    return every.join(users, "event_type")
