"""Queries of the owner's desk over analogue columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.operators import desk
from strataline.plans.registry import query
from strataline.sources.tables import table

NOW = datetime(2024, 1, 20)


@query("""SELECT o_orderpriority AS "by", NULL AS value, 0 AS n, 0 AS polling FROM orders WHERE false
UNION ALL SELECT 'state', o_orderstatus, count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY 2
UNION ALL SELECT 'origin', o_orderpriority, count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY 2""")
def lead_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("origin"))
    return desk.lead_counts(leads, "F")


_ALERTS = "SELECT p_partkey, p_size > 25 AS is_new_grad, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS score, p_partkey % 2 = 0 AS requirements_verified, p_brand AS company FROM part"


@query(f"""SELECT p_partkey, row_number() OVER (ORDER BY is_new_grad DESC, score DESC NULLS LAST, requirements_verified DESC, company, p_partkey) AS place FROM ({_ALERTS}) ORDER BY place LIMIT 50""")
def alert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty roles that an alert names first."""
    k = F.col("p_partkey")
    roles = table(spark, sf_dir, "part").select(k, (F.col("p_size") > 25).alias("is_new_grad"), F.when(k % 7 != 0, F.col("p_retailprice")).alias("score"), (k % 2 == 0).alias("requirements_verified"), F.col("p_brand").alias("company"))
    first = roles.orderBy(*desk.alert_order(), "p_partkey").limit(50)
    return first.select("p_partkey", F.row_number().over(Window.orderBy(*desk.alert_order(), "p_partkey")).cast("long").alias("place"))  # at most fifty rows


_DUE = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'workday' ELSE 'lever' END AS kind, 900 + (s_suppkey % 4) * 900 AS every, TIMESTAMP '2024-01-20 06:00' - to_seconds(s_suppkey * 397 % 50000) AS due_at, s_suppkey % 11 = 0 AS busy FROM supplier"


@query(f"""SELECT s_suppkey, kind = 'workday' AND every > 900 AND epoch(TIMESTAMP '2024-01-20' - due_at) < 21600 AS later FROM ({_DUE}) WHERE NOT busy AND due_at <= TIMESTAMP '2024-01-20'""")
def due_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = F.timestamp_seconds(F.lit(1705730400) - k * 397 % 50000).cast("timestamp_ntz")
    boards = table(spark, sf_dir, "supplier").select(k, F.when(k % 3 == 0, "workday").otherwise("lever").alias("source_type"), (900 + k % 4 * 900).alias("poll_interval_seconds"), at.alias("due_at"), (k % 11 == 0).alias("in_flight"), k.alias("position"))
    return desk.due(boards, F.lit(NOW).cast("timestamp_ntz")).select("s_suppkey", "later")


@query("""SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name NOT IN (SELECT c_name FROM customer WHERE c_acctbal < 0)""")
def verified_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    reports = table(spark, sf_dir, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.year("o_orderdate").alias("period"), (F.col("o_orderkey") % 3 != 0).alias("entity_verified"))
    names = customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_name").alias("company"))
    boards = customer.select(F.col("c_name").alias("company_name"), "c_acctbal")
    return desk.verified_reports(names, reports, boards, F.col("c_acctbal") < 0).select("id")


_UNLINKED, _UNCLEAR, _LINK = "no link", "not clear", ("which role",)
_MAIL = f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'rejection' WHEN 'view' THEN 'interview' ELSE 'unclear' END AS kind, CASE event_id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'automatic' ELSE 'update' END AS decision, CASE WHEN event_id % 3 = 0 THEN user_id END AS app,
CASE event_id % 7 WHEN 0 THEN '{desk.COMPANY_REASON}' WHEN 1 THEN '{_UNLINKED}' WHEN 2 THEN '{desk.REJECTION_PREFIX}x' WHEN 3 THEN '{desk.ACTION_PREFIX}y' WHEN 4 THEN '{_UNCLEAR}' WHEN 5 THEN '{_LINK[0]}' END AS reason FROM events"""


@query(f"""WITH m AS ({_MAIL}), d AS (SELECT *, CASE WHEN decision = 'update' AND kind = 'rejection' AND reason = '{desk.COMPANY_REASON}' THEN 'company_rejection' WHEN decision = 'update' AND kind = 'rejection' AND reason = '{_UNLINKED}' THEN 'unlinked'
WHEN decision = 'update' AND app IS NULL AND kind = 'rejection' AND starts_with(reason, '{desk.REJECTION_PREFIX}') THEN 'classified_rejection' WHEN decision = 'update' AND app IS NULL AND kind = 'interview' AND starts_with(reason, '{desk.ACTION_PREFIX}') THEN 'classified_action'
WHEN decision = 'review' AND kind = 'unclear' AND reason = '{_UNCLEAR}' THEN 'update' ELSE decision END AS shown FROM m)
SELECT event_id, shown, CASE WHEN shown LIKE 'classified%' THEN shown WHEN shown = 'company_rejection' THEN 'company_recorded' WHEN shown = 'automatic' THEN 'recorded' WHEN shown = 'update' THEN 'filed' WHEN shown = 'unlinked' THEN 'unlinked_outcome' WHEN app IS NULL AND reason = '{_LINK[0]}' THEN 'awaiting_link' ELSE 'owner_review' END AS tray FROM d""")
def mail_trays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    reasons = F.array(*map(F.lit, (desk.COMPANY_REASON, _UNLINKED, desk.REJECTION_PREFIX + "x", desk.ACTION_PREFIX + "y", _UNCLEAR, _LINK[0])))
    mail = table(spark, sf_dir, "events").select(
        k,
        F.when(kind == "error", "rejection").when(kind == "view", "interview").otherwise("unclear").alias("classification"),
        F.when(k % 5 == 0, "review").when(k % 5 == 1, "automatic").otherwise("update").alias("decision"),
        F.when(k % 3 == 0, F.col("user_id")).alias("selected_application_key"),
        F.get(reasons, (k % 7).cast("int")).alias("decision_reason"),
    )
    shown = mail.withColumn("shown", desk.mail_decision(_UNLINKED, _UNCLEAR))
    return shown.select("event_id", "shown", desk.workflow(F.col("shown"), _LINK).alias("tray"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND ts >= (SELECT min(ts) FROM events WHERE event_type = 'signup') THEN 99 WHEN event_id % 4 <> 0 THEN user_id END AS session_id FROM events""")
def claimed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    jobs = events.select("event_id", F.col("ts").alias("first_seen_at"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("session_id"))
    pulls = events.where("event_type = 'signup'").select(F.col("ts").alias("started_at"))
    return desk.claimed(jobs, pulls, F.lit(99).cast("long")).select("event_id", "session_id")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'name' WHEN n >= 3 AND t >= 0.2 * n THEN 'template' END AS agency FROM supplier JOIN (SELECT l_suppkey, count(*) FILTER (l_linenumber > 1) AS n, count(*) FILTER (l_linenumber > 1 AND l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 20) AS t FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def agency_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards by the wording of their postings, which stands in for the lines' flags."""
    boards = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("board"), F.concat(F.lit("Acme"), F.when(F.col("s_suppkey") % 10 == 0, " Staffing").otherwise("")).alias("company_name"))
    wording = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 20), "Duration: 6 months, end client. ").otherwise("We build things. ")
    postings = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("board"), F.when(F.col("l_linenumber") > 1, F.repeat(wording, 20)).otherwise("short").alias("description"))
    held = postings.select("board").distinct()
    return desk.agencies(boards.join(held, "board", "left_semi"), postings).select("s_suppkey", "agency")
