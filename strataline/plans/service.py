"""Service queries: capacity, sources, coverage, mail, recall."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import lifecycle, service
from strataline.plans.registry import query
from strataline.sources.tables import table

_BOARDS = "SELECT 'x' AS source_type, s_name AS source_account, s_acctbal >= 500 AS enabled, 900 + (s_suppkey % 5) * 900 AS every, CASE WHEN s_suppkey % 7 <> 0 THEN TIMESTAMP '2024-01-20' - to_seconds(s_suppkey * 97) END AS last, CASE WHEN s_suppkey % 14 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-19 18:00' END AS created FROM supplier"
NOW = datetime(2024, 1, 20)


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = F.timestamp_seconds(F.lit(1705708800) - k * 97).cast("timestamp_ntz")
    return table(spark, sf_dir, "supplier").select(F.lit("x").alias("source_type"), F.col("s_name").alias("source_account"), (F.col("s_acctbal") >= 500).alias("enabled"), (900 + (k % 5) * 900).alias("poll_interval_seconds"), F.when(k % 7 != 0, at).alias("last_success_at"), F.when(k % 14 == 0, F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).otherwise(F.lit(datetime(2024, 1, 19, 18)).cast("timestamp_ntz")).alias("created_at"))


@query(f"""WITH b AS ({_BOARDS}), p AS (SELECT count(*) AS reads FROM events WHERE ts >= TIMESTAMP '2024-01-19 23:00' AND ts < TIMESTAMP '2024-01-20')
SELECT count(*) AS boards, count(*) FILTER (epoch(TIMESTAMP '2024-01-20' - last) <= 1.5 * every) AS on_time, round(sum(3600.0::DOUBLE / every), 4) AS asked, max(reads) AS reads, max(reads) >= 0.9 * round(sum(3600.0::DOUBLE / every), 4) AS keeping_up FROM b, p WHERE enabled""")
def capacity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulls = table(spark, sf_dir, "events").groupBy(F.window("ts", "15 minutes")["start"].alias("started_at")).agg(F.count("*").alias("poll_attempts"))
    return service.capacity(_boards(spark, sf_dir), pulls, F.lit(NOW))


@query(f"""SELECT source_account, CASE WHEN NOT enabled THEN 'off' WHEN last IS NULL AND a <= greatest(86400, 3 * every) THEN 'never_read' WHEN a > greatest(86400, 3 * every) THEN 'dark' WHEN a > 1.5 * every THEN 'late' ELSE 'working' END AS status FROM (SELECT *, epoch(TIMESTAMP '2024-01-20' - coalesce(last, created)) AS a FROM ({_BOARDS}))""")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.source_report(_boards(spark, sf_dir), F.lit(NOW)).select("source_account", "status")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR (o_orderkey % 3) < (o_orderkey % 4) OR (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END) IS DISTINCT FROM 'F'""")
def rescore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cond = service.needs_score(F.when(k % 5 != 0, k % 3), k % 4, F.when(k % 7 != 0, F.col("o_orderstatus")), F.lit("F"))
    return table(spark, sf_dir, "orders").where(F.coalesce(cond, F.lit(False))).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 OR md5(o_orderkey::VARCHAR) IS DISTINCT FROM (CASE WHEN o_orderkey % 4 <> 0 THEN md5(o_orderkey::VARCHAR) END) OR (o_orderkey % 10) IS DISTINCT FROM 3""")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    h = F.md5(k.cast("string").cast("binary"))
    return table(spark, sf_dir, "orders").where(lifecycle.is_stale(F.when(k % 6 != 0, F.lit(1)), F.when(k % 4 != 0, h), h, k % 10, F.lit(3))).select("o_orderkey")


@query("""SELECT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) m USING (doc_id) WHERE (d.lang = 'en' AND d.n_chars > 1000) OR m.doc_id IS NOT NULL""")
def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("marked", F.lit(True))
    rows = table(spark, sf_dir, "documents").join(marked, "doc_id", "left")
    status = F.when(F.col("n_chars") > 1000, "PASS").otherwise("REJECT")
    return rows.where(service.shown(F.col("lang") == "en", status, F.col("marked"))).select("doc_id")


@query("""SELECT company, n IS NOT NULL AS reached FROM (SELECT DISTINCT p_brand || ' Industries' AS company, lower(replace(p_brand, '#', ' ')) AS k FROM part) LEFT JOIN (SELECT lower(replace(p_brand, '#', ' ')) AS k, count(*) AS n FROM part WHERE p_partkey % 5 = 0 AND p_size > 45 GROUP BY 1) USING (k)""")
def company_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat("p_brand", F.lit(" Industries")).alias("company")).distinct()
    boards = part.where("p_partkey % 5 = 0 and p_size > 45").select(F.concat("p_brand", F.lit(", Inc.")).alias("board"))
    return service.coverage(names, boards, "company", "board")


_MAIL = "SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN user_id END AS app, CASE WHEN event_id % 4 <> 0 THEN user_id END AS company FROM events"


@query(f"""SELECT v.kind, count(id) AS n, count(app) AS linked, count(id) FILTER (app IS NULL AND company IS NOT NULL) AS company_only, count(id) FILTER (app IS NULL AND company IS NULL) AS unlinked FROM (VALUES ('error'), ('view'), ('offer')) v(kind) LEFT JOIN ({_MAIL}) m ON m.kind = v.kind GROUP BY 1""")
def mail_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    mail = table(spark, sf_dir, "events").select(k.alias("message_id"), F.col("event_type").alias("kind"), F.when(k % 3 == 0, u).alias("application_key"), F.when(k % 4 != 0, u).alias("company"))
    return service.mail_evidence(mail, ["error", "view", "offer"])


@query("""SELECT user_id::VARCHAR AS company, count(*) AS rejections, count(t) AS dated, max(t) AS latest FROM (SELECT user_id, CASE WHEN event_id % 6 <> 0 THEN ts END AS t FROM events WHERE event_type = 'error') GROUP BY 1 ORDER BY latest DESC NULLS LAST, rejections DESC, company LIMIT 10""")
def employer_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("company"), F.col("props").alias("role"), F.when(F.col("event_id") % 6 != 0, F.col("ts")).alias("at"))
    return service.rejections_by_employer(rows, "company", "role", "at").drop("roles")


def _links(rows: DataFrame) -> DataFrame:
    link, company = F.concat(F.lit("https://x.com/"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    base = rows.select(F.col("o_orderkey").alias("key"), company.alias("company"), link.alias("link"), F.lit(None).cast("long").alias("job_id"), F.col("o_orderpriority").alias("title"))
    mail = base.select(F.col("key").alias("message_id"), "company", F.when(F.col("key") % 3 == 0, F.col("link")).alias("link"), "job_id", "title")
    return service.link_messages(mail, base)


@query("""WITH t AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN t.n = 1 THEN t.k END AS application_key, CASE WHEN o_orderkey % 3 = 0 THEN 'link' WHEN t.n = 1 THEN 'title' ELSE 'several' END AS reason FROM orders JOIN t USING (o_custkey, o_orderpriority)""")
def message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(table(spark, sf_dir, "orders"))


@query("""SELECT count(*) AS listed, count(*) FILTER (o = 'board') AS board, count(*) FILTER (o = 'feed') AS feed, count(*) FILTER (o = 'missed') AS missed, count(*) FILTER (o = 'board' AND d >= DATE '2001-07-18') AS timed, count(*) FILTER (o = 'board' AND d >= DATE '2001-07-18' AND o_orderkey % 4 <= 1) AS within_a_day, round(count(*) FILTER (o = 'board')::DOUBLE / count(*), 6) AS recall
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderstatus WHEN 'F' THEN 'board' WHEN 'O' THEN 'feed' ELSE 'missed' END AS o FROM orders)""")
def recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    outcome = F.when(F.col("o_orderstatus") == "F", "board").when(F.col("o_orderstatus") == "O", "feed").otherwise("missed")
    rows = table(spark, sf_dir, "orders").select(outcome.alias("outcome"), day.alias("listed_on"), F.date_add(day, (F.col("o_orderkey") % 4).cast("int")).alias("seen_on"))
    return service.recall_summary(rows, F.lit(date(2001, 8, 1)))


@query("""SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no_price', count(*) FROM orders WHERE o_totalprice IS NULL""")
def data_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer")}
    return service.invariants(tables, {"negative_balance": ("customer", F.col("c_acctbal") < 0), "no_price": ("orders", F.col("o_totalprice").isNull())})
