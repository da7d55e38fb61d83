"""Aggregation, time and cohort queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import dates
from strataline.operators import lifecycle, reports
from strataline.plans.registry import query
from strataline.sources.tables import table


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS pulls, count(*) FILTER (event_type = 'error') AS failed, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS bought,
count(nullif(event_type, 'view')) AS told, CASE WHEN count(nullif(user_id % 50, 0)) = 0 THEN NULL ELSE count(*) FILTER (value > 100) END AS large FROM events GROUP BY 1""")
def filtered_agg_window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("pulls"), F.count_if(F.col("event_type") == "error").alias("failed"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("bought"),
        F.count(F.nullif(F.col("event_type"), F.lit("view"))).alias("told"), F.count_if(F.col("value") > 100).alias("l"), F.count_if(F.col("user_id") % 50 != 0).alias("k"))
    return rows.select("day", "pulls", "failed", "bought", "told", F.when(F.col("k") > 0, F.col("l")).alias("large"))


@query("""SELECT c_custkey, count(*) FILTER (o_orderstatus = 'O') AS open_roles, count(*) FILTER (o_orderstatus = 'F') AS applied, max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS newest_open
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0 OR count(*) FILTER (o_orderstatus = 'F') > 0""")
def company_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    open_, done = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    return rows.groupBy("c_custkey").agg(F.count_if(open_).alias("open_roles"), F.count_if(done).alias("applied"), F.max(F.when(open_, F.col("o_orderdate"))).alias("newest_open")).where("open_roles > 0 or applied > 0")


@query("""SELECT lower(c_name) AS k, min(c_name) AS company, count(*) AS readable, count(*) FILTER (o_orderpriority = '1-URGENT') AS refused, round_even(count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE / count(*), 3) AS share
FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 5""")
def refusal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), F.col("c_custkey") == F.col("o_custkey"))
    agg = rows.groupBy(F.lower("c_name").alias("k")).agg(F.min("c_name").alias("company"), F.count("*").alias("readable"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("refused"))
    return agg.where("readable >= 5").withColumn("share", reports.share(F.col("refused"), F.col("readable"), 3))


_BAND = "CASE WHEN o_totalprice >= 350000 THEN 'high' WHEN o_totalprice >= 225000 THEN 'medium' ELSE 'low' END"


def _bands(by: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    p = F.col("o_totalprice")
    return rows.groupBy(by).agg(F.count_if(p >= 350000).alias("high"), F.count_if((p >= 225000) & (p < 350000)).alias("medium"), F.count_if(p < 225000).alias("low"), F.max(p).alias("best"))


@query("SELECT c_mktsegment, count(*) FILTER (o_totalprice >= 350000) AS high, count(*) FILTER (o_totalprice >= 225000 AND o_totalprice < 350000) AS medium, count(*) FILTER (o_totalprice < 225000) AS low, max(o_totalprice) AS best FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def tier_band_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands("c_mktsegment", spark, sf_dir)


@query("SELECT o_orderpriority, count(*) FILTER (o_totalprice >= 350000) AS high, count(*) FILTER (o_totalprice >= 225000 AND o_totalprice < 350000) AS medium, count(*) FILTER (o_totalprice < 225000) AS low, max(o_totalprice) AS best FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def family_band_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands("o_orderpriority", spark, sf_dir)


@query("SELECT c_name, max(o_totalprice) AS best, count(*) AS open_ FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY best DESC, open_ DESC, c_name LIMIT 12")
def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_name").agg(F.max("o_totalprice").alias("best"), F.count("*").alias("open_")).orderBy(F.desc("best"), F.desc("open_"), "c_name").limit(12)


@query("""SELECT status, count(*) AS n, count(*) FILTER (status IN ('F', 'purchase')) AS heard FROM (SELECT o_orderstatus AS status FROM orders UNION ALL SELECT event_type FROM events) GROUP BY 1""")
def union_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")).unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("status")))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("F", "purchase")).alias("heard"))


_D = "SELECT CAST(range AS DATE) AS day FROM range(DATE '1999-01-05', DATE '1999-04-16', INTERVAL 1 DAY)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return reports.day_spine(rows, "day", F.lit(date(1999, 1, 5)), F.lit(date(1999, 4, 15)), {"n": F.count("*"), "urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT")})


_DAYS = f"SELECT d.day, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM ({_D}) d LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d.day GROUP BY 1"


@query(_DAYS)
def date_spine_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir)


@query(f"SELECT greatest(CAST(date_trunc('week', day) AS DATE), DATE '1999-01-05') AS bucket_start, least(CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE), DATE '1999-04-15') AS bucket_end, sum(n)::BIGINT AS n FROM ({_DAYS}) GROUP BY ALL")
def weekly_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.clipped_buckets(_days(spark, sf_dir), "week", F.lit(date(1999, 1, 5)), F.lit(date(1999, 4, 15)), ["n"])


@query(f"SELECT greatest(CAST(date_trunc('month', day) AS DATE), DATE '1999-01-05') AS bucket_start, least(last_day(day), DATE '1999-04-15') AS bucket_end, sum(n)::BIGINT AS n FROM ({_DAYS}) GROUP BY ALL")
def monthly_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.clipped_buckets(_days(spark, sf_dir), "month", F.lit(date(1999, 1, 5)), F.lit(date(1999, 4, 15)), ["n"])


@query("""SELECT user_id % 40 AS grp, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-17 12:00') AS now_n, count(*) FILTER (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-10 12:00') AS prev_n,
CASE WHEN count(*) FILTER (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-10 12:00') <> 0 THEN round_even(100.0::DOUBLE * (count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-17 12:00') - count(*) FILTER (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-10 12:00')) / count(*) FILTER (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-10 12:00'), 2) END AS change FROM events GROUP BY 1""")
def period_over_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    between = lambda a, b: (ts >= F.lit(a)) & (ts < F.lit(b))
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("grp")).agg(F.count_if(between(datetime(2024, 1, 15), datetime(2024, 1, 17, 12))).alias("now_n"), F.count_if(between(datetime(2024, 1, 8), datetime(2024, 1, 10, 12))).alias("prev_n"))
    return rows.withColumn("change", dates.percent_change(F.col("now_n"), F.col("prev_n")))


@query("""SELECT CAST(ts - INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""")
def local_day_counts_la(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(dates.local_day(F.col("ts"), "America/Los_Angeles").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS started, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def events_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("started"), "n", "failed", "total")


@query("""SELECT outcome, count(*) AS windows FROM (SELECT CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'opportunities' WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'new_postings' ELSE 'quiet' END AS outcome FROM events GROUP BY time_bucket(INTERVAL 15 MINUTE, ts)) GROUP BY 1""")
def events_15min_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "15 minutes")).agg(F.count_if(F.col("event_type") == "purchase").alias("q"), F.count_if(F.col("event_type") == "view").alias("d"))
    return rows.groupBy(dates.pull_outcome(F.col("q"), F.col("d")).alias("outcome")).agg(F.count("*").alias("windows"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("started"), "n")


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def schedule_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.percentiles(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def _speed(events: DataFrame) -> DataFrame:
    return reports.percentiles(events, ["user_id"], F.col("value"), {"median": 0.5, "p90": 0.9}, least=20)


@query("""SELECT user_id, count(value) AS n, CASE WHEN count(value) >= 20 THEN round(median(value), 6) END AS median, CASE WHEN count(value) >= 20 THEN round(quantile_cont(value, 0.9), 6) END AS p90 FROM events GROUP BY 1""")
def speed_median_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speed(table(spark, sf_dir, "events"))


@query("""SELECT user_id, event_type, min(t) AS first_at, arg_max(event_id, (CASE WHEN t IS NULL THEN 0 ELSE 1 END, coalesce(t, TIMESTAMP '1900-01-01'), event_id)) AS last_id, count(*) AS n
FROM (SELECT *, CASE WHEN event_id % 10 <> 0 THEN ts END AS t FROM events) GROUP BY 1, 2""")
def cohort_first_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return reports.first_latest(rows, "user_id", "event_type", "t", "event_id").select("user_id", "event_type", "first_at", "last_id", "n")


_POLARITY = """SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'positive' END, (ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)) AS polarity FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1"""


def _polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.polarity(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", "ts")


@query(_POLARITY)
def cohort_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polarity(spark, sf_dir)


_APPS = "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 17 <> 0 THEN TIMESTAMP '2024-02-01' - to_days((c_custkey % 60)::INTEGER) END AS applied_at, c_custkey % 3 = 0 AS withdrawn FROM customer"


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = F.date_add(F.lit(date(2024, 2, 1)), -(k % 60).cast("int")).cast("timestamp_ntz")
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.when(k % 17 != 0, at).alias("applied_at"), (k % 3 == 0).alias("withdrawn"))


@query(f"""WITH a AS ({_APPS}), p AS ({_POLARITY}), j AS (SELECT a.*, polarity, coalesce(applied_at <= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY, false) AS mature FROM a LEFT JOIN p USING (user_id))
SELECT count(*) AS total, count(*) FILTER (applied_at IS NULL) AS undated, count(*) FILTER (mature) AS eligible, count(*) FILTER (mature AND polarity = 'positive') AS positive, count(*) FILTER (mature AND polarity = 'rejected') AS rejected,
count(*) FILTER (mature AND polarity IS NULL AND NOT withdrawn) AS pending, count(*) FILTER (mature AND polarity IS NULL AND withdrawn) AS "unknown" FROM j""")
def cohort_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cohort(_applications(spark, sf_dir), _polarity(spark, sf_dir), "user_id", "applied_at", F.lit(datetime(2024, 2, 1)))


def _lags(spark: SparkSession, sf_dir: str, applications: DataFrame) -> DataFrame:
    first = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first_at"))
    rows = applications.join(first, "user_id").where("first_at >= applied_at")
    lag = F.floor((F.unix_micros(F.col("first_at").cast("timestamp")) - F.unix_micros(F.col("applied_at").cast("timestamp"))) / 86_400_000_000)
    return rows.groupBy(reports.histogram(lag, [(7, "0-7"), (14, "8-14"), (30, "15-30")], "30+").alias("bucket")).agg(F.count("*").alias("n"), F.median(lag).alias("median_lag"))


@query(f"""WITH a AS ({_APPS}), f AS (SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'purchase' GROUP BY 1),
l AS (SELECT floor(epoch(first_at - applied_at) / 86400)::BIGINT AS lag FROM a JOIN f USING (user_id) WHERE first_at >= applied_at)
SELECT CASE WHEN lag <= 7 THEN '0-7' WHEN lag <= 14 THEN '8-14' WHEN lag <= 30 THEN '15-30' ELSE '30+' END AS bucket, count(*) AS n, median(lag) AS median_lag FROM l GROUP BY 1""")
def lag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, _applications(spark, sf_dir))


_REASON = """CASE WHEN EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'error' AND u.event_id - 1 = e.event_id) THEN 'undone' WHEN event_type NOT IN ('purchase', 'signup', 'click') THEN 'not_an_outcome' WHEN user_id % 10 = 0 THEN 'unconfirmed_actor' WHEN ts >= TIMESTAMP '2024-01-28' THEN 'future' WHEN ts < TIMESTAMP '2024-01-03' - INTERVAL 24 HOUR THEN 'before_window' ELSE 'counted' END"""


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM events e) GROUP BY 1")
def cohort_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    undone = events.where("event_type = 'error'").select((F.col("event_id") - 1).alias("event_id"), F.lit(True).alias("undone")).distinct()
    rows = events.join(undone, "event_id", "left")
    reason = F.when(F.col("undone"), "undone").when(~F.col("event_type").isin("purchase", "signup", "click"), "not_an_outcome").when(F.col("user_id") % 10 == 0, "unconfirmed_actor").when(F.col("ts") >= F.lit(datetime(2024, 1, 28)), "future").when(F.col("ts") < F.lit(datetime(2024, 1, 2)), "before_window").otherwise("counted")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT event_id FROM events WHERE props IN (SELECT props FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 25) = 1)""")
def message_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("user_id") % 25)
    return reports.single_target(rows, "props", "t").select("event_id")


@query("""SELECT name, coalesce(n, 0) AS n FROM (VALUES ('never_read'), ('refused'), ('stale'), ('working'), ('off')) v(name) LEFT JOIN (
SELECT CASE WHEN s_acctbal < 0 THEN 'off' WHEN n IS NULL THEN 'never_read' WHEN n < 560 THEN 'stale' ELSE 'working' END AS g, count(*) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey GROUP BY 1) ON g = name""")
def exclusive_groups_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    group = F.when(F.col("s_acctbal") < 0, "off").when(F.col("n").isNull(), "never_read").when(F.col("n") < 560, "stale").otherwise("working")
    return reports.zero_filled(rows, group, ["never_read", "refused", "stale", "working", "off"])


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS status, greatest(0, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01'))::BIGINT AS age_days FROM orders""")
def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(names[F.col("o_orderstatus")], F.lit("pending")).alias("status"), dates.age_days(F.col("o_orderdate"), F.lit(datetime(2000, 1, 1))).alias("age_days"))


@query("""SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS k_high FROM events GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count_if(k >= 50).alias("k_high"))


@query("""SELECT before, after, count(*) AS n FROM (SELECT CASE WHEN o_totalprice >= 250000 THEN 'PASS' ELSE 'REJECT' END AS before, CASE WHEN o_totalprice >= 250000 AND o_orderpriority <> '5-LOW' THEN 'PASS' ELSE 'REJECT' END AS after FROM orders) GROUP BY 1, 2""")
def gate_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("o_totalprice") >= 250000
    rows = table(spark, sf_dir, "orders").select(F.when(high, "PASS").otherwise("REJECT").alias("before"), F.when(high & (F.col("o_orderpriority") != "5-LOW"), "PASS").otherwise("REJECT").alias("after"))
    return rows.groupBy("before", "after").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey % 50 AS org, year(o_orderdate) AS period, o_orderkey AS ver, o_totalprice AS approvals, CASE WHEN o_orderkey % 200 = 0 THEN NULL ELSE o_totalprice / 10 END AS denials FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org, period ORDER BY ver DESC) AS rn FROM r) WHERE rn = 1),
ok AS (SELECT period FROM l GROUP BY 1 HAVING bool_and(denials IS NOT NULL))
SELECT period::INTEGER AS period, round(sum(approvals), 2) AS approvals, round(sum(approvals) / (sum(approvals) + sum(denials)), 6) AS rate FROM l WHERE period IN (SELECT period FROM ok) GROUP BY 1""")
def annual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("org"), F.year("o_orderdate").alias("period"), F.col("o_orderkey").alias("ver"), F.col("o_totalprice").alias("approvals"), F.when(F.col("o_orderkey") % 200 != 0, F.col("o_totalprice") / 10).alias("denials"))
    last = reports.latest_complete(rows, ["org"], "period", [F.desc("ver")], F.col("denials").isNotNull())
    return last.groupBy("period").agg(F.round(F.sum("approvals"), 2).alias("approvals"), F.round(F.sum("approvals") / (F.sum("approvals") + F.sum("denials")), 6).alias("rate"))
