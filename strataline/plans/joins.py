"""Join, set and window queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions import text, urls
from strataline.operators import lifecycle, matching, reports
from strataline.plans.registry import query
from strataline.sources.tables import table


@query("""SELECT doc_id FROM documents d WHERE source = 'src0' AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source <> 'src0' AND o.lang = d.lang AND lower(trim(o.text)) = lower(trim(d.text)))""")
def dedupe_anti_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("key", F.sha2(text.plain_key(F.col("text")), 256))
    feed, direct = docs.where("source = 'src0'"), docs.where("source <> 'src0'")
    return matching.hide_copies(feed, direct, [(F.col("lang"), F.col("lang")), (F.col("key"), F.col("key"))]).select("doc_id")


_LINK = "replace(replace(replace(lower(url), '://www.', '://'), 'http://', 'https://'), '/en-us/', '/')"


@query(f"""WITH p AS (SELECT page_id, {_LINK} AS k FROM pages) SELECT page_id FROM p WHERE page_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM p o WHERE o.page_id % 3 <> 0 AND o.k = p.k)""")
def dedupe_anti_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.link_key(F.col("url")).alias("k"))
    return matching.hide_copies(pages.where("page_id % 3 = 0"), pages.where("page_id % 3 <> 0"), [(F.col("k"), F.col("k"))]).select("page_id")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_name LIKE '%7' AND s_acctbal < 5000) AND l_quantity >= 45""")
def anti_like_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = table(spark, sf_dir, "supplier").where(F.col("s_name").like("%7") & (F.col("s_acctbal") < 5000))
    rows = table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    return rows.join(blocked, rows.l_suppkey == blocked.s_suppkey, "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)""")
def semi_theta_first_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(items, (orders.o_orderkey == items.l_orderkey) & (items.l_shipdate > orders.o_orderdate), "left_semi").select("o_orderkey", "o_orderdate")


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderpriority = '5-LOW'), d AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
pairs AS (SELECT DISTINCT d.o_orderkey AS id, f.o_orderkey AS fid FROM d JOIN f ON (d.o_custkey = f.o_custkey AND d.o_orderstatus = f.o_orderstatus) OR (d.o_orderdate = f.o_orderdate AND d.o_orderstatus = f.o_orderstatus)),
m AS (SELECT id, min(o_orderdate) AS first_feed FROM pairs JOIN orders ON o_orderkey = fid GROUP BY id)
SELECT id, date_diff('day', first_feed, o_orderdate) AS lag_days, CASE WHEN date_diff('day', first_feed, o_orderdate) > 1000 THEN 'board added later' WHEN date_diff('day', first_feed, o_orderdate) > 365 THEN 'republished' ELSE 'seen late' END AS cause
FROM m JOIN orders ON o_orderkey = id WHERE o_orderdate > first_feed + INTERVAL 14 DAY""")
def or_join_split_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    feed, direct = orders.where("o_orderpriority = '5-LOW'"), orders.where("o_orderpriority = '1-URGENT'")
    first = matching.first_of_either(direct, feed, [[("o_custkey", "o_custkey"), ("o_orderstatus", "o_orderstatus")], [("o_orderdate", "o_orderdate"), ("o_orderstatus", "o_orderstatus")]], "o_orderkey", "o_orderdate").withColumnRenamed("first", "first_feed")
    late = first.join(direct, F.col("left_id") == F.col("o_orderkey")).where(F.col("o_orderdate") > F.col("first_feed") + F.expr("interval 14 days"))
    lag = F.datediff("o_orderdate", "first_feed").cast("long")
    return late.select(F.col("left_id").alias("id"), lag.alias("lag_days"), F.when(lag > 1000, "board added later").when(lag > 365, "republished").otherwise("seen late").alias("cause"))


@query("""WITH f AS (SELECT * FROM documents WHERE source = 'src1'), d AS (SELECT * FROM documents WHERE source NOT IN ('src1', 'src2'))
SELECT count(*) AS feed_only, count(DISTINCT lang) AS langs FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.text = f.text) AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = f.lang AND d.n_chars = f.n_chars)""")
def feed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", F.sha2("text", 256).alias("k"))
    feed, direct = docs.where("source = 'src1'"), docs.where("source not in ('src1', 'src2')")
    left = matching.hide_copies(feed, direct, [(F.col("k"), F.col("k"))])
    left = matching.hide_copies(left, direct, [(F.col("lang"), F.col("lang")), (F.col("n_chars"), F.col("n_chars"))])
    return left.agg(F.count("*").alias("feed_only"), F.count_distinct("lang").alias("langs"))


@query("""SELECT s_suppkey, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 620 THEN 900 WHEN coalesce(n, 0) >= 580 THEN 1800 ELSE 3600 END AS target
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity > 10 GROUP BY 1) ON l_suppkey = s_suppkey""")
def agg_then_left_join_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R' or l_quantity > 10").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("s_suppkey", "n", F.when(F.col("n") >= 620, 900).when(F.col("n") >= 580, 1800).otherwise(3600).alias("target"))


@query("""SELECT d.doc_id, CASE WHEN length(trim(text)) < 400 THEN 'no_description' ELSE 'pending' END AS state FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unscored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return rows.select("doc_id", F.when(~text.verifiable(F.col("text")), "no_description").otherwise("pending").alias("state"))


@query("""WITH k AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderdate AS applied, CASE WHEN o_orderkey % 11 = 0 THEN 'usa' ELSE lower(o_orderstatus) END AS place FROM orders)
SELECT a.id, count(*) AS n_before, max(b.applied) AS last_applied FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.id <> b.id AND (a.place = b.place OR a.place = 'usa' OR b.place = 'usa') GROUP BY 1""")
def applied_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("o_orderkey") % 11 == 0, "usa").otherwise(F.lower("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").withColumn("o_orderkey", F.col("id"))
    return matching.applied_before(rows, [F.col("o_custkey"), F.col("o_orderpriority")], "id", place, "o_orderdate", ("usa",))


@query("""SELECT count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL) AS shared, count(*) FILTER (b.o_orderkey IS NULL) AS left_only, count(*) FILTER (a.o_orderkey IS NULL) AS right_only
FROM (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') b ON a.o_orderkey = b.o_orderkey""")
def inventory_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return matching.inventory(orders.where(F.col("o_orderdate") < F.lit(datetime(1999, 1, 1))), orders.where(F.col("o_orderdate") >= F.lit(datetime(1997, 1, 1))), ["o_orderkey"])


def _key_diff(orders: DataFrame) -> DataFrame:
    key = lambda status: F.concat_ws(":", status, F.col("o_custkey").cast("string"))
    a = orders.select("o_orderkey", key(F.col("o_orderstatus")).alias("ka"))
    b = orders.select("o_orderkey", key(F.when(F.col("o_orderkey") % 26 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("kb"))
    return a.join(b, "o_orderkey", "full_outer").where(~F.col("ka").eqNullSafe(F.col("kb"))).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus || ':' || o_custkey) <> (CASE WHEN o_orderkey % 26 = 0 THEN 'X' ELSE o_orderstatus END || ':' || o_custkey)""")
def inventory_same_key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_diff(table(spark, sf_dir, "orders"))


@query("""SELECT user_id, event_id, value, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3""")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc_nulls_last("value"), F.desc("ts"), F.desc("event_id")]
    return reports.top_per_group(table(spark, sf_dir, "events"), ["user_id"], order, 3).select("user_id", "event_id", "value", F.col("place").cast("long").alias("place"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order, max(o_orderdate) AS latest_date FROM orders GROUP BY 1""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last.alias("latest_order"), F.max("o_orderdate").alias("latest_date"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS carried FROM conversations""")
def carry_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("role") == "user", F.length("text").cast("long"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(own, ignorenulls=True).over(w).alias("carried"))


@query("""SELECT event_id, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events""")
def previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("previous"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT user_id, max(day) FILTER (day < DATE '2024-01-15') AS prev_day, min(day) FILTER (day >= DATE '2024-01-16') AS next_day FROM d GROUP BY 1""")
def prev_next_active_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("ts")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(d < F.lit("2024-01-15").cast("date"), d)).alias("prev_day"), F.min(F.when(d >= F.lit("2024-01-16").cast("date"), d)).alias("next_day"))


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("""SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem""")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").subtract(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' UNION SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'""")
def union_changed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(datetime(2001, 1, 1))).select(F.col("o_orderkey").alias("id"))
    b = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit(datetime(2001, 6, 1))).select(F.col("l_orderkey").alias("id"))
    return a.union(b).distinct()


@query("""SELECT c_custkey, len(list_intersect(f, u)) AS both_n, len(f) - len(list_intersect(f, u)) AS only_f FROM (
SELECT o_custkey AS c_custkey, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F')) AS f, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O')) AS u FROM orders GROUP BY 1) WHERE f IS NOT NULL AND u IS NOT NULL""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(of("F").alias("f"), of("O").alias("u")).where("size(f) > 0 and size(u) > 0")
    return rows.select("c_custkey", F.size(F.array_intersect("f", "u")).cast("long").alias("both_n"), F.size(F.array_except("f", "u")).cast("long").alias("only_f"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NEW' WHEN o_orderkey % 7 = 0 THEN 'CLOSED' WHEN o_orderkey % 11 = 0 THEN 'REOPENED' WHEN o_orderkey % 3 = 0 THEN 'UPDATED' ELSE 'UNCHANGED' END AS change
FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0) AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0)""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    digest = lifecycle.content_hash(["o_orderstatus", "o_totalprice"])
    stored = orders.where(k % 5 != 0).withColumn("content_hash", digest).withColumn("is_active", k % 11 != 0)
    incoming = orders.where(k % 7 != 0).withColumn("o_totalprice", F.when(k % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("content_hash", digest)
    return lifecycle.snapshot_diff(stored, incoming, ["o_orderkey"])


@query("""SELECT o_orderkey, false AS is_active FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 = 0""")
def close_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").withColumn("is_active", F.col("o_orderstatus") == "O")
    observed = stored.where("o_orderkey % 4 <> 0")
    return lifecycle.close_missing(stored, observed, ["o_orderkey"], F.current_timestamp()).select("o_orderkey", "is_active")


@query("""SELECT count(*) AS n, count(DISTINCT h) AS distinct_hashes FROM (SELECT sha256(concat_ws('|', o_custkey, o_orderstatus, o_orderpriority)) AS h FROM orders)""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(lifecycle.content_hash(["o_custkey", "o_orderstatus", "o_orderpriority"]).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("h").alias("distinct_hashes"))


@query("""SELECT o_custkey, arg_max(o_orderstatus, (v, i)) AS status, max(v) AS version FROM (
SELECT o_custkey, o_orderstatus, o_orderdate AS v, 0 AS i FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1
UNION ALL SELECT o_custkey, o_orderpriority, o_orderdate, 1 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) GROUP BY 1""")
def newer_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    stored = reports.top_per_group(orders, ["o_custkey"], [F.asc("o_orderkey")], 1).select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("version"))
    incoming = reports.top_per_group(orders, ["o_custkey"], [F.desc("o_orderkey")], 1).select("o_custkey", F.col("o_orderpriority").alias("status"), F.col("o_orderdate").alias("version"))
    return lifecycle.newer_wins(stored, incoming, ["o_custkey"], "version")


@query("""SELECT e.event_id FROM events e WHERE e.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events u WHERE u.event_type = 'error' AND u.event_id - 1 = e.event_id)""")
def undo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("undo_of_id", F.when(F.col("event_type") == "error", F.col("event_id") - 1))
    return lifecycle.without_undone(events, "event_id").select("event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'fresh' WHEN o_orderkey % 8 = 0 THEN 'fresh' WHEN o_orderkey % 5 = 0 THEN 'unknown_age' WHEN o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 10 DAY THEN 'fresh' ELSE 'too_old' END AS freshness FROM orders""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    change = F.when(k % 9 == 0, "REOPENED").when(k % 8 == 0, "NEW").otherwise("UPDATED")
    posted = F.when(k % 5 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", lifecycle.freshness(change, F.lit(False), posted, F.lit(datetime(2001, 8, 1))).alias("freshness"))
