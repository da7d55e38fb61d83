"""Listing queries over orders as postings: customer is the company, its segment the tier, the price the score."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import listing
from strataline.operators.listing import Filters, Names
from strataline.plans.registry import query
from strataline.sources.tables import table

NAMES = Names(id="o_orderkey", company="c_name", title="o_orderpriority", location="n_name", status="o_orderstatus", priority="o_orderpriority", tier="c_mktsegment", score="o_totalprice", posted="o_orderdate", seen="o_orderdate")
TIERS = ("AUTOMOBILE", "BUILDING", "FURNITURE")
ASKED = Filters(statuses=("F", "O"), tiers=("AUTOMOBILE", "OTHER"), named_tiers=TIERS, priorities=("1-URGENT", "2-HIGH", "3-MEDIUM"), least_score=100_000.0, sorts=("best_match",), limit=50)

_JOIN = "orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
_TIER = "(c_mktsegment = 'AUTOMOBILE' OR c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE'))"
_REST = f"{_TIER} AND o_totalprice >= 100000.0"
_STATUS = "o_orderstatus IN ('F', 'O')"
_PRIORITY = "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
_ALL = f"{_STATUS} AND {_PRIORITY} AND {_REST}"
_SHOWN = "o_orderkey, c_name, n_name, o_orderstatus, o_orderpriority, c_mktsegment, o_totalprice, o_orderdate"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer and nation; the small dimension is left to the optimizer to broadcast."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey, "left")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN.split(", "))


@query(f"SELECT {_SHOWN} FROM {_JOIN} WHERE {_ALL} ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC LIMIT 50")
def faceted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(listing.page(postings(spark, sf_dir), ASKED, NAMES))


@query(f"SELECT {_SHOWN} FROM {_JOIN} WHERE {_ALL} ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50")
def listing_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    return _shown(listing.page(postings(spark, sf_dir), replace(ASKED, offset=50), NAMES))


@query(f"SELECT count(*) AS total FROM {_JOIN} WHERE {_ALL}")
def listing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.total(postings(spark, sf_dir), ASKED, NAMES)


@query(f"SELECT o_orderstatus AS value, count(*) AS n FROM {_JOIN} WHERE {_PRIORITY} AND {_REST} GROUP BY 1")
def facet_counts_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.facet(postings(spark, sf_dir), ASKED, "o_orderstatus", "statuses", NAMES)


@query(f"SELECT o_orderpriority AS value, count(*) AS n FROM {_JOIN} WHERE {_STATUS} AND {_REST} GROUP BY 1")
def facet_counts_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.facet(postings(spark, sf_dir), ASKED, "o_orderpriority", "priorities", NAMES)


@query(f"SELECT c_mktsegment AS value, count(*) AS n FROM {_JOIN} WHERE {_STATUS} AND {_PRIORITY} AND o_totalprice >= 100000.0 GROUP BY 1")
def facet_counts_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.facet(postings(spark, sf_dir), ASKED, "c_mktsegment", "tiers", NAMES)


@query(f"""SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM {_JOIN} WHERE {_PRIORITY} AND {_REST} GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM {_JOIN} WHERE {_STATUS} AND {_REST} GROUP BY ALL
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM {_JOIN} WHERE {_STATUS} AND {_PRIORITY} AND o_totalprice >= 100000.0 GROUP BY ALL""")
def facets_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.all_facets(postings(spark, sf_dir), ASKED, {"o_orderstatus": "statuses", "o_orderpriority": "priorities", "c_mktsegment": "tiers"}, NAMES)


@query(f"""SELECT {_SHOWN} FROM {_JOIN} WHERE {_STATUS} ORDER BY CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END,
CASE WHEN o_totalprice < 60000 AND o_orderpriority = '1-URGENT' THEN 0 WHEN o_totalprice < 60000 THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC LIMIT 200""")
def sort_case_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.apply(postings(spark, sf_dir), Filters(statuses=("F", "O")), NAMES)
    fit = F.when((F.col("o_totalprice") < 60000) & (F.col("o_orderpriority") == "1-URGENT"), 0).when(F.col("o_totalprice") < 60000, 1).otherwise(2)
    return _shown(rows.orderBy(listing.tier_rank(F.col("c_mktsegment"), TIERS), fit, *listing.sort_columns(("best_match",), NAMES)).limit(200))


@query(f"SELECT {_SHOWN} FROM {_JOIN} WHERE lower(c_name) NOT IN ('customer#000000001', 'customer#000000007') AND o_orderdate > TIMESTAMP '1999-06-01' AND (n_name ILIKE '%nation_1%' OR c_name ILIKE '%nation_1%' OR o_orderpriority ILIKE '%nation_1%')")
def search_and_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Filters(not_companies=(" Customer#000000001 ", "", "CUSTOMER#000000007"), seen_after=datetime(1999, 6, 1), text="nation_1")
    return _shown(listing.apply(postings(spark, sf_dir), f, NAMES))


@query(f"SELECT {_SHOWN} FROM {_JOIN} WHERE contains(lower(n_name), 'nation_2') AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(n_name), 'urgent'))")
def search_every_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = listing.every_word([F.col("n_name"), F.col("o_orderpriority")], "Nation_2 URGENT")
    return _shown(postings(spark, sf_dir).where(words))


@query("""SELECT o_orderkey, years FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 9 END AS years, o_orderpriority = '1-URGENT' AS early FROM orders)
WHERE early OR years < 4""")
def experience_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 9)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", years.alias("years"), (F.col("o_orderpriority") == "1-URGENT").alias("early"))
    return rows.where(listing.in_band(F.col("early"), F.col("years"))).select("o_orderkey", "years")


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open_, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS fresh,
count(*) FILTER (o_totalprice >= 350000) AS high, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS urgent FROM orders""")
def tiles_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return listing.tiles(table(spark, sf_dir, "orders"), {"total": F.lit(True), "open_": status == "O", "fresh": F.col("o_orderdate") >= F.lit(datetime(2001, 1, 1)), "high": price >= 350000, "urgent": (F.col("o_orderpriority") == "1-URGENT") & (status != "F")})


@query("""SELECT count(*) FILTER (s >= 350000) AS high, count(*) FILTER (s >= 225000 AND s < 350000) AS medium, count(*) FILTER (s < 225000) AS low, count(*) FILTER (s IS NULL) AS unscored
FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS s FROM orders)""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("s"))
    return listing.score_bands(rows, "s", 350_000, 225_000)


@query("""SELECT started, n FROM (SELECT date_trunc('hour', ts) AS started, count(*) AS n FROM events GROUP BY 1) WHERE started < TIMESTAMP '2024-01-20' ORDER BY started DESC LIMIT 100""")
def keyset_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("started")).agg(F.count("*").alias("n"))
    return listing.keyset_page(runs, "started", datetime(2024, 1, 20), 100)
