"""Reader and sink queries: payloads are made from the tables, read back and compared."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.plans.registry import query
from strataline.session import Scratch
from strataline.plans.gate import PLACES, TITLES, _list, _pick
from strataline.sources import boards, readers, sinks
from strataline.sources.tables import table


#: Postings of a page, about.
PAGE = 100


@query("""SELECT 'greenhouse' AS source, c_name AS company, o_orderkey::VARCHAR AS external_id, o_orderpriority AS title, n_name AS location, o_orderstatus || ' &' AS description, o_orderdate AS posted_at FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def read_greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    job = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.struct(F.col("n_name").alias("name")).alias("location"), F.concat(F.lit("&lt;p&gt;"), "o_orderstatus", F.lit(" &amp;amp; &amp;lt;b&amp;gt;&lt;/p&gt;")).alias("content"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("first_published"))
    # a company's board comes in pages, as boards page their lists, so a page is of one size whatever the company's
    sizes = rows.groupBy("c_name").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    page = F.pmod(F.xxhash64("o_orderkey"), "pages")
    paged = rows.join(sizes, "c_name").select(F.col("c_name").alias("company"), page.alias("page"), job.alias("job"))
    payloads = paged.groupBy("company", "page").agg(F.to_json(F.struct(F.collect_list("job").alias("jobs"))).alias("payload"))
    out = readers.read_json(payloads, "greenhouse")
    return out.select("source", "company", "external_id", "title", "location", "description", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("""SELECT 'lever' AS source, s_name AS company, s_suppkey::VARCHAR AS external_id, 'Engineer ' || s_suppkey AS title, 'A; B' AS location, 'x' || chr(10) || 'h' || chr(10) || 'c' || chr(10) || 'y' AS description FROM supplier""")
def read_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("Engineer "), "s_suppkey").alias("text"), F.struct(F.array(F.lit("A"), F.lit("B")).alias("allLocations")).alias("categories"), F.lit("x").alias("descriptionPlain"), F.lit("y").alias("additionalPlain"), F.array(F.struct(F.lit("h").alias("text"), F.lit("c").alias("content"))).alias("lists"))
    payloads = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company"), F.to_json(F.array(listed)).alias("payload"))
    return readers.read_json(payloads, "lever").select("source", "company", "external_id", "title", "location", "description")


@query()
def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.functions import text

    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


@query("""SELECT p_brand AS company, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-03-10' - (p_partkey % 9)::INTEGER ELSE DATE '2023-11-12' END AS listed_on, count(*) AS n FROM part WHERE p_partkey % 10 <> 3 GROUP BY ALL""")
def read_markdown_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    age = F.when(k % 2 == 0, F.concat((k % 9).cast("string"), F.lit("d"))).otherwise("Nov 12")
    first = F.concat(F.lit("| **"), "p_brand", F.lit("** | "), "p_name", F.lit(" | NYC | "), F.when(k % 10 == 3, "🔒").otherwise(F.concat(F.lit("[Apply](https://example.com/"), k.cast("string"), F.lit(")"))), F.lit(" | "), age, F.lit(" |"))
    again = F.regexp_replace(first, r"^\| \*\*[^*]*\*\*", "| ↳")
    body = F.concat(F.lit("| Company | Role | Location | Link | Age |\n| --- | --- | --- | --- | --- |\n"), first, F.lit("\n"), again)
    lists = table(spark, sf_dir, "part").select(k.alias("list_key"), body.alias("markdown"))
    roles = readers.markdown_roles(lists, date(2024, 3, 10))
    half = roles.groupBy("company", "title", "listed_on").agg(F.count("*").alias("n"))
    return half.select("company", "title", "listed_on", (F.col("n") / 2).cast("long").alias("n"))


@query("""SELECT c_name AS company, 'Role ' || (c_custkey % 7) AS title, CASE WHEN c_custkey % 5 <> 0 THEN DATE '2024-01-01' + (c_custkey % 28)::INTEGER END AS applied_at, CASE c_custkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'interviewing' END AS status FROM customer""")
def read_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    sheet = table(spark, sf_dir, "customer").select(F.col("c_name").alias("Company"), F.concat(F.lit("Role "), (k % 7).cast("string")).alias("Job Title"), F.when(k % 5 != 0, F.date_format(F.date_add(F.lit(date(2024, 1, 1)), (k % 28).cast("int")), "MM/dd/yyyy")).alias("Date Applied"), F.when(k % 3 == 0, "Rejected").when(k % 3 == 1, "Interview - round 2").otherwise("hm").alias("Status"))
    path = Scratch(spark, "sheet").folder("csv")
    sheet.write.csv(path, header=True)
    return readers.read_sheet(spark, path, date(2024, 3, 1)).select("company", "title", "applied_at", "status")


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-12-31'""")
def export_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    path = Scratch(spark, "bundle").folder("out")
    orders = table(spark, sf_dir, "orders")
    sinks.export_bundle({"orders": (orders, F.col("o_orderdate"))}, datetime(1999, 1, 1), datetime(1999, 12, 31), path)
    return spark.read.schema("o_orderkey long, o_custkey long").json(f"{path}/orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT count(*) AS n, count(DISTINCT md5(o_custkey::VARCHAR)) AS keys FROM orders""")
def export_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "inventory").folder("out")
    sinks.export_inventory(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey").cast("string"), path)
    return spark.read.text(path).agg(F.count("*").alias("n"), F.count_distinct(F.split_part("value", F.lit("|"), F.lit(2))).alias("keys"))


_TITLE, _PLACE = f"{_list(TITLES)}[page_id % {len(TITLES)} + 1]", f"{_list(PLACES)}[page_id % {len(PLACES)} + 1]"


@query(f"""SELECT 'board ' || (page_id % 7) AS board, page_id::VARCHAR AS external_id, {_TITLE} AS title, url AS description FROM pages
WHERE NOT contains({_TITLE}, 'Senior') AND NOT contains({_TITLE}, 'Intern') AND {_PLACE} IN ('Seattle, WA', 'New York') AND page_id % 7 <> 3""")
def boards_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed boards whose titles and places are filtered in the scan, before details are opened."""
    k = F.col("page_id")
    path = Scratch(spark, "boards").folder("landed")
    postings = table(spark, sf_dir, "pages").select(F.concat(F.lit("board "), (k % 7).cast("string")).alias("board"), k.alias("external_id"), _pick(TITLES, k).alias("title"), _pick(PLACES, k).alias("location"), "url", F.col("url").alias("description"))
    boards.land(postings, path)
    title = F.col("title")
    kept = boards.read_boards(spark, path).where(~title.contains("Senior") & ~title.contains("Intern") & F.col("location").isin("Seattle, WA", "New York") & (F.col("board") != "board 3"))
    return kept.select("board", "external_id", "title", "description")
