"""Scalar functions, classification and matching over analogue columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import dates, places, text, urls
from strataline.operators import eligibility, matching, reports, scoring
from strataline.plans.registry import query
from strataline.sources.tables import table

_COMPANY = "p_name || CASE p_partkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Technologies LLC' WHEN 2 THEN ' Global Systems' ELSE '' END"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, ", Inc.").when(k == 1, " Technologies LLC").when(k == 2, " Global Systems").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.concat("p_name", tail).alias("company"))


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SPLIT = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""SELECT p_partkey, lower(trim(c)) AS plain, array_to_string(list_filter({_SPLIT.format('c')}, lambda w: w NOT IN ({_list(text.SUFFIXES)})), ' ') AS key, array_to_string(list_filter({_SPLIT.format('c')}, lambda w: w NOT IN ({_list(text.SUFFIXES)})), '') AS tight FROM (SELECT p_partkey, {_COMPANY} AS c FROM part)""")
def company_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("company")
    return _companies(spark, sf_dir).select("p_partkey", text.plain_key(c).alias("plain"), text.company_key(c).alias("key"), text.company_tight_key(c).alias("tight"))


@query(f"""SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 4 = 2 THEN [array_to_string(w, ' '), array_to_string(w[1:len(w) - 1], ' '), array_to_string(w[1:len(w) - 2], ' ')] ELSE [array_to_string(w, ' ')] END, '|') AS keys
FROM (SELECT p_partkey, list_filter({_SPLIT.format('c')}, lambda w: w NOT IN ({_list(text.LIST_SUFFIXES)})) AS w FROM (SELECT p_partkey, {_COMPANY} AS c FROM part))""")
def company_key_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companies(spark, sf_dir).select("p_partkey", F.array_join(text.company_keys(F.col("company")), "|").alias("keys"))


_TOKENS = f"(SELECT *, list_filter(string_split(p_name, ' '), lambda w: w NOT IN ({_list(text.STOPWORDS)})) AS t FROM part)"


@query(f"""SELECT a.p_partkey, b.p_partkey AS other, round(len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)), 6) AS share FROM {_TOKENS} a JOIN {_TOKENS} b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)) >= 0.5""")
def title_tokens_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a null brand or type equals nothing
    group = F.when(F.col("p_brand").isNotNull() & F.col("p_type").isNotNull(), F.struct("p_brand", "p_type"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), group.alias("c"), text.title_tokens(F.concat("p_name", F.lit(" of the New Grad II"))).alias("t"))
    return matching.overlapping_pairs(rows, 0.5).select(F.col("id").alias("p_partkey"), "other", F.round("share", 6).alias("share"))


@query("""SELECT page_id, replace(replace(replace(lower(url), '://www.', '://'), 'http://', 'https://'), '/en-us/', '/') AS key FROM pages""")
def url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.link_key(F.col("url")).alias("key"))


_PARTS = "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', '') AS h, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages"


@query(f"""WITH k AS (SELECT *, list_transform(list_filter(string_split(q, '&'), lambda x: contains(x, '=') AND NOT ends_with(x, '=')), lambda x: {{'name': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'value': url_decode(replace(regexp_replace(x, '^[^=]*=', ''), '+', ' '))}}) AS a FROM ({_PARTS})),
s AS (SELECT *, list_sort(list_filter(a, lambda x: lower(x.name) NOT IN ({_list(urls.TRACKING)}))) AS c FROM k)
SELECT page_id, h || lower(regexp_replace(p, '/+$', '')) || CASE WHEN len(c) > 0 THEN '?' || array_to_string(list_transform(c, lambda x: lower(x.name) || '=' || x.value), '&') ELSE '' END AS key FROM s""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("key"))


@query(f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(p, '/'), list_transform(list_filter(string_split(q, '&'), lambda x: contains(x, '=') AND NOT ends_with(x, '=')), lambda x: regexp_replace(x, '^[^=]*=', ''))), lambda t: length(t) >= 5 AND regexp_matches(t, '[0-9]')))), '|') AS tokens FROM ({_PARTS})""")
def link_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(urls.tokens(F.col("url"))), "|").alias("tokens"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'greenhouse:' || replace(p_name, ' ', '') WHEN 1 THEN 'workday:' || replace(p_name, ' ', '') END AS board FROM part""")
def ats_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug, k = F.replace(F.col("p_name"), F.lit(" "), F.lit("")), F.col("p_partkey") % 3
    url = F.when(k == 0, F.concat(F.lit("boards.greenhouse.io/"), slug, F.lit("/jobs/1"))).when(k == 1, F.concat(F.lit("https://"), slug, F.lit(".wd1.myworkdayjobs.com/en-US/x"))).otherwise(F.concat(F.lit("https://example.com/"), slug))
    found = urls.hiring_system(url)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(found.isNotNull(), urls.board_key(found["type"], found["account"])).alias("board"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN (CASE WHEN make_date(2001, month(d), least(day(d), 28)) <= DATE '2001-08-01' + 45 THEN make_date(2001, month(d), least(day(d), 28)) ELSE make_date(2000, month(d), least(day(d), 28)) END) ELSE d END AS parsed FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    short = F.concat(F.date_format(d, "MMM"), F.lit(" "), F.least(F.dayofmonth(d), F.lit(28)).cast("string"))
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "MMM d, yyyy")).when(k == 3, short).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(written, date(2001, 8, 1)).alias("parsed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN DATE '2001-08-01' WHEN 1 THEN DATE '2001-07-31' WHEN 2 THEN DATE '2001-08-01' - (1 + o_orderkey % 20)::INTEGER END AS day FROM orders""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(k % 4 == 0, "Posted Today").when(k % 4 == 1, "Posted Yesterday").when(k % 4 == 2, F.concat(F.lit("Posted "), (1 + k % 20).cast("string"), F.lit(" Days Ago"))).otherwise("Posted 30+ Days Ago")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.relative_day(label, F.lit(date(2001, 8, 1))).alias("day"))


@query("""SELECT doc_id, length(trim(text)) >= 400 AS ok FROM documents""")
def verifiable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.verifiable(F.col("text")).alias("ok"))


SKILLS = {"License": "license", "Copyright": "copyright", "The": "the", "Des": "des", "Que": "que", "Und": "und", "Shell": r"shell", "Rights": r"rights reserved"}
_SKILL_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9+#.])(?:{p})($|[^a-z0-9+#])') THEN '{n}' END" for n, p in sorted(SKILLS.items())) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT skill, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 1) AS share FROM (SELECT unnest({_SKILL_LIST}) AS skill FROM documents) WHERE skill NOT IN ('The', 'Que') GROUP BY 1""")
def skills_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.count("*").alias("total"))
    have = F.array(F.lit("The"), F.lit("Que"))
    rows = docs.select(F.explode(F.array_except(scoring.extract_skills(F.col("text"), SKILLS), have)).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("skill", "n", F.bround(100.0 * F.col("n") / F.col("total"), 1).alias("share"))


@query(f"""SELECT doc_id, CASE WHEN length(trim(text)) >= 400 AND len(s) >= 3 THEN round_even(100.0::DOUBLE * (len(list_intersect(s, ['The', 'License'])) + 0.5 * len(list_filter(s, lambda x: x IN ('Des', 'Copyright')))) / len(s), 0)::INTEGER END AS score FROM (SELECT doc_id, text, {_SKILL_LIST} AS s FROM documents)""")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    resume = F.array(F.lit("The"), F.lit("License"))
    related = scoring.related_map([("Des", "The"), ("Copyright", "License"), ("Und", "Que")])
    docs = table(spark, sf_dir, "documents").withColumn("job", scoring.extract_skills(F.col("text"), SKILLS))
    return docs.select("doc_id", scoring.match(F.col("job"), resume, related, text.verifiable(F.col("text")))["score"].alias("score"))


@query("""SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(text) < 400 THEN 'SHORT' END, CASE WHEN lang <> 'en' THEN 'OUTSIDE_US' END, CASE WHEN source IN ('src0', 'src1') THEN 'FEED' END], lambda x: x IS NOT NULL)) AS code FROM documents) GROUP BY 1""")
def reason_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.length("text") < 400, "SHORT"), F.when(F.col("lang") != "en", "OUTSIDE_US"), F.when(F.col("source").isin("src0", "src1"), "FEED")))
    return table(spark, sf_dir, "documents").select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


_RUNS = "string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"


@query(f"""WITH b AS (SELECT item_id, {_RUNS} AS w, least(len({_RUNS}), 6) AS n FROM benchmark), bw AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM b, unnest(range(1, len(w) - n + 2)) t(i)),
d AS (SELECT {_RUNS} AS x FROM documents), dw AS (SELECT DISTINCT n, array_to_string(x[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(x) - n + 2)) t(i) WHERE len(x) >= n),
r AS (SELECT DISTINCT item_id FROM bw JOIN dw USING (n, g) WHERE g <> '')
SELECT count(*) AS listed, count(r.item_id) AS reached, round(count(r.item_id)::DOUBLE / count(*), 6) AS recall FROM b LEFT JOIN r USING (item_id)""")
def recall_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens.alias("x"))
    return matching.window_recall(items, table(spark, sf_dir, "documents").select(tokens.alias("x")), "item_id", "x")


_PRED = "CASE WHEN regexp_matches(text, '!!|###|\\*\\*\\*') THEN 0 ELSE 1 END"


@query(f"""WITH r AS (SELECT quality::VARCHAR AS e, ({_PRED})::VARCHAR AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT category, count(*) FILTER (e = category AND p = category) AS tp, count(*) FILTER (p = category AND e <> category) AS fp, count(*) FILTER (e = category AND p <> category) AS fn FROM (VALUES ('0'), ('1'), ('2')) v(category) CROSS JOIN r GROUP BY 1),
w AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS pr, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS re, (tp + fp)::DOUBLE AS a, (tp + fn)::DOUBLE AS b FROM c)
SELECT category, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall,
round(greatest(0, (pr + 1.96 * 1.96 / (2 * a) - 1.96 * sqrt(pr * (1 - pr) / a + 1.96 * 1.96 / (4 * a * a))) / (1 + 1.96 * 1.96 / a)), 6) AS precision_low, round(least(1, (pr + 1.96 * 1.96 / (2 * a) + 1.96 * sqrt(pr * (1 - pr) / a + 1.96 * 1.96 / (4 * a * a))) / (1 + 1.96 * 1.96 / a)), 6) AS precision_high,
round(greatest(0, (re + 1.96 * 1.96 / (2 * b) - 1.96 * sqrt(re * (1 - re) / b + 1.96 * 1.96 / (4 * b * b))) / (1 + 1.96 * 1.96 / b)), 6) AS recall_low, round(least(1, (re + 1.96 * 1.96 / (2 * b) + 1.96 * sqrt(re * (1 - re) / b + 1.96 * 1.96 / (4 * b * b))) / (1 + 1.96 * 1.96 / b)), 6) AS recall_high FROM w WHERE category <> '2'""")
def confusion_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.col("quality").cast("string").alias("e"), F.when(F.col("text").rlike(r"!!|###|\*\*\*"), "0").otherwise("1").alias("p"))
    return reports.confusion(rows, "e", "p", ["0", "1"])


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query()
def email_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of conversation turns, with the phrases of the rules put into some."""
    phrases = F.array(*[F.lit(x) for x in ("Thank you for applying.", "We regret to inform you.", "If we extend an offer, we call.", "Please schedule your interview soon.", "")])
    body = F.concat_ws(" ", "text", F.element_at(phrases, (F.col("conv_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.message_intent(body).alias("intent"))


def _years(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    tail = F.when(k % 4 == 0, F.concat(F.lit("\nRequirements:\n"), (2 + k % 3).cast("string"), F.lit("-9 years of work experience."))).when(k % 4 == 1, F.lit("\nPreferred qualifications:\nAt least five years of Go programming.")).when(k % 4 == 2, F.lit("\nYou have 3+ years of experience, 8 years of experience preferred.")).otherwise("")
    return docs.select("doc_id", eligibility.required_years(F.concat(F.coalesce("text", F.lit("")), tail)).alias("years"))


@query()
def experience_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(table(spark, sf_dir, "documents"))


#: Places of every kind, those that one rule takes from another among them.
_PLACES = ("US/Canada", "Austin TX", "Ottawa, ON, CA", "Remote", "Springfield, IL", "London, England", "Springfield", "New Mexico", "Mexico City, Mexico", "Pune, IND", "worldwide ", "Remote - US", "Toronto ON CA", "Vaughan, Ontario, CA", "Ontario, CA", "San Jose, Costa Rica", "Belarus", "", "Latin America", "North America", "Remote, Canada; Remote, United States", "Menlo Park CA + 3 more", "US-CA-Menlo Park", "Distributed team", "Boise")
_AT = "lower(trim(p))"


@query(rf"""WITH t AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in _PLACES)}][p_partkey % {len(_PLACES)} + 1] AS p FROM part)
SELECT p_partkey, CASE WHEN {_AT} = '' THEN 'UNKNOWN' WHEN regexp_matches({_AT}, '\bunited states\b|\busa\b|\bremote\s*[-,(/]?\s*us\b|(^|[^a-z-])us\s*/\s*canada\b') THEN 'US'
WHEN regexp_matches(p, ',\s*(IND|CAN|GBR)$') OR regexp_matches({_AT}, '\b(canada|england|costa rica)\b') OR (regexp_matches({_AT}, '\bmexico\b') AND NOT regexp_matches({_AT}, 'new mexico')) OR regexp_matches({_AT}, ',\s*(on|ontario)\s*,\s*ca\b') THEN 'NON_US'
WHEN regexp_matches({_AT}, '\bnorth america\b|(^|[^a-z])us([^a-z]|$)|\b(new mexico|illinois)\b|(^|[^a-z])(san jose|menlo park|austin|boise)([^a-z]|$)') OR regexp_matches(p, ',\s*(CA|IL|TX)\b') THEN 'US'
WHEN regexp_matches({_AT}, '^(remote|worldwide|anywhere|distributed( team)?)$') THEN 'ANYWHERE' ELSE 'UNKNOWN' END AS kind FROM t""")
def place_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("p_partkey") % len(_PLACES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", places.kind_of_place(place).alias("kind"))


@query()
def resume_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a column of its own, so that it is computed once
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", scoring.extract_skills(F.col("text"), SKILLS).alias("own"))
    own = F.col("own")
    job = F.array(F.lit("License"), F.lit("Que"), F.lit("The"), F.lit("Und"))
    a = scoring.assessment(F.col("text"), own, F.col("text"), job, scoring.related_map([("Des", "The"), ("Und", "Que")]), F.slice(own, 1, 1))
    return docs.select("doc_id", a["state"].alias("state"), a["score"].alias("score"), a["confidence"].alias("confidence"))


@query("""SELECT p_partkey AS row_number, CASE WHEN p_partkey % 3 = 0 THEN 'unusable' ELSE 'matched' END AS status, CASE WHEN p_partkey % 3 <> 0 THEN 'url' END AS method, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS job_id FROM part""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    link = lambda tail: F.concat(F.lit("https://www.example.com/jobs/"), F.col("p_partkey").cast("string"), F.lit(tail))
    stored = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), link("").alias("official_url"), F.col("p_type").alias("location"), F.lit(False).alias("is_applied"))
    rows = part.select(F.col("p_partkey").alias("row_number"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("company"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 != 0, link("/?utm_source=x&ref=y")).alias("url"), F.lit("").alias("location"))
    return matching.resolve(rows, stored).select("row_number", "status", "method", "job_id")


@query("""SELECT c_custkey, CASE lower(trim(c_mktsegment)) WHEN 'automobile' THEN 'BIG_TECH' WHEN 'building' THEN 'TOP_TIER' WHEN 'machinery' THEN 'TOP_TIER' ELSE 'OTHER' END AS tier FROM customer""")
def company_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = {"BIG_TECH": ("automobile",), "TOP_TIER": ("building", "machinery")}
    return table(spark, sf_dir, "customer").select("c_custkey", text.tier(F.col("c_mktsegment"), tiers).alias("tier"))


def _states(rows: DataFrame) -> DataFrame:
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    return rows.select("event_id", F.window("ts", "15 minutes")["start"].alias("bucket"), dates.pull_state(F.col("ts"), now).alias("state"))


@query("""SELECT event_id, date_trunc('hour', ts) + to_minutes((minute(ts) // 15 * 15)::INTEGER) AS bucket, CASE WHEN ts >= TIMESTAMP '2024-01-30' - INTERVAL 15 MINUTE THEN 'live' WHEN ts >= TIMESTAMP '2024-01-30' - INTERVAL 45 MINUTE THEN 'delayed' WHEN ts IS NULL THEN 'unknown' ELSE 'stalled' END AS state FROM events""")
def pull_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(table(spark, sf_dir, "events"))
