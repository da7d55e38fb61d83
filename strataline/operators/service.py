"""Service reports over boards, pulls, mail and leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import text

#: Lateness factor, share of asked reads that keeps up, least sample, hours of a dark board.
LATE, KEEPS_UP, LEAST_SAMPLE, DARK_HOURS = 1.5, 0.9, 20, 24


def capacity(boards: DataFrame, pulls: DataFrame, now: Column) -> DataFrame:
    """One row: reads in the last four complete quarter hours against what the boards ask for an hour.

    boards: enabled, poll_interval_seconds, last_success_at; pulls: started_at, poll_attempts.
    """
    end = F.window(now.cast("timestamp"), "15 minutes")["start"]
    hour = pulls.select(F.sum(F.when((F.col("started_at").cast("timestamp") < end) & (F.col("started_at").cast("timestamp") >= end - F.expr("interval 1 hour")), F.col("poll_attempts"))).alias("reads"))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_success_at").cast("timestamp"))
    every = F.greatest(F.col("poll_interval_seconds"), F.lit(60))
    asked = boards.where("enabled").agg(F.round(F.sum(3600 / every), 4).alias("asked"), F.count("*").alias("boards"), F.count_if(age <= LATE * every).alias("on_time"))
    both = asked.crossJoin(F.broadcast(hour))  # one row each
    return both.select("boards", "on_time", "asked", F.coalesce("reads", F.lit(0)).alias("reads"), (F.coalesce("reads", F.lit(0)) >= KEEPS_UP * F.col("asked")).alias("keeping_up"))


def source_report(boards: DataFrame, now: Column) -> DataFrame:
    """boards with status (off, never_read, dark, late, working) and the order of the report: worst first, then longest unread, then key."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.coalesce("last_success_at", "created_at").cast("timestamp"))
    dark = F.greatest(F.lit(DARK_HOURS * 3600), 3 * F.col("poll_interval_seconds"))
    status = F.when(~F.col("enabled"), "off").when(F.col("last_success_at").isNull() & (age <= dark), "never_read").when(age > dark, "dark").when(age > LATE * F.col("poll_interval_seconds"), "late").otherwise("working")
    rank = F.create_map(*[F.lit(x) for kv in {"dark": 0, "late": 1, "never_read": 2, "working": 3, "off": 4}.items() for x in kv])
    return boards.withColumn("status", status).withColumn("__r", rank[F.col("status")]).orderBy("__r", F.desc_nulls_last(age), "source_type", "source_account").drop("__r")


def needs_score(scored_at: Column, evaluated_at: Column, version: Column, current: Column) -> Column:
    """No score, or one older than the evaluation or of another version; an unknown version is another one."""
    return scored_at.isNull() | (scored_at < evaluated_at) | ~version.eqNullSafe(current)


def shown(active: Column, status: Column, marked: Column) -> Column:
    return (active & (status == "PASS")) | F.coalesce(marked, F.lit(False))


def coverage(names: DataFrame, boards: DataFrame, name: str, board: str) -> DataFrame:
    """names with reached: whether a board's company shares any of the forms of the name."""
    keys = lambda df, c: df.select("*", F.explode(text.company_keys(F.col(c))).alias("__k"))
    hit = keys(names, name).join(keys(boards, board).select("__k").distinct(), "__k", "left_semi").select(name).distinct().withColumn("__hit", F.lit(True))
    return names.join(hit, name, "left").select(*names.columns, F.coalesce("__hit", F.lit(False)).alias("reached"))


def mail_evidence(messages: DataFrame, kinds: list[str]) -> DataFrame:
    """kind, n, linked, company_only, unlinked for every kind, also those without messages.

    messages: message_id, kind, application_key, company.
    """
    told = messages.dropDuplicates(["message_id"])
    linked, named = F.col("application_key").isNotNull(), F.col("company").isNotNull()
    n = told.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(linked).alias("linked"), F.count_if(~linked & named).alias("company_only"), F.count_if(~linked & ~named).alias("unlinked"))
    all_ = messages.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return all_.join(n, "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "linked", "company_only", "unlinked")])


def rejections_by_employer(events: DataFrame, company: str, role: str, at: str, limit: int = 10) -> DataFrame:
    """company, rejections, dated, roles (each once, in order of time), latest: newest first, undated last."""
    rows = events.groupBy(F.lower(F.trim(company)).alias("k")).agg(
        F.min(company).alias("company"), F.count("*").alias("rejections"), F.count(at).alias("dated"), F.max(at).alias("latest"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).isNull(), F.col(at), F.col(role)))), lambda x: x[role])).alias("roles"))  # fmt: skip  # one employer's rejections
    return rows.drop("k").orderBy(F.desc_nulls_last("latest"), F.desc("rejections"), "company").limit(limit)


def link_messages(messages: DataFrame, applications: DataFrame) -> DataFrame:
    """message_id, application_key, reason: by posting link, job number, exact title or the employer's only application.

    messages: message_id, company, link, job_id, title; applications: key,
    company, link, job_id, title.  Rules go in this order; the first that
    finds one application decides, one that finds several is a conflict.
    """
    m = messages.select("message_id", text.company_tight_key(F.col("company")).alias("c"), "link", "job_id", text.folded(F.col("title")).alias("t"))
    a = applications.select("key", text.company_tight_key(F.col("company")).alias("c"), "link", "job_id", text.folded(F.col("title")).alias("t"))
    by = [("link", ["link"]), ("job_id", ["c", "job_id"]), ("title", ["c", "t"]), ("only_application", ["c"])]
    found = None
    for rank, (reason, keys) in enumerate(by):
        usable = [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]
        left, right = m, a
        for u in usable:
            left, right = left.where(u), right.where(u)
        held = right.groupBy(*keys).agg(F.min("key").alias("key"), F.max("key").alias("last"))  # a row for each value, however many applications have it
        hit = left.select("message_id", *keys).join(held, keys).groupBy("message_id").agg(F.min("key").alias("key"), F.max("last").alias("last"))
        hit = hit.select("message_id", F.lit(rank).alias("rank"), F.lit(reason).alias("reason"), F.when(F.col("key").isNull(), 0).when(F.col("key") == F.col("last"), 1).otherwise(2).alias("n"), "key")
        found = hit if found is None else found.unionByName(hit)
    first = found.groupBy("message_id").agg(F.min(F.struct("rank", "reason", "n", "key")).alias("f"))
    out = messages.select("message_id").join(first, "message_id", "left")
    return out.select("message_id", F.when(F.col("f.n") == 1, F.col("f.key")).alias("application_key"), F.when(F.col("f").isNull(), "no_application").when(F.col("f.n") > 1, "several").otherwise(F.col("f.reason")).alias("reason"))


def recall_summary(results: DataFrame, today: Column) -> DataFrame:
    """One row: listed, board, feed, missed, and of those listed within 14 days the ones seen within a day.

    results: outcome, listed_on, seen_on.
    """
    timed = (F.col("listed_on") >= F.date_sub(today, 14)) & (F.col("outcome") == "board")
    within = timed & (F.col("seen_on") <= F.date_add("listed_on", 1))
    out = results.agg(F.count("*").alias("listed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("board", "feed", "missed")], F.count_if(timed).alias("timed"), F.count_if(within).alias("within_a_day"))
    return out.withColumn("recall", F.round(F.try_divide(F.col("board").cast("double"), F.col("listed").cast("double")), 6))


def invariants(tables: dict[str, DataFrame], checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """name, n: rows of every table, and rows that break each check."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()]
    parts += [tables[t].agg(F.count_if(cond).alias("n")).select(F.lit(k).alias("name"), "n") for k, (t, cond) in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
