"""Boards, leads, alerts and mail as the owner's desk shows them: orders, counts and CASE projections.

Defined cases, unless a function says otherwise: null columns take the last
branch and come last in an order; empty tables give empty results; further
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import text, urls

#: Patterns of an agency's name and of a contract template, least length of a description, least number of them, share that tells an agency.
AGENCY_NAME = r"(?i)\bstaff(?:ing)?\b|\brecruit|\btalent\b|\bconsult|\binfotech\b|\bit\s+services\b|\bxperts?\b|\bjobs\s+for\b|\bsoftware\s+systems?\b|\bplacement|\bmanpower\b|\bworkforce\b"
CONTRACT = r"(?i)\b(?:duration|rate|client|interview|end\s+client|contract\s+length)\s*:\s|\bc2c\b|\bcorp[\s-]to[\s-]corp\b|\bw-?2\s+(?:only|contract)|\bimplementation\s+partner\b|\b(?:our|direct|end)\s+client\b|\bimmediate\s+need\b"
DESCRIBED, LEAST_DESCRIBED, AGENCY_SHARE = 300, 3, 0.2

#: What starts the reason of mail that was filed without an application, and the kinds of mail that ask for an action.
REJECTION_PREFIX = "Classified rejection evidence; no application was changed. "
ACTION_PREFIX = "Classified hiring action; no application was changed. "
COMPANY_REASON = "Company rejection recorded; the email does not need a role-level application match"
ACTION_KINDS = ("online_assessment", "interview", "offer", "recruiter_reply", "action_required")

#: Seconds after which a board may not be put off, and the cadence up to which one of a slow system is not.
NO_STARVING, PRIORITY_INTERVAL = 6 * 3600, 15 * 60


def agencies(boards: DataFrame, postings: DataFrame, board: str = "board", name: str = "company_name", description: str = "description") -> DataFrame:
    """boards with described, templated and agency ("name", "template" or null): agencies repost what others offer.

    Postings are summed up for each board before the join.
    """
    long = F.length(F.coalesce(description, F.lit(""))) >= DESCRIBED
    sums = postings.groupBy(board).agg(F.count_if(long).alias("described"), F.count_if(long & F.col(description).rlike(CONTRACT)).alias("templated"))
    out = boards.join(sums, board, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("described", "templated")})
    by_template = (F.col("described") >= LEAST_DESCRIBED) & (F.col("templated") >= AGENCY_SHARE * F.col("described"))
    return out.withColumn("agency", F.when(F.col(name).rlike(AGENCY_NAME), "name").when(by_template, "template"))


def lead_counts(leads: DataFrame, polling: str = "polling") -> DataFrame:
    """by ("state" or "origin"), value, n, polling: how many leads, and how many of them are polled, in one pass over both groupings."""
    sets = leads.groupingSets([[F.col("state")], [F.col("origin")]], F.col("state"), F.col("origin"))
    rows = sets.agg(F.grouping("state").alias("__o"), F.count("*").alias("n"), F.count_if(F.col("state") == polling).alias("polling"))
    return rows.select(F.when(F.col("__o") == 0, "state").otherwise("origin").alias("by"), F.when(F.col("__o") == 0, F.col("state")).otherwise(F.col("origin")).alias("value"), "n", "polling")


def alert_order() -> list[Column]:
    """New-graduate roles, then the best score, then roles whose requirements were read, then the company."""
    return [F.desc("is_new_grad"), F.desc_nulls_last("score"), F.desc("requirements_verified"), F.asc("company")]


def due(boards: DataFrame, now: Column, slow: tuple[str, ...] = ("workday",)) -> DataFrame:
    """The boards that are due and not being read, in the order of reading, with `later`: slow systems' rarely read boards wait for others unless they are long overdue.

    boards: source_type, poll_interval_seconds, due_at, in_flight, position.
    """
    waited = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("due_at").cast("timestamp"))
    later = F.col("source_type").isin(*slow) & (F.col("poll_interval_seconds") > PRIORITY_INTERVAL) & (waited < NO_STARVING)
    ready = boards.where(~F.coalesce("in_flight", F.lit(False)) & (F.col("due_at") <= now))
    return ready.withColumn("later", F.coalesce(later, F.lit(False))).orderBy("later", "due_at", "position")


def verified_reports(names: DataFrame, reports: DataFrame, boards: DataFrame, blocked: Column) -> DataFrame:
    """reports of verified entities that bear exactly one of the names (company), where no board of that name is blocked; newest period first.

    A display alias is never expanded: the join is on the name as written.
    """
    withheld = boards.where(F.coalesce(blocked, F.lit(False))).select(F.col("company_name").alias("company")).distinct()
    safe = names.select("company").distinct().join(withheld, "company", "left_anti")
    return reports.where("entity_verified").join(safe, "company", "left_semi").orderBy(F.desc("period"), F.desc("id"))


def mail_decision(unlinked_reason: str, unclear_reason: str) -> Column:
    """What is shown as decided about a mail (classification, decision, decision_reason, selected_application_key): older filings are read by the start of their reason."""
    kind, decision, reason = F.col("classification"), F.col("decision"), F.coalesce("decision_reason", F.lit(""))
    filed, free = decision == "update", F.col("selected_application_key").isNull()
    return (
        F.when(filed & (kind == "rejection") & (reason == COMPANY_REASON), "company_rejection")
        .when(filed & (kind == "rejection") & (reason == unlinked_reason), "unlinked")
        .when(filed & free & (kind == "rejection") & reason.startswith(REJECTION_PREFIX), "classified_rejection")
        .when(filed & free & kind.isin(*ACTION_KINDS) & reason.startswith(ACTION_PREFIX), "classified_action")
        .when(decision.isin("review", "exact_preview") & (kind == "unclear") & (reason == unclear_reason), "update")
        .otherwise(decision)
    )


def workflow(decision: Column, link_reasons: tuple[str, ...]) -> Column:
    """The desk's tray of a mail, from its shown decision: what is filed or recorded, put off, routine, without its application, or the owner's to review."""
    awaiting = F.col("selected_application_key").isNull() & F.col("decision_reason").isin(*link_reasons)
    return (
        F.when(decision.isin("classified_rejection", "classified_action"), decision)
        .when(decision == "company_rejection", "company_recorded")
        .when(decision.isin("automatic", "manual"), "recorded")
        .when(decision == "deferred", "deferred")
        .when(decision.isin("ignored", "unrelated"), "routine")
        .when(decision.isin("receipt", "update"), "filed")
        .when(decision == "unlinked", "unlinked_outcome")
        .when(awaiting, "awaiting_link")
        .otherwise("owner_review")
    )


def claimed(jobs: DataFrame, pulls: DataFrame, current: Column) -> DataFrame:
    """jobs with session_id: rows that no pull owns and that were first seen since the earliest pull's start go to the current one."""
    since = pulls.agg(F.min("started_at").alias("__since"))
    free = F.col("session_id").isNull() & (F.col("first_seen_at") >= F.col("__since"))
    return jobs.join(F.broadcast(since)).withColumn("session_id", F.when(free, current).otherwise(F.col("session_id"))).drop("__since")  # one row


def watchlist_names(pages: DataFrame, html: str = "html") -> DataFrame:
    """name: every employer that the pages' data name, once; escapes are undone, broken ones left out."""
    quoted = F.explode(F.regexp_extract_all(html, F.lit(r'"companyName"\s*:\s*("(?:[^"\\]|\\.){2,80}")'), F.lit(1))).alias("q")
    name = F.trim(F.from_json(F.concat(F.lit('{"name":'), "q", F.lit("}")), "name string")["name"])
    return pages.select(quoted).select(name.alias("name")).where("name <> ''").distinct()


def miss_reasons(roles: DataFrame, boards: DataFrame, leads: DataFrame, reasons: dict[str, str], unread: dict[str, str], otherwise: str) -> DataFrame:
    """roles (role_id, company, link) with reason: why a listed role was not found.

    In this order: what is known of the board that its link names (board_key,
    enabled, agency, stale), of a board of its company, of the link's system,
    of a site that can't be read (host to name), of a lead for the company
    (state to reason).  boards: board_key, company, enabled, agency, stale.
    """
    found = urls.hiring_system(F.col("link"))
    r = roles.withColumn("__sys", found).withColumn("__key", urls.board_key(F.col("__sys.type"), F.col("__sys.account")))
    by_key = boards.groupBy(F.col("board_key").alias("__key")).agg(F.max_by(F.struct("enabled", "agency", "stale"), F.struct("enabled", "agency", "stale")).alias("__held"))
    forms = lambda df: df.withColumn("__c", F.explode(text.company_keys(F.col("company"))))
    by_company = forms(boards).groupBy("__c").agg(F.bool_and("stale").alias("__all_stale"))
    by_lead = forms(leads).groupBy("__c").agg(F.min("state").alias("__state"))
    own = forms(roles.select("role_id", "company")).join(by_company, "__c", "left").join(by_lead, "__c", "left")
    own = own.groupBy("role_id").agg(F.bool_and("__all_stale").alias("__all_stale"), F.min("__state").alias("__state"))
    held, h = F.col("__held"), urls.host(urls.with_scheme(F.col("link")))
    site = F.coalesce(F.lit(None).cast("string"), *[F.when((h == s) | h.endswith(f".{s}"), F.lit(f"Posted on {n}, which can't be read yet")) for s, n in unread.items()])
    state = F.create_map(*[F.lit(x) for kv in (reasons or {"": ""}).items() for x in kv])[F.col("__state")]
    reason = (
        F.when(held.isNotNull() & ~held["enabled"] & held["agency"], "The board is an agency's and off")
        .when(held.isNotNull() & ~held["enabled"], "The board is off")
        .when(held.isNotNull() & held["stale"], "The board was not read lately")
        .when(held.isNotNull(), "The board is read")
        .when(F.col("__key").isNotNull() & F.col("__sys").isNotNull(), "A board that can be read and is not added")
        .when(F.col("__all_stale"), "The board was not read lately")
        .when(F.col("__all_stale").isNotNull(), "The board is read")
        .otherwise(F.coalesce(site, state, F.lit(otherwise)))
    )
    return r.join(by_key, "__key", "left").join(own, "role_id", "left").select(*roles.columns, reason.alias("reason"))
