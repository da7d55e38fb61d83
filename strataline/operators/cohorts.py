"""The cohort report: what became of applications, from a ledger of events, in one pass.

Events are brought together with what undoes them by their own id, so that
step is even whatever an application's share of the ledger; survivors are
summed up for each application, in part before they move, and every figure of
the report comes from one aggregate over the applications.

Rules.  An event that was undone, that a stranger entered, that lies ahead of
now, or before the application by more than a grace, is excluded and counted
by its first such reason.  A stage that is only recorded as an application's
status counts once, without a time.  Of several outcomes the latest decides,
the rejection at equal times; a status without a dated event of its kind, or
changed after the last dated event, decides before these.

Defined cases: undated events count and set no time; events of unknown
applications take no part; an application without a date is submitted, undated
and never mature; an empty ledger leaves what the statuses say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that are progress, the outcome that each status stands for, actors whose word counts, days to maturity.
POSITIVE = ("recruiter_reply", "online_assessment", "screening", "interview", "interviewing", "offer", "accepted")
STAGES = {"screening": "recruiter_reply", "interviewing": "interview", "offer": "offer", "accepted": "accepted", "rejected": "rejection"}
ACTORS = ("owner", "verified_automation")
MATURE_DAYS = 30
KINDS = (*POSITIVE, "rejection")
REASONS = ("undone_event", "unconfirmed_actor", "future_timestamp", "before_application")


def surviving(events: DataFrame) -> DataFrame:
    """Events (id, key, kind, actor, new_status, at, undo_of) with `undone`, without the undoing ones; a correction has the kind of its new status."""
    each = F.when(F.col("undo_of").isNull(), F.struct("key", "kind", "actor", "new_status", "at"))
    met = events.groupBy(F.coalesce("undo_of", "id").alias("id")).agg(F.max(each).alias("e"), F.max(F.col("undo_of").isNotNull()).alias("undone")).where("e is not null")
    stages = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    kind = F.when(F.col("e.kind") == "manual_correction", stages[F.col("e.new_status")]).otherwise(F.col("e.kind"))
    return met.select("id", "e.key", kind.alias("kind"), "e.actor", "e.at", "undone")


def histories(applications: DataFrame, events: DataFrame, now: Column, grace: str = "1 day") -> DataFrame:
    """applications (key, applied_at, status, changed_at, ...) with n, first and last time of each kind of event, and counts of what was excluded."""
    told = surviving(events).where(F.col("kind").isin(*KINDS)).join(applications.select("key", F.col("applied_at").alias("from_at")), "key")
    reason = F.when(F.col("undone"), REASONS[0]).when(~F.coalesce(F.col("actor").isin(*ACTORS), F.lit(False)), REASONS[1]).when(F.col("at") > now, REASONS[2]).when(F.col("at") < F.col("from_at") - F.expr(f"interval {grace}"), REASONS[3])
    told = told.withColumn("reason", reason)
    good = lambda k: F.col("reason").isNull() & (F.col("kind") == k)
    each = [a for k in KINDS for a in (F.count_if(good(k)).alias(f"n_{k}"), F.min(F.when(good(k), F.col("at"))).alias(f"first_{k}"), F.max(F.when(good(k), F.col("at"))).alias(f"last_{k}"))]
    summed = told.groupBy("key").agg(*each, *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    return applications.join(summed, "key", "left").fillna(0, [*[f"n_{k}" for k in KINDS], *REASONS])


def outcomes(rows: DataFrame) -> DataFrame:
    """histories() with `kinds` (an array, recorded stages with it), `recorded` and `polarity` (positive, rejection or null)."""
    any_positive = reduce(Column.__or__, [F.col(f"n_{k}") > 0 for k in POSITIVE])
    stages = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    stage = stages[F.col("status")]
    own = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in KINDS]))
    rows = rows.withColumn("stage", stage).withColumn("own", own)
    recorded = F.when(F.col("status") == "screening", F.when(~any_positive, "screening")).when(F.col("stage").isNotNull() & ~F.array_contains("own", F.col("stage")), F.col("stage"))
    rows = rows.withColumn("recorded", recorded).withColumn("kinds", F.array_compact(F.concat("own", F.array("recorded"))))
    status_kind = F.when((F.col("status") == "screening") & F.array_contains("kinds", "screening"), "screening").otherwise(F.col("stage"))
    lasts = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.col(f"last_{k}"))])
    dated = F.array_max(F.array(*[F.when(F.col(f"last_{k}").isNotNull(), F.struct(F.col(f"last_{k}").alias("at"), F.lit(k == "rejection").alias("no"))) for k in KINDS]))
    rows = rows.withColumn("status_kind", status_kind).withColumn("latest", dated)
    word = lambda no: F.when(no, "rejection").otherwise("positive")
    polarity = (
        F.when(F.size("kinds") == 0, None)
        .when(F.array_contains("kinds", F.col("status_kind")) & lasts[F.col("status_kind")].isNull(), word(F.col("stage") == "rejection"))
        .when(F.col("stage").isNotNull() & F.col("changed_at").isNotNull() & (F.col("latest").isNull() | (F.col("changed_at") > F.col("latest.at"))), word(F.col("stage") == "rejection"))
        .when(F.col("latest").isNotNull(), word(F.col("latest.no")))
        .otherwise(word(F.array_contains("kinds", "rejection")))
    )
    return rows.withColumn("polarity", polarity)


def report(applications: DataFrame, events: DataFrame, now: Column, by: list[str] | None = None, grace: str = "1 day") -> DataFrame:
    """One row for each group of `by` (or one in all) with all figures of the cohort."""
    rows = outcomes(histories(applications, events, now, grace))
    mature = F.coalesce(F.col("applied_at") <= now - F.expr(f"interval {MATURE_DAYS} days"), F.lit(False))
    has = lambda *kinds: F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))
    first = F.least(*[F.col(f"first_{k}") for k in KINDS])
    lag = F.when(first >= F.col("applied_at"), F.datediff(first, F.col("applied_at")))
    none = mature & ~has(*KINDS)
    gone = F.col("status") == "withdrawn"
    figures = {
        "submitted": F.count("*"), "undated": F.count_if(F.col("applied_at").isNull()), "eligible": F.count_if(mature),
        "responses": F.count_if(has(*POSITIVE)), "rejections": F.count_if(has("rejection")), "assessments": F.count_if(has("online_assessment")), "interviews": F.count_if(has("interview", "interviewing")), "offers": F.count_if(has("offer", "accepted")),
        "confirmed_positive": F.count_if(mature & (F.col("polarity") == "positive")), "confirmed_negative": F.count_if(mature & (F.col("polarity") == "rejection")), "pending": F.count_if(none & ~gone), "unknown": F.count_if(none & gone),
        "withdrawn": F.count_if(gone), "recorded_only": F.count_if(F.col("recorded").isNotNull()), "reconsidered": F.count_if(has("rejection") & (F.col("polarity") == "positive")), "withdrawn_after_progress": F.count_if(gone & has(*POSITIVE)),
        "timed": F.count(lag), "median_lag": F.percentile(lag, 0.5), "lag_7": F.count_if(lag <= 7), "lag_14": F.count_if((lag > 7) & (lag <= 14)), "lag_30": F.count_if((lag > 14) & (lag <= 30)), "lag_more": F.count_if(lag > 30),
        **{f"events_{k}": F.sum(f"n_{k}") for k in KINDS}, **{r: F.sum(r) for r in REASONS}, **{f"with_{k}": F.count_if(has(k)) for k in KINDS},
    }
    return rows.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in figures.items()])
