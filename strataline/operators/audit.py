"""Reconciliation of recorded messages with the ledger of events: each message's finding, and figures gathered as the report runs.

Figures are observed metrics of the report itself (Dataset.observe): the
action that writes it also counts it, and nothing is read a second time.

Defined cases: a message without a selected application, or with an unknown
one, is named as such; of several findings the first in the order of FINDINGS
counts; repeated messages are one finding each; an empty mailbox gives zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strataline.operators import cohorts

#: What a recorded message may turn out to be, first come first served.
FINDINGS = (
    "missing_selected_application", "conflicting_application_targets", "no_active_confirmed_application_event", "non_outcome_event", "future_outcome_timestamp",
    "outcome_before_submission_over_24h", "outcome_before_mark_within_24h", "counted_with_email_link",
)
#: Decisions that make a message recorded.
RECORDED = ("automatic", "manual")


def reconciled(messages: DataFrame, events: DataFrame, applications: DataFrame, now: Column) -> DataFrame:
    """id, key, finding for every recorded message.

    messages: id, selected_key, decision; events: those of cohorts with
    message_id; applications: key, applied_at.  Events meet by their own id
    and then by their message, in part before they move.
    """
    alive = cohorts.surviving(events).where("not undone").select("id", "key", "kind", "actor", "at")
    linked = alive.join(events.where("undo_of is null").select("id", "message_id"), "id").where(F.col("message_id").isNotNull() & F.col("actor").isin(*cohorts.ACTORS))
    known = linked.join(applications.select("key", "applied_at"), "key")
    lag = F.unix_timestamp("applied_at") - F.unix_timestamp("at")
    outcome = F.coalesce(F.col("kind").isin(*cohorts.KINDS), F.lit(False))
    each = F.when(~outcome, 3).when(F.coalesce(F.col("at") > now, F.lit(False)), 4).when(lag > 86400, 5).when(lag > 0, 6).otherwise(7)
    told = known.select("message_id", "key", each.alias("n")).groupBy("message_id", "key").agg(F.min("n").alias("n"))
    by_message = told.groupBy("message_id").agg(F.count("*").alias("targets"), F.collect_list(F.struct("key", "n")).alias("own"))  # the applications of one message
    recorded = messages.where(F.col("decision").isin(*RECORDED)).select("id", "selected_key")
    rows = recorded.join(by_message, F.col("id") == F.col("message_id"), "left").join(applications.select(F.col("key").alias("selected_key"), F.lit(True).alias("held")), "selected_key", "left")
    mine = F.get(F.filter("own", lambda o: o["key"] == F.col("selected_key")), F.lit(0))["n"]
    n = F.when(F.col("held").isNull(), 0).when(F.col("targets") > 1, 1).otherwise(F.coalesce(mine, F.lit(2)))
    return rows.select("id", F.col("selected_key").alias("key"), F.element_at(F.array(*map(F.lit, FINDINGS)), n + 1).alias("finding"))


def observed(report: DataFrame, name: str = "audit") -> tuple[DataFrame, Observation]:
    """The report, and the figures that its first action will have gathered: messages, and one for each finding."""
    figures = Observation(name)
    return report.observe(figures, F.count(F.lit(1)).alias("messages"), *[F.count_if(F.col("finding") == f).alias(f) for f in FINDINGS]), figures
