"""The cohort report over applications made of customers, with the events as their ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import audit, cohorts
from strataline.plans.registry import query
from strataline.session import Scratch
from strataline.sources.tables import table

_KINDS = cohorts.KINDS
_HAS = lambda *kinds: "(" + " OR ".join(f"list_contains(kinds, '{k}')" for k in kinds) + ")"
_EACH = ", ".join(f"count(*) FILTER (reason IS NULL AND kind = '{k}') AS n_{k}, min(moment) FILTER (reason IS NULL AND kind = '{k}') AS first_{k}, max(moment) FILTER (reason IS NULL AND kind = '{k}') AS last_{k}" for k in _KINDS)
_STAGE = "CASE status WHEN 'screening' THEN 'recruiter_reply' WHEN 'interviewing' THEN 'interview' WHEN 'offer' THEN 'offer' WHEN 'rejected' THEN 'rejection' END"


@query(f"""WITH a AS (SELECT c_custkey AS key, c_mktsegment AS family, CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2023-12-20' + to_days((c_custkey % 40)::INTEGER) END AS applied_at,
['applied', 'screening', 'interviewing', 'rejected', 'withdrawn', 'offer', NULL][c_custkey % 7 + 1] AS status, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-20' END AS changed_at FROM customer),
e AS (SELECT event_id AS id, user_id AS key, CASE event_type WHEN 'purchase' THEN 'offer' WHEN 'view' THEN 'online_assessment' WHEN 'click' THEN 'manual_correction' WHEN 'error' THEN 'rejection' ELSE 'note' END AS kind,
CASE WHEN event_id % 9 = 0 THEN 'preview' ELSE 'owner' END AS actor, ['screening', 'interviewing', 'rejected', 'applied'][event_id % 4 + 1] AS new_status, CASE WHEN event_id % 8 <> 0 THEN ts END AS moment, CASE WHEN event_id % 13 = 0 THEN event_id - 5 END AS undo_of FROM events),
s AS (SELECT e.*, e.id IN (SELECT undo_of FROM e WHERE undo_of IS NOT NULL) AS undone FROM e WHERE undo_of IS NULL),
k AS (SELECT id, key, CASE WHEN kind <> 'manual_correction' THEN kind ELSE (SELECT {_STAGE.replace('status', 's.new_status')}) END AS kind, actor, moment, undone FROM s),
t AS (SELECT k.*, CASE WHEN undone THEN 'undone_event' WHEN actor <> 'owner' THEN 'unconfirmed_actor' WHEN moment > TIMESTAMP '2024-01-28' THEN 'future_timestamp' WHEN moment < applied_at - INTERVAL 1 DAY THEN 'before_application' END AS reason FROM k JOIN a USING (key) WHERE kind IN ({', '.join(f"'{x}'" for x in _KINDS)})),
g AS (SELECT key, {_EACH}, {', '.join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in cohorts.REASONS)} FROM t GROUP BY key),
h AS (SELECT a.*, {_STAGE} AS stage, g.* EXCLUDE (key), list_filter([{', '.join(f"CASE WHEN n_{x} > 0 THEN '{x}' END" for x in _KINDS)}], lambda x: x IS NOT NULL) AS own FROM a LEFT JOIN g USING (key)),
r AS (SELECT *, CASE WHEN status = 'screening' THEN CASE WHEN NOT coalesce(list_has_any(own, [{', '.join(f"'{x}'" for x in cohorts.POSITIVE)}]), false) THEN 'screening' END WHEN stage IS NOT NULL AND NOT coalesce(list_contains(own, stage), false) THEN stage END AS recorded FROM h),
q AS (SELECT *, CASE WHEN recorded IS NULL THEN coalesce(own, []) ELSE list_append(coalesce(own, []), recorded) END AS kinds FROM r),
w AS (SELECT *, CASE WHEN status = 'screening' AND list_contains(kinds, 'screening') THEN 'screening' ELSE stage END AS sk, greatest({', '.join(f'last_{x}' for x in _KINDS)}) AS latest FROM q),
p AS (SELECT *, CASE WHEN len(kinds) = 0 THEN NULL WHEN list_contains(kinds, sk) AND (CASE sk {' '.join(f"WHEN '{x}' THEN last_{x}" for x in _KINDS)} END) IS NULL THEN CASE WHEN stage = 'rejection' THEN 'rejection' ELSE 'positive' END
WHEN stage IS NOT NULL AND changed_at IS NOT NULL AND (latest IS NULL OR changed_at > latest) THEN CASE WHEN stage = 'rejection' THEN 'rejection' ELSE 'positive' END
WHEN latest IS NOT NULL THEN CASE WHEN last_rejection = latest THEN 'rejection' ELSE 'positive' END WHEN list_contains(kinds, 'rejection') THEN 'rejection' ELSE 'positive' END AS polarity,
coalesce(applied_at <= TIMESTAMP '2024-01-28' - INTERVAL 30 DAY, false) AS mature, CASE WHEN least({', '.join(f'first_{x}' for x in _KINDS)}) >= applied_at THEN date_diff('day', applied_at, least({', '.join(f'first_{x}' for x in _KINDS)})) END AS lag FROM w)
SELECT family, count(*) AS submitted, count(*) FILTER (applied_at IS NULL) AS undated, count(*) FILTER (mature) AS eligible, count(*) FILTER ({_HAS(*cohorts.POSITIVE)}) AS responses, count(*) FILTER ({_HAS('rejection')}) AS rejections,
count(*) FILTER ({_HAS('online_assessment')}) AS assessments, count(*) FILTER ({_HAS('interview', 'interviewing')}) AS interviews, count(*) FILTER ({_HAS('offer', 'accepted')}) AS offers,
count(*) FILTER (mature AND polarity = 'positive') AS confirmed_positive, count(*) FILTER (mature AND polarity = 'rejection') AS confirmed_negative, count(*) FILTER (mature AND len(kinds) = 0 AND coalesce(status <> 'withdrawn', NULL)) AS pending, count(*) FILTER (mature AND len(kinds) = 0 AND status = 'withdrawn') AS unknown,
count(*) FILTER (status = 'withdrawn') AS withdrawn, count(recorded) AS recorded_only, count(*) FILTER ({_HAS('rejection')} AND polarity = 'positive') AS reconsidered, count(*) FILTER (status = 'withdrawn' AND {_HAS(*cohorts.POSITIVE)}) AS withdrawn_after_progress,
count(lag) AS timed, quantile_cont(lag, 0.5) AS median_lag, count(*) FILTER (lag <= 7) AS lag_7, count(*) FILTER (lag > 7 AND lag <= 14) AS lag_14, count(*) FILTER (lag > 14 AND lag <= 30) AS lag_30, count(*) FILTER (lag > 30) AS lag_more,
{', '.join(f'sum(coalesce(n_{x}, 0))::BIGINT AS events_{x}' for x in _KINDS)}, {', '.join(f'sum(coalesce({x}, 0))::BIGINT AS {x}' for x in cohorts.REASONS)}, {', '.join(f'count(*) FILTER ({_HAS(x)}) AS with_{x}' for x in _KINDS)} FROM p GROUP BY family""")
def cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures by family: undone and doubtful events left out, latest outcomes, recorded stages, response times."""
    k = F.col("c_custkey")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    day = lambda d: F.lit(datetime(*d)).cast("timestamp_ntz")
    applications = table(spark, sf_dir, "customer").select(
        k.alias("key"), F.col("c_mktsegment").alias("family"), F.when(k % 11 != 0, day((2023, 12, 20)) + F.make_dt_interval((k % 40).cast("int"))).alias("applied_at"),
        pick(("applied", "screening", "interviewing", "rejected", "withdrawn", "offer", None), k).alias("status"), F.when(k % 3 == 0, day((2024, 1, 20))).alias("changed_at"),
    )
    i, kind = F.col("event_id"), F.col("event_type")
    kinds = F.when(kind == "purchase", "offer").when(kind == "view", "online_assessment").when(kind == "click", "manual_correction").when(kind == "error", "rejection").otherwise("note")
    events = table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id").alias("key"), kinds.alias("kind"), F.when(i % 9 == 0, "preview").otherwise("owner").alias("actor"),
        pick(("screening", "interviewing", "rejected", "applied"), i).alias("new_status"), F.when(i % 8 != 0, F.col("ts")).alias("at"), F.when(i % 13 == 0, i - 5).alias("undo_of"),
    )
    return cohorts.report(applications, events, day((2024, 1, 28)), by=["family"])


_FINDINGS = ", ".join(f"count(*) FILTER (finding = '{f}') AS {f}" for f in audit.FINDINGS)


@query(f"""WITH a AS (SELECT c_custkey AS key, TIMESTAMP '2024-01-05' + to_days((c_custkey % 10)::INTEGER) AS applied_at FROM customer WHERE c_custkey % 10 <> 4),
e AS (SELECT event_id AS id, user_id AS key, event_type, ts, event_id // 3 * 3 AS message_id, event_id % 9 <> 0 AS trusted, CASE WHEN event_id % 13 = 0 THEN event_id - 6 END AS undo_of FROM events),
l AS (SELECT e.*, a.applied_at, CASE WHEN event_type NOT IN ('purchase', 'error') THEN 3 WHEN ts > TIMESTAMP '2024-01-28' THEN 4 WHEN epoch(applied_at) - epoch(ts) > 86400 THEN 5 WHEN applied_at > ts AND epoch(applied_at) > epoch(ts) THEN 6 ELSE 7 END AS n
FROM e JOIN a USING (key) WHERE undo_of IS NULL AND id NOT IN (SELECT undo_of FROM e WHERE undo_of IS NOT NULL) AND trusted),
b AS (SELECT message_id, key, min(n) AS n FROM l GROUP BY 1, 2), t AS (SELECT message_id, count(*) AS targets FROM b GROUP BY 1),
m AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id + 1 END AS selected FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 1),
r AS (SELECT m.id, CASE WHEN a.key IS NULL THEN 0 WHEN t.targets > 1 THEN 1 ELSE coalesce(b.n, 2) END AS n FROM m LEFT JOIN t ON t.message_id = m.id LEFT JOIN b ON b.message_id = m.id AND b.key = m.selected LEFT JOIN a ON a.key = m.selected),
f AS (SELECT {list(audit.FINDINGS)}[n + 1] AS finding FROM r)
SELECT count(*) AS messages, {_FINDINGS} FROM f""")
def inbox_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that were observed while the report on every recorded message was written."""
    k, i = F.col("c_custkey"), F.col("event_id")
    day = lambda d: F.lit(datetime(*d)).cast("timestamp_ntz")
    applications = table(spark, sf_dir, "customer").where(k % 10 != 4).select(k.alias("key"), (day((2024, 1, 5)) + F.make_dt_interval((k % 10).cast("int"))).alias("applied_at"))
    rows = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "offer").when(F.col("event_type") == "error", "rejection").otherwise("note")
    events = rows.select(i.alias("id"), F.col("user_id").alias("key"), kind.alias("kind"), F.when(i % 9 != 0, "owner").otherwise("preview").alias("actor"), F.lit(None).cast("string").alias("new_status"), F.col("ts").alias("at"), F.when(i % 13 == 0, i - 6).alias("undo_of"), (F.floor(i / 3) * 3).alias("message_id"))
    messages = rows.where((i % 3 == 0) & (i % 5 != 1)).select(i.alias("id"), F.when(i % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("selected_key"), F.lit("automatic").alias("decision"))
    report, figures = audit.observed(audit.reconciled(messages, events, applications, day((2024, 1, 28))))
    Scratch(spark, "audit").save(report)
    told = figures.get
    return spark.createDataFrame([tuple(told[c] for c in ("messages", *audit.FINDINGS))], ", ".join(f"{c} long" for c in ("messages", *audit.FINDINGS)))
