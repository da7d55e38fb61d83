"""The cohort report on small ledgers."""

from datetime import datetime

from pyspark.sql import functions as F

from strataline.operators import cohorts

NOW = datetime(2024, 3, 1)
APPLICATIONS = "key string, applied_at timestamp_ntz, status string, changed_at timestamp_ntz"
EVENTS = "id long, key string, kind string, actor string, new_status string, at timestamp_ntz, undo_of long"


def at(day, month=1):
    return datetime(2024, month, day)


def told(spark, applications, events):
    return cohorts.report(spark.createDataFrame(applications, APPLICATIONS), spark.createDataFrame(events, EVENTS), F.lit(NOW).cast("timestamp_ntz")).first().asDict()


def test_each_rule(spark):
    applications = [("late no", at(1), "rejected", at(20)), ("undone", at(1), "applied", None), ("tie", at(1), None, None), ("quiet", at(1), "applied", None), ("gone", at(1), "withdrawn", None), ("young", at(20, 2), "screening", None), ("undated", None, "offer", None), ("back", at(1), "interviewing", None)]
    events = [
        (1, "late no", "interview", "owner", None, at(10), None),
        (2, "undone", "offer", "owner", None, at(5), None), (3, "undone", "undo", "owner", None, at(6), 2),
        (4, "tie", "rejection", "owner", None, at(9), None), (5, "tie", "offer", "verified_automation", None, at(9), None),
        (6, "quiet", "offer", "preview", None, at(9), None), (7, "quiet", "rejection", "owner", None, at(9, 4), None), (8, "quiet", "interview", "owner", None, datetime(2023, 12, 1), None),
        (9, "back", "rejection", "owner", None, at(3), None), (10, "back", "manual_correction", "owner", "interviewing", None, None),
        (11, "nobody", "offer", "owner", None, at(3), None), (12, "quiet", "note", "owner", None, at(3), None),
    ]
    r = told(spark, applications, events)
    assert (r["submitted"], r["undated"], r["eligible"]) == (8, 1, 6)
    # the later status decides; at equal times the rejection; an undated stage decides before an older rejection
    assert (r["confirmed_negative"], r["confirmed_positive"], r["pending"], r["unknown"]) == (2, 1, 2, 1)
    assert [r[x] for x in cohorts.REASONS] == [1, 1, 1, 1]
    assert (r["reconsidered"], r["recorded_only"], r["with_screening"], r["offers"]) == (1, 3, 1, 2)
    assert (r["timed"], r["median_lag"], r["lag_7"], r["lag_14"]) == (3, 8.0, 1, 2)


def test_empty_ledger(spark):
    r = told(spark, [("a", at(1), "rejected", None), ("b", at(1), None, None)], [])
    assert (r["rejections"], r["confirmed_negative"], r["pending"], r["events_offer"]) == (1, 1, 0, 0)
    assert told(spark, [], [(1, "a", "offer", "owner", None, at(1), None)])["submitted"] == 0
