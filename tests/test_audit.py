"""Planted mismatches are each named, and the figures come from the run that writes the report."""

from datetime import datetime

from pyspark.sql import functions as F

from strataline.operators import audit


def test_each_mismatch_is_named(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    applications = spark.createDataFrame([(k, at(5)) for k in "abcdefgh"], "key string, applied_at timestamp_ntz")
    messages = [(1, "zz"), (2, None), (3, "a"), (4, "b"), (5, "c"), (6, "d"), (7, "e"), (8, "f"), (9, "g"), (10, "h")]
    events = [
        (31, "a", "offer", "owner", at(6), None, 3), (32, "b", "offer", "owner", at(6), None, 3), (41, "b", "offer", "preview", at(6), None, 4), (51, "c", "note", "owner", at(6), None, 5),
        (61, "d", "offer", "owner", datetime(2025, 1, 1), None, 6), (71, "e", "rejection", "owner", at(1), None, 7), (81, "f", "rejection", "owner", at(4, 20), None, 8), (91, "g", "offer", "owner", at(9), None, 9),
        (101, "h", "offer", "owner", at(9), None, 10), (102, "h", "undo", "owner", at(9), 101, None), (111, "nobody", "offer", "owner", at(9), None, 9),
    ]
    told = spark.createDataFrame([(i, k, kind, who, None, t, u, m) for i, k, kind, who, t, u, m in events], "id long, key string, kind string, actor string, new_status string, at timestamp_ntz, undo_of long, message_id long")
    mail = spark.createDataFrame([(i, k, "manual") for i, k in messages] + [(99, "a", "pending")], "id long, selected_key string, decision string")
    report, figures = audit.observed(audit.reconciled(mail, told, applications, F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz")))
    got = {r.id: r.finding for r in report.collect()}
    n = audit.FINDINGS
    assert got == {1: n[0], 2: n[0], 3: n[1], 4: n[2], 5: n[3], 6: n[4], 7: n[5], 8: n[6], 9: n[7], 10: n[2]}
    assert figures.get == {"messages": 10, **{f: list(got.values()).count(f) for f in n}}
