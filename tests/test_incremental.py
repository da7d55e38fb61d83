"""Kept tables: what an update does, what it leaves alone, and that it can be run again."""

import os

import pytest
from pyspark.sql import functions as F

from strataline.operators import incremental

SCHEMA = "id long, size int"


def evaluate(jobs):
    return jobs.select("id", F.length("text").alias("size"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/kept"
    update = lambda rows, version="1": incremental.bring_up_to_date(spark.createDataFrame(rows, "id long, text string"), path, "id", ["text"], evaluate, SCHEMA, version, buckets=16)
    held = lambda: sorted((r.id, r.size) for r in incremental.evaluations(spark, path, SCHEMA).collect())
    rows = [(i, "x" * i) for i in range(40)]
    assert held() == []
    done = update([*rows, (None, "no key")])
    assert done == {"new": 40, "changed": 0, "gone": 0, "same": 0, "buckets": len({os.path.dirname(f) for f in files(path)})}
    assert held() == [(i, i) for i in range(40)]
    first = files(path)
    assert update(rows) == {"new": 0, "changed": 0, "gone": 0, "same": 40, "buckets": 0} and files(path) == first
    rows[7] = (7, "changed text")
    done = update([*rows[:30], (99, None)])
    assert (done["new"], done["changed"], done["gone"]) == (1, 1, 10)
    assert held() == sorted([*((i, i) for i in range(30) if i != 7), (7, 12), (99, None)], key=lambda r: r[0])
    assert 0 < done["buckets"] < 16 and set(first) & set(files(path))
    assert update([*rows[:30], (99, None)], "2")["changed"] == 31
    assert update([])["gone"] == 31 and held() == []


def test_an_update_that_failed_is_run_again(spark, tmp_path):
    path = f"{tmp_path}/kept"
    rows = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id long, text string")
    incremental.bring_up_to_date(rows.where("id < 10"), path, "id", ["text"], evaluate, SCHEMA, "1", buckets=4)
    before = files(path)
    broken = lambda jobs: jobs.select("id", F.raise_error(F.lit("down")).cast("int").alias("size"))
    with pytest.raises(Exception, match="down"):
        incremental.bring_up_to_date(rows, path, "id", ["text"], broken, SCHEMA, "1", buckets=4)
    assert files(path) == before
    assert incremental.bring_up_to_date(rows, path, "id", ["text"], evaluate, SCHEMA, "1", buckets=4)["new"] == 10
    assert incremental.evaluations(spark, path, SCHEMA).count() == 20


def test_equal_keys_count_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "bb"), (1, "bb"), (2, "c")], "id long, text string")
    update = lambda: incremental.bring_up_to_date(rows.repartition(3), f"{tmp_path}/kept", "id", ["text"], evaluate, SCHEMA, "1", buckets=2)
    assert update()["new"] == 2 and update()["buckets"] == 0


def test_days_with_late_rows(spark, tmp_path):
    path = f"{tmp_path}/days"
    rows = [(i, f"2024-01-{1 + i % 9:02d} 10:00:00", "ab"[i % 2], float(i)) for i in range(90)]
    frame = lambda own: spark.createDataFrame(own, "i long, at string, kind string, v double").withColumn("at", F.to_timestamp("at"))
    states = {"n": F.count("*"), "total": F.sum("v"), "most": F.max("v")}
    refresh = lambda own: incremental.refresh_days(frame(own), path, "at", ["kind"], states)
    total = lambda: {r.kind: (r.n, r.total, r.most) for r in incremental.merged(spark, path, ["kind"], {"n": F.sum("n"), "total": F.sum("total"), "most": F.max("most")}).collect()}
    want = lambda own: {k: (len(x), sum(x), max(x)) for k in "ab" for x in [[r[3] for r in own if r[2] == k]]}
    assert len(refresh(rows[:80])) == 9 and total() == want(rows[:80])
    before = files(path)
    assert refresh(rows[:80]) == [] and files(path) == before
    assert refresh(rows[:81]) == ["2024-01-09"] and total() == want(rows[:81])
    changed = [(r[0], r[1], r[2], -1.0) if r[0] == 3 else r for r in rows[:81]]
    assert refresh(changed) == ["2024-01-04"] and total() == want(changed)
    fewer = [r for r in changed if not r[1].startswith("2024-01-02")]
    assert refresh(fewer) == ["2024-01-02"] and total() == want(fewer)
    assert refresh([*fewer, (500, None, "a", 1.0)]) == []
