"""The data source of landed boards: filters reach the listing, and details of what they reject stay closed."""

import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, IsNull, Not, StringContains

from strataline.sources import boards

ROWS = [("acme", str(i), t, place, f"https://x/{i}", f"details of {i}\nsecond line") for i, (t, place) in enumerate([("Software Engineer", "NYC"), ("Senior Engineer", "NYC"), (None, "LA"), ("Engineer", None), ("Staff Nurse", "NYC")])] + [("beta inc/é", "7", "Engineer", "NYC", None, None)]


@pytest.fixture
def landed(spark, tmp_path):
    path = f"file://{tmp_path}/boards"
    boards.land(spark.createDataFrame(ROWS, boards.SCHEMA), path)
    return path


def test_all_rows(spark, landed):
    assert sorted(map(tuple, boards.read_boards(spark, landed).collect()), key=str) == sorted(ROWS, key=str)
    assert boards.read_boards(spark, landed).rdd.getNumPartitions() == 2
    assert boards.read_boards(spark, f"{landed}-none").count() == 0


def test_filters_are_pushed_and_details_stay_closed(spark, landed):
    wanted = boards.read_boards(spark, landed).where(~F.col("title").contains("Senior") & (F.col("location") == "NYC") & F.col("board").isNotNull())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("RuntimeFilters")[0]
    # what is pushed is no filter of Spark's any more; what is not, stays one
    assert "BatchScan landed_boards" in plan(wanted) and "Filter" not in plan(wanted)
    assert "Filter" in plan(wanted.where(F.length("description") > 3))
    shown = [tuple(r) for r in wanted.orderBy("board", "external_id").collect()]
    assert shown == [ROWS[0], ROWS[4], ROWS[5]]
    root = landed.removeprefix("file://")
    for i in (1, 2, 3):  # a folder of no text in place of details: to open it fails
        shutil.rmtree(f"{root}/details/board=acme/external_id={i}")
        bad = f"{root}/details/board=acme/external_id={i}"
        __import__("os").makedirs(f"{bad}/part-0")
    assert [tuple(r) for r in wanted.orderBy("board", "external_id").collect()] == shown
    with pytest.raises(Exception, match="part-0|directory"):
        boards.read_boards(spark, landed).collect()
    other = boards.read_boards(spark, landed).where((F.col("board") == "beta inc/é") & F.col("description").isNull())
    assert other.count() == 1 and other.rdd.getNumPartitions() == 1


def test_filters_as_in_sql():
    row = {"title": "Senior Engineer", "location": None, "board": "x"}
    assert boards.holds(StringContains(("title",), "Senior"), row) and not boards.holds(Not(StringContains(("title",), "Senior")), row)
    assert boards.holds(EqualTo(("location",), "NYC"), row) is None and boards.holds(Not(EqualTo(("location",), "NYC")), row) is None
    assert boards.holds(IsNull(("location",)), row) and not boards.holds(IsNotNull(("location",)), row) and boards.holds(In(("board",), ("x", "y")), row)
    assert not boards.known(EqualTo(("description",), "x")) and boards.known(Not(In(("title",), ("x",))))
