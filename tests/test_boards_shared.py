"""Parts of a listing: put together by size, and all read."""

from pyspark.sql import functions as F

from strataline.sources import boards


def test_all_parts_of_a_listing_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boards, "PART_ROWS", 20)
    monkeypatch.setattr(boards, "PART_BYTES", 1)
    path = f"file://{tmp_path}/boards"
    none = F.lit(None).cast("string")
    rows = spark.range(100).select(F.lit("one").alias("board"), F.col("id").cast("string").alias("external_id"), F.concat(F.lit("t"), "id").alias("title"), none.alias("location"), none.alias("url"), none.alias("description"))
    boards.land(rows.repartition(1), path)
    got = boards.read_boards(spark, path)
    assert sorted(int(r.external_id) for r in got.collect()) == list(range(100))


def test_shares():
    assert boards.shares([("a", 3), ("b", 3), ("c", 9), ("d", 1)], 6) == [("a", "b"), ("c",), ("d",)] and boards.shares([], 6) == [()]
