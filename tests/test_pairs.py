"""Pairs and firsts of large groups: what they move grows with rows, and links of copies are whole."""

import random

from pyspark.sql import functions as F

from strataline.operators import matching
from tests.moved import moved


def test_pairs_of_copies_match_every_pair(spark):
    rng = random.Random(5)
    words = "red blue old new hot cold ring bolt plate".split()
    rows = [(i, rng.choice(["a", "b", None]), sorted(set(rng.choices(words, k=rng.randint(0, 3))))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, t array<string>")
    share = lambda t, o: len(set(t) & set(o)) / min(len(t), len(o)) if t and o else 0.0
    want = sorted((i, j, share(t, o)) for i, c, t in rows for j, d, o in rows if i < j and c is not None and c == d and share(t, o) >= 0.5)
    for block, pairs in ((4096, 8_000_000), (7, 100)):
        got = matching.overlapping_pairs(df, 0.5, block, pairs)
        assert sorted(map(tuple, got.collect())) == want
    assert got.rdd.getNumPartitions() > 10  # dealt by the pairs that are to be made


def test_only_different_sets_are_compared(spark):
    """Of 4,000 rows in 2 sets, neither the 8 million pairs nor rows times rows are moved or compared."""
    rows = spark.range(4000).select("id", F.lit("a").alias("c"), F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("p"), F.lit("q"))).alias("t"))
    out = []
    assert moved(spark, lambda: out.append(matching.overlapping_pairs(rows, 0.5).count())) < 40_000
    assert out == [2 * 2000 * 1999 // 2]
    pairs = matching.overlapping_pairs(rows, 0.5)
    assert "BroadcastNestedLoopJoin" not in (plan := pairs._jdf.queryExecution().toString()) and "CartesianProduct" not in plan


def test_first_of_either_moves_no_pairs(spark):
    """A day with 3,000 rows on each side would be nine million pairs."""
    left = spark.range(3000).select("id", (F.col("id") % 50).alias("who"), F.lit(1).alias("day"))
    right = spark.range(3000).select((F.col("id") % 40).alias("who"), F.when(F.col("id") < 2990, 1).otherwise(2).alias("day"), (100 + F.col("id")).alias("at"))
    got = []
    assert moved(spark, lambda: got.extend(matching.first_of_either(left, right, [[("who", "who")], [("day", "day")]], "id", "at").collect())) < 40_000
    assert len(got) == 3000 and {r["first"] for r in got} == {100}
    alone = matching.first_of_either(left.withColumn("day", F.lit(9)), right, [[("who", "who")], [("day", "day")]], "id", "at")
    assert {r.left_id: r["first"] for r in alone.collect()} == {i: 100 + i % 50 for i in range(3000) if i % 50 < 40}
