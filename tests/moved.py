"""Rows that Spark's shuffles wrote while something ran."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def _stages(spark: SparkSession) -> dict[int, int]:
    jvm, context = spark._jvm, spark.sparkContext
    empty = jvm.java.util.ArrayList
    found = context._jsc.sc().statusStore().stageList(empty(), False, False, context._gateway.new_array(jvm.double, 0), empty())
    return {(s := found.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(found.size())}


def moved(spark: SparkSession, run: Callable[[], object]) -> int:
    before = _stages(spark)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for i, n in _stages(spark).items() if i not in before)
