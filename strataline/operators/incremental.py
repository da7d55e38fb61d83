"""Results that are kept as tables and brought up to date: only what changed is worked out and written again.

Both kinds of table are parted, and an update rewrites the parts that changed
by dynamic partition overwrite: Spark stages them aside and puts them in place
at the end, so a part is old or new, and an update that failed is simply run
again.  New parts are saved first, as they are made from old ones.

Defined cases: a table that is not there yet is empty; rows with a null key or
day take no part; of rows equal in key the one with the least hash of its
inputs counts; an update without changes writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.session import Scratch


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _overwrite(rows: DataFrame, path: str, by: str) -> None:
    """Puts the parts of `rows` in place of the table's own."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


# -- evaluations


def evaluations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The kept table; `schema` is that of the evaluation's columns, key first."""
    told = f"{schema}, input_hash string, bucket int"
    return spark.read.schema(told).parquet(path) if _exists(spark, path) else spark.createDataFrame([], told)


def bring_up_to_date(jobs: DataFrame, path: str, key: str, inputs: list[str], evaluate: Callable[[DataFrame], DataFrame], schema: str, version: str, buckets: int = 64) -> dict[str, int]:
    """Evaluates the jobs whose inputs or rule version changed, and rewrites only their buckets; counts of what was done.

    `evaluate` gives the columns of `schema` (key first) for rows of jobs.
    Jobs that are gone leave the table.  `buckets` is fixed for a table.
    """
    spark = jobs.sparkSession
    scratch = Scratch(spark, "evaluations")
    hashed = F.sha2(F.concat_ws("\x1f", F.lit(version), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in inputs]), 256)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    with scratch.within("work"):
        keyed = jobs.where(F.col(key).isNotNull()).withColumn("__hash", hashed)
        now = keyed.groupBy(key).agg(F.min("__hash").alias("input_hash")).withColumn("bucket", bucket)
        held = evaluations(spark, path, schema)
        both = now.alias("n").join(held.select(key, F.col("input_hash").alias("was"), F.col("bucket").alias("at")), key, "full_outer")
        state = F.when(F.col("was").isNull(), "new").when(F.col("input_hash").isNull(), "gone").when(F.col("was") != F.col("input_hash"), "changed").otherwise("same")
        states = Scratch(spark, "states").save(both.select(key, F.coalesce("bucket", "at").alias("bucket"), "input_hash", state.alias("state")))
        done = {s: 0 for s in ("new", "changed", "gone", "same")} | {r.state: r["count"] for r in states.groupBy("state").count().collect()}
        touched = [r.bucket for r in states.where("state <> 'same'").select("bucket").distinct().collect()]  # at most `buckets` numbers
        if touched:
            work = states.where("state in ('new', 'changed')").select(key, "input_hash", "bucket")
            due = keyed.join(work.select(key, F.col("input_hash").alias("__hash")), [key, "__hash"], "left_semi").dropDuplicates([key])
            fresh = evaluate(due.drop("__hash")).join(work, key)
            kept = held.where(F.col("bucket").isin(touched)).join(states.where("state = 'same'").select(key), key, "left_semi")
            columns = held.columns
            new = Scratch(spark, "parts").save(kept.select(*columns).unionByName(fresh.select(*columns)))
            _overwrite(new, path, "bucket")
            _drop_parts(spark, path, "bucket", set(touched) - {r.bucket for r in new.select("bucket").distinct().collect()})
    return done | {"buckets": len(touched)}


def _drop_parts(spark: SparkSession, path: str, by: str, values: set) -> None:
    """Parts that nothing is left of."""
    for v in values:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={v}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# -- daily aggregates


def refresh_days(rows: DataFrame, path: str, at: str, by: list[str], states: Mapping[str, Column]) -> list[str]:
    """Partial states of each day and group, kept at `path`; works out again the days whose rows changed, and names them.

    A day has changed if the number of its rows, or the sum of their hashes,
    has: one pass over the rows without their states.  States are aggregates
    that merge (see merged()).
    """
    spark = rows.sparkSession
    dated = rows.withColumn("day", F.to_date(at)).where("day is not null")
    marks = dated.groupBy("day").agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string").alias("digest"))
    scratch = Scratch(spark, "days")
    with scratch.within("work"):
        marks = Scratch(spark, "marks").save(marks)
        held = spark.read.schema("n_rows long, digest string, day string").parquet(path).select(F.to_date("day").alias("day"), "n_rows", "digest").distinct() if _exists(spark, path) else marks.limit(0)
        same = marks.join(held, ["day", "n_rows", "digest"], "left_semi").select("day")
        stale = marks.join(same, "day", "left_anti")
        days = sorted(str(r.day) for r in stale.select("day").collect())  # a number for each day
        gone = [str(r.day) for r in held.select("day").join(marks, "day", "left_anti").distinct().collect()]
        if days:
            part = dated.join(F.broadcast(stale.select("day", "n_rows", "digest")), "day").groupBy("day", "n_rows", "digest", *by).agg(*[c.alias(n) for n, c in states.items()])
            _overwrite(part.withColumn("day", F.col("day").cast("string")), path, "day")
        _drop_parts(spark, path, "day", set(gone))
    return sorted({*days, *gone})


def merged(spark: SparkSession, path: str, by: list[str], merges: Mapping[str, Column]) -> DataFrame:
    """The aggregate over all days, from their states."""
    return spark.read.parquet(path).groupBy(*by).agg(*[c.alias(n) for n, c in merges.items()])
