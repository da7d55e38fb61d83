"""Reports: counts, shares, percentiles, spines, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """A ratio rounded half to even, null when there is no whole."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def day_spine(rows: DataFrame, day: str, start: Column, end: Column, counts: dict[str, Column]) -> DataFrame:
    """day and counts for every day from start to end, 0 where nothing happened."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    had = rows.groupBy(F.col(day).alias("day")).agg(*[c.alias(n) for n, c in counts.items()])
    return spine.join(had, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def clipped_buckets(days: DataFrame, unit: str, start: Column, end: Column, sums: list[str]) -> DataFrame:
    """Weeks (from Monday) or months, their bounds clipped to the range: bucket_start, bucket_end, sums."""
    held = days.where((F.col("day") >= start) & (F.col("day") <= end))
    anchor = F.to_date(F.date_trunc(unit, "day"))
    last = F.date_add(anchor, 6) if unit == "week" else F.last_day(anchor)
    rows = held.groupBy(anchor.alias("anchor"), last.alias("until")).agg(*[F.sum(s).alias(s) for s in sums])
    return rows.select(F.greatest("anchor", start).alias("bucket_start"), F.least("until", end).alias("bucket_end"), *sums)


def histogram(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge that is not exceeded, null for null."""
    out = F.when(value.isNull(), None)
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(last)


def percentiles(rows: DataFrame, by: list[str], value: Column, shares: dict[str, float], least: int = 0) -> DataFrame:
    """Exact percentiles (linear between neighbours) for each group; null below `least` rows."""
    agg = rows.groupBy(*by).agg(F.count(value).alias("n"), *[F.percentile(value, p).alias(k) for k, p in shares.items()])
    return agg.select(*by, "n", *[F.when(F.col("n") >= least, F.round(k, 6)).alias(k) for k in shares])


def zero_filled(rows: DataFrame, group: Column, names: list[str]) -> DataFrame:
    """name, n for every name, also those without rows."""
    all_ = rows.sparkSession.createDataFrame([(n,) for n in names], "name string")
    had = rows.groupBy(group.alias("name")).agg(F.count("*").alias("n"))
    return all_.join(had, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def first_latest(events: DataFrame, key: str, kind: str, at: str, id_col: str) -> DataFrame:
    """key, kind, first_at, last_id, last_at, n: undated events count but set no time."""
    latest = F.max_by(F.struct(F.col(id_col).alias("id"), F.col(at).alias("at")), F.struct(F.col(at).isNotNull(), F.col(at), F.col(id_col)))
    return events.groupBy(key, kind).agg(F.min(at).alias("first_at"), latest["id"].alias("last_id"), latest["at"].alias("last_at"), F.count("*").alias("n"))


def polarity(events: DataFrame, key: str, positive: Column, negative: Column, at: str) -> DataFrame:
    """key, polarity of the latest outcome; at the same moment the rejection wins."""
    told = events.where(positive | negative)
    return told.groupBy(key).agg(F.max_by(F.when(negative, "rejected").otherwise("positive"), F.struct(F.col(at), negative.cast("int"))).alias("polarity"))


def cohort(applications: DataFrame, outcome: DataFrame, key: str, applied: str, now: Column, days: int = 30, withdrawn: str = "withdrawn") -> DataFrame:
    """One row: total, undated, eligible and its parts positive, rejected, pending, unknown, which are disjoint and sum to eligible."""
    rows = applications.join(outcome, key, "left")
    mature = F.coalesce(F.col(applied) <= now - F.expr(f"interval {days} days"), F.lit(False))
    p = F.col("polarity")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(applied).isNull()).alias("undated"),
        F.count_if(mature).alias("eligible"),
        F.count_if(mature & p.eqNullSafe(F.lit("positive"))).alias("positive"),
        F.count_if(mature & p.eqNullSafe(F.lit("rejected"))).alias("rejected"),
        F.count_if(mature & p.isNull() & ~F.col(withdrawn)).alias("pending"),
        F.count_if(mature & p.isNull() & F.col(withdrawn)).alias("unknown"),
    )


def single_target(events: DataFrame, message: str, target: str) -> DataFrame:
    """Events of messages that speak of one target only."""
    one = events.groupBy(message).agg(F.count_distinct(target).alias("n")).where("n = 1").select(message)
    return events.join(one, message, "left_semi")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share, null for none."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    centre, wide = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.try_divide(centre - wide, 1 + z * z / n), F.try_divide(centre + wide, 1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def confusion(rows: DataFrame, expected: str, predicted: str, categories: list[str]) -> DataFrame:
    """category, tp, fp, fn, precision, recall and the bounds of each; null where there is nothing to divide by."""
    kinds = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    e, p = F.col(expected), F.col(predicted)
    told = rows.select(F.explode(F.array_distinct(F.array(e, p))).alias("category"), e.alias("e"), p.alias("p"))
    c = F.col("category")
    counts = told.groupBy("category").agg(F.count_if((F.col("e") == c) & (F.col("p") == c)).alias("tp"), F.count_if((F.col("p") == c) & (F.col("e") != c)).alias("fp"), F.count_if((F.col("e") == c) & (F.col("p") != c)).alias("fn"))
    full = kinds.join(counts, "category", "left").select("category", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tp", "fp", "fn")])
    out = full
    for name, other in (("precision", "fp"), ("recall", "fn")):
        n = F.col("tp") + F.col(other)
        low, high = wilson(F.col("tp"), n)
        out = out.withColumn(name, F.round(F.try_divide(F.col("tp").cast("double"), n.cast("double")), 6)).withColumn(f"{name}_low", F.round(low, 6)).withColumn(f"{name}_high", F.round(high, 6))
    return out


def latest_complete(reports: DataFrame, key: list[str], period: str, order: list[Column], complete: Column) -> DataFrame:
    """The latest revision of each key and period, of periods in which every key's latest is complete."""
    w = Window.partitionBy(*key, period).orderBy(*order)
    last = reports.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    whole = last.groupBy(period).agg(F.min(complete.cast("int")).alias("ok")).where("ok = 1").select(period)
    return last.join(whole, period, "left_semi")
