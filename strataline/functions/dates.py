"""Dates, windows and labels.  Native columns; `now` is always given."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written forms of a date, tried in this order (US before European).
FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "d/M/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "M-d-yyyy", "d.M.yyyy")
YEARLESS = ("MMM d", "MMMM d", "d MMM", "M/d")
FUTURE_DAYS = 45


def parse_date(text: Column, today: date) -> Column:
    """A written date; one without a year is the latest such day not over 45 days ahead."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    full = F.coalesce(*[F.to_date(F.try_to_timestamp(bare, F.lit(f))) for f in FORMATS])
    this = F.coalesce(*[F.to_date(F.try_to_timestamp(F.concat(bare, F.lit(f" {today.year}")), F.lit(f"{f} yyyy"))) for f in YEARLESS])
    last = F.coalesce(*[F.to_date(F.try_to_timestamp(F.concat(bare, F.lit(f" {today.year - 1}")), F.lit(f"{f} yyyy"))) for f in YEARLESS])
    return F.coalesce(full, F.when(this <= F.date_add(F.lit(today), FUTURE_DAYS), this), last)


def relative_day(label: Column, today: Column) -> Column:
    """The day of "Posted Today", "Posted Yesterday", "Posted 3 Days Ago"; "30+ Days Ago" is open-ended and null."""
    low = F.lower(F.coalesce(label, F.lit("")))
    n = F.regexp_extract(low, r"(\d+)\s+days?\s+ago", 1).try_cast("int")
    return F.when(low.contains("today"), today).when(low.contains("yesterday"), F.date_sub(today, 1)).when(low.rlike(r"\d+\+\s*days?"), None).otherwise(F.date_sub(today, n))


def settled_day(stored: Column, read: Column) -> Column:
    """The stored day where a new reading is within one day of it, else the reading."""
    return F.when(F.abs(F.datediff(stored, read)) <= 1, stored).otherwise(F.coalesce(read, stored))


def age_days(moment: Column, now: Column) -> Column:
    """Whole days since a moment, never below 0; null for none."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("long") + F.when(moment.isNull(), None).otherwise(0)


def quarter_hour(moment: Column) -> Column:
    """Start of the quarter of an hour that holds the moment."""
    return F.window(moment, "15 minutes")["start"]


def local_day(moment: Column, zone: str) -> Column:
    """Calendar day of a UTC moment in a zone."""
    return F.to_date(F.from_utc_timestamp(moment.cast("timestamp"), zone))


def day_start(day: Column, zone: str) -> Column:
    """The UTC moment at which a day begins in a zone; days of 23 and 25 hours come out right."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def pull_state(last_success: Column, now: Column) -> Column:
    """live within 15 minutes, delayed within 45, else stalled; unknown for none."""
    minutes = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last_success.cast("timestamp"))) / 60
    return F.when(last_success.isNull(), "unknown").when(minutes <= 15, "live").when(minutes <= 45, "delayed").otherwise("stalled")


def pull_outcome(qualifying: Column, discovered: Column) -> Column:
    return F.when(qualifying > 0, "opportunities").when(discovered > 0, "new_postings").otherwise("quiet")


def plan_label(seconds: Column) -> Column:
    """An interval in words."""
    minutes = F.bround(seconds / 60).cast("long")
    hours = F.bround(seconds / 3600).cast("long")
    return F.when(seconds < 3600, F.concat(F.lit("every "), minutes.cast("string"), F.lit(" minutes"))).when(hours == 1, "every hour").otherwise(F.concat(F.lit("every "), hours.cast("string"), F.lit(" hours")))


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent, null when there was nothing before."""
    return F.when(before != 0, F.bround(100.0 * (now - before) / before, 2))
