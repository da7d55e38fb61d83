"""Postings that pages carry as data of their scripts, without a schema: read as VARIANT, by path.

Two boards: one whose rows are lists, in which only the position says what a
value is, and one whose data is JSON within a string of JSON.  A value of
another kind than is expected is null, never an error; what can't be read at
all, page or row, is kept apart with its reason.

Defined cases: a null page, or one without the script, is broken; a row without
an id or a title is broken, and its neighbours are read; an empty list of rows
is no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.sources.readers import canonical

#: What surrounds the data in a page, and addresses of postings.
LIST_DATA = r"(?s)AF_initDataCallback\(\{[^{}]*?key:\s*['\"]ds:1['\"].*?data:(\[.*?\]), sideChannel:.*?\}\);</script>"
LIST_POSTING = "https://www.google.com/about/careers/applications/jobs/results/"
STRING_DATA = r'(?s)window\.__staticRouterHydrationData\s*=\s*JSON\.parse\(("(?:[^"\\]|\\.)*+")\);'
STRING_POSTING = "https://jobs.apple.com/en-us/details/"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _said(v: Column, path: str) -> Column:
    """A text or number at a path as text; null if a list or an object stands there."""
    return F.when(~F.schema_of_variant(_get(v, path, "variant")).rlike("^(?:ARRAY|OBJECT)"), _get(v, path))


def _line(text: Column) -> Column:
    """A text with single blanks; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _parted(pages: DataFrame, data: Column, rows_at: str, url: str) -> tuple[DataFrame, DataFrame]:
    """page, r (VARIANT) of every row, and page, reason of pages without rows that can be read."""
    read = pages.select(F.col(url).alias("page"), data.alias("data")).select("page", F.try_parse_json(F.nullif("data", F.lit(""))).alias("v"), (F.coalesce("data", F.lit("")) == "").alias("none"))
    held = read.select("page", "none", "v", _get(F.col("v"), rows_at, "array<variant>").alias("rows"))
    reason = F.when(F.col("none"), "no data").when(F.col("v").isNull(), "not JSON").when(F.col("rows").isNull(), "no rows")
    return held.select("page", F.explode("rows").alias("r")), held.select("page", reason.alias("reason")).where("reason is not null")


def _kept_apart(rows: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a title as canonical rows, and what is broken."""
    bad = F.col("external_id").isNull() | F.col("title").isNull()
    reason = F.when(F.col("external_id").isNull(), "row without an id").otherwise("row without a title")
    return canonical(rows.where(~bad)), broken.unionByName(rows.where(bad).select("page", reason.alias("reason")))


def read_positional(pages: DataFrame, html: str = "html", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Canonical rows of result pages whose rows are lists, and broken parts (page, reason)."""
    rows, broken = _parted(pages, F.regexp_extract(html, LIST_DATA, 1), "$[0]", url)
    r = F.col("r")
    title = _line(_said(r, "$[1]"))
    number = _line(_said(r, "$[0]"))
    places = F.transform(_get(r, "$[9]", "array<variant>"), lambda p: _line(_said(p, "$[0]")))
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    when = lambda i: F.timestamp_seconds(_get(r, f"$[{i}][0]", "bigint"))
    told = rows.select(
        "page", F.lit("google").alias("source"), F.coalesce(_line(_said(r, "$[7]")), F.lit("Google")).alias("company"), number.alias("external_id"), number.alias("requisition_id"), title.alias("title"),
        F.coalesce(F.nullif(F.array_join(places, "; "), F.lit("")), F.lit("United States")).alias("location"),
        F.concat_ws("\n\n", *[_said(r, f"$[{i}][1]") for i in (10, 3, 4)]).alias("description"),
        F.concat(F.lit(LIST_POSTING), number, F.lit("-"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("role"))).alias("official_url"), when(12).alias("posted_at"), when(14).alias("updated_at"),
    )
    return _kept_apart(told, broken)


def read_stringed(pages: DataFrame, html: str = "html", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Canonical rows of search pages whose data is JSON in a string of JSON, and broken parts (page, reason)."""
    text = _get(F.try_parse_json(F.nullif(F.regexp_extract(html, STRING_DATA, 1), F.lit(""))), "$")
    rows, broken = _parted(pages, text, "$.loaderData.search.searchResults", url)
    r = F.col("r")
    number = _line(_said(r, "$.positionId"))
    names = F.transform(_get(r, "$.locations", "array<variant>"), lambda p: F.concat(_line(_said(p, "$.name")), F.lit(", United States")))
    home = F.when(F.coalesce(_get(r, "$.homeOffice", "boolean"), F.lit(False)), F.array(F.lit("Remote, United States"))).otherwise(F.array().cast("array<string>"))
    told = rows.select(
        "page", F.lit("apple").alias("source"), F.lit("Apple").alias("company"), number.alias("external_id"), number.alias("requisition_id"), _line(_said(r, "$.postingTitle")).alias("title"),
        F.array_join(F.concat(F.array_compact(F.coalesce(names, F.array().cast("array<string>"))), home), "; ").alias("location"), _said(r, "$.jobSummary").alias("description"),
        F.concat(F.lit(STRING_POSTING), number, F.lit("/"), F.coalesce(_said(r, "$.transformedPostingTitle"), F.lit(""))).alias("official_url"), F.try_to_timestamp(_said(r, "$.postDateInGMT")).alias("posted_at"),
    )
    return _kept_apart(told, broken)
