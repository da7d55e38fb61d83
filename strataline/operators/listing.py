"""The faceted listing: filters, named sorts, pages, counts, tiles and facets.

A listing runs over postings: one row each, already joined with evaluation,
score and mark.  `Names` says which columns play which part, so the same code
serves any table of that shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score bands and page limits.
HIGH, MEDIUM = 70, 45
PAGE, MOST_PAGE, MOST_SORTS = 50, 200, 3
#: Fixed value: years of experience from which a posting is out of band.
BAND_YEARS = 4


@dataclass(frozen=True)
class Names:
    id: str = "id"
    company: str = "company"
    title: str = "title"
    location: str = "location"
    status: str = "status"
    family: str = "family"
    priority: str = "priority"
    source: str = "source"
    tier: str = "tier"
    score: str = "score"
    active: str = "is_active"
    posted: str = "posted_at"
    seen: str = "first_seen_at"
    saved: str = "is_saved"
    review: str = "review_state"
    applied: str = "applied_at"
    verified: str = "requirements_verified"
    early: str = "is_early_career"
    new_grad: str = "is_new_grad"
    years: str = "required_experience_years"


@dataclass(frozen=True)
class Filters:
    """What a listing asks for; an empty field asks nothing.  All that is asked must hold."""

    statuses: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    priorities: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    ids: tuple[int, ...] = ()
    not_companies: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    named_tiers: tuple[str, ...] = ()
    active_only: bool = False
    view: str = ""
    seen_after: datetime | None = None
    detected_since: datetime | None = None
    posted_since: datetime | None = None
    verified: bool = False
    early: bool = False
    new_grad: bool = False
    in_band: bool = False
    text: str = ""
    least_score: float | None = None
    sorts: tuple[str, ...] = ()
    limit: int = PAGE
    offset: int = 0
    extra: tuple[Column, ...] = field(default=())


def like_literal(text: str) -> str:
    """`text` with the LIKE signs escaped by a backslash."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def every_word(columns: list[Column], text: str) -> Column:
    """Each word of `text` is found, whatever its case, in one of the columns; signs stand for themselves."""
    words = [w.lower() for w in text.split()]
    each = [reduce(Column.__or__, [F.coalesce(F.lower(c).contains(F.lit(w)), F.lit(False)) for c in columns]) for w in words]
    return reduce(Column.__and__, each, F.lit(True))


def in_band(early: Column, years: Column, most: int = BAND_YEARS) -> Column:
    """Early career, or years known and below the limit; unknown years fail."""
    return F.coalesce(early | (years < most), F.lit(False))


def predicates(f: Filters, n: Names) -> list[Column]:
    c = lambda name: F.col(f"`{name}`")
    out: list[Column] = list(f.extra)
    # a mark view lists what is marked, whatever became of it
    if not f.view:
        if f.active_only:
            out.append(c(n.active))
        if f.statuses:
            out.append(c(n.status).isin(*f.statuses))
    for values, name in ((f.families, n.family), (f.priorities, n.priority), (f.companies, n.company), (f.sources, n.source), (f.ids, n.id)):
        if values:
            out.append(c(name).isin(*values))
    if names := [x.strip().lower() for x in f.not_companies if x.strip()]:
        out.append(~F.lower(c(n.company)).isin(*names))
    if f.tiers:
        named = c(n.tier).isin(*[t for t in f.tiers if t != "OTHER"]) if set(f.tiers) - {"OTHER"} else F.lit(False)
        out.append(named | ~c(n.tier).isin(*f.named_tiers) if "OTHER" in f.tiers else named)
    if f.view:
        views = {"saved": c(n.saved), "archived": c(n.review) == "archived", "applied": c(n.applied).isNotNull()} if f.view in ("saved", "archived", "applied") else {}
        out.append(F.coalesce(views[f.view], F.lit(False)))
    if f.seen_after is not None:
        out.append(c(n.seen) > F.lit(f.seen_after))
    if f.detected_since is not None:
        out.append(c(n.seen) >= F.lit(f.detected_since))
    if f.posted_since is not None:
        out.append(c(n.posted) >= F.lit(f.posted_since))
    for asked, name in ((f.verified, n.verified), (f.early, n.early), (f.new_grad, n.new_grad)):
        if asked:
            out.append(c(name))
    if f.in_band:
        out.append(in_band(c(n.early), c(n.years)))
    if f.text:
        pattern = f"%{f.text}%"
        out.append(c(n.title).ilike(pattern) | c(n.company).ilike(pattern) | c(n.location).ilike(pattern))
    if f.least_score is not None:
        out.append(c(n.score) >= f.least_score)
    return out


def apply(df: DataFrame, f: Filters, n: Names = Names()) -> DataFrame:
    return reduce(DataFrame.where, predicates(f, n), df)


def sort_columns(names: tuple[str, ...], n: Names) -> list[Column]:
    """The ORDER BY of up to three named sorts; unknown names are left out, and the id settles every tie."""
    c = lambda name: F.col(f"`{name}`")
    have = lambda x: F.when(x, 0).otherwise(1)
    known = {
        "unapplied_first": lambda: [F.when(c(n.applied).isNotNull(), 1).otherwise(0).asc()],
        "best_match": lambda: [c(n.score).desc_nulls_last()],
        "experience_fit_first": lambda: [F.when(in_band(c(n.early), c(n.years)) & c(n.verified), 0).when(in_band(c(n.early), c(n.years)), 1).otherwise(2).asc()],
        "new_grad_first": lambda: [have(c(n.new_grad)), have(c(n.verified)), have(c(n.early))],
        "big_tech_first": lambda: [tier_rank(c(n.tier)).asc()],
        "newest": lambda: [c(n.seen).desc_nulls_last()],
        "oldest": lambda: [c(n.seen).asc_nulls_last()],
        "recently_posted": lambda: [c(n.posted).desc_nulls_last()],
        "company": lambda: [c(n.company).asc_nulls_last(), c(n.title).asc_nulls_last()],
        "title": lambda: [c(n.title).asc_nulls_last(), c(n.company).asc_nulls_last()],
    }
    chosen = [x for x in dict.fromkeys(names) if x in known][:MOST_SORTS]
    return [col for x in chosen for col in known[x]()] + [c(n.seen).desc_nulls_last(), c(n.id).desc_nulls_last()]


#: Order of the company tiers.
TIER_ORDER = ("BIG_TECH", "TOP_TIER", "ESTABLISHED")


def tier_rank(tier: Column, order: tuple[str, ...] = TIER_ORDER) -> Column:
    return F.coalesce(*[F.when(tier == t, F.lit(i)) for i, t in enumerate(order)], F.lit(len(order)))


def page(df: DataFrame, f: Filters, n: Names = Names()) -> DataFrame:
    """One page of the listing; the limit is held to 1..200 and the offset to 0 and more."""
    limit, offset = min(max(f.limit, 1), MOST_PAGE), max(f.offset, 0)
    return apply(df, f, n).orderBy(*sort_columns(f.sorts, n)).offset(offset).limit(limit)


def keyset_page(df: DataFrame, column: str, before, limit: int = 100) -> DataFrame:
    """The newest rows before a moment: each page starts where the last ended."""
    held = df if before is None else df.where(F.col(column) < F.lit(before))
    return held.orderBy(F.col(column).desc()).limit(min(max(limit, 1), 100))


def total(df: DataFrame, f: Filters, n: Names = Names()) -> DataFrame:
    return apply(df, f, n).agg(F.count("*").alias("total"))


def facet(df: DataFrame, f: Filters, dimension: str, clear: str, n: Names = Names()) -> DataFrame:
    """value, n: rows for each value with that dimension's own filter cleared, most first."""
    own = replace(f, **{clear: ()})
    return apply(df, own, n).groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def all_facets(df: DataFrame, f: Filters, dimensions: dict[str, str], n: Names = Names()) -> DataFrame:
    """dimension, value, n for several dimensions in one pass over the rows.

    `dimensions` maps a column to the filter field that is cleared for it.  A
    row is counted for a dimension if every other filter holds, so each row is
    tested once and exploded to the dimensions it counts for.
    """
    fields = set(dimensions.values())
    others = predicates(replace(f, **{k: () for k in fields}), n)
    of = {k: reduce(Column.__and__, predicates(replace(Filters(named_tiers=f.named_tiers), **{k: getattr(f, k)}), n), F.lit(True)) for k in fields}
    base = reduce(DataFrame.where, others, df)
    entries = [F.when(reduce(Column.__and__, [of[k] for k in fields if k != own], F.lit(True)), F.struct(F.lit(col).alias("dimension"), F.col(col).cast("string").alias("value"))) for col, own in dimensions.items()]
    rows = base.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def tiles(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Several conditional counts in one pass."""
    return df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in counts.items()])


def score_bands(df: DataFrame, score: str, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """high, medium, low, unscored: unscored is what the total leaves, never below 0."""
    s = F.col(score)
    rows = df.agg(F.count("*").alias("total"), F.count_if(s >= high).alias("high"), F.count_if((s >= medium) & (s < high)).alias("medium"), F.count_if(s < medium).alias("low"))
    return rows.select("high", "medium", "low", F.greatest(F.lit(0), F.col("total") - F.col("high") - F.col("medium") - F.col("low")).cast("long").alias("unscored"))


def parse_sort(text: str | None) -> tuple[str, ...]:
    """Sort names of a comma list, each once, at most three."""
    return tuple(dict.fromkeys(x.strip() for x in (text or "").split(",") if x.strip()))[:MOST_SORTS]
