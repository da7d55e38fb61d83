"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def need(df: DataFrame, *names: str) -> DataFrame:
    """`df` with just these columns; every other column, whatever its name, is left out before any new name is made."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: Column) -> Column:
    """128 bits of a text as a string: with an id it tells rows apart whose ids clash."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def bound(value: Column, then) -> Column:
    """then(value), with `value` computed once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def chunked(items: Column) -> Column:
    """The items of an array in runs of about the root of its size: array of arrays."""
    wide = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1)).cast("int")
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / n) - 1, F.lit(0)).cast("int")), lambda i: F.slice(items, i * n + 1, n))
    return bound(wide, cut)


def spans_of(text: Column, pattern: str, keep, context: int = 0) -> Column:
    """Where `pattern` matches, leftmost and without overlap: array of (start, end, hit, before), code points, end exclusive.

    `before` is the text of up to `context` code points ahead of the match.

    The text between matches comes from split(), the matches from
    regexp_extract_all(); sums of their lengths place each match, first within
    runs of about the root of their number and then over the runs, as an array
    that grows by one is copied each time: n matches cost n ** 1.5 steps.
    keep(hit) drops matches afterwards; a dropped one still uses up its text.
    Native expressions only.
    """
    fields = "start:int,end:int,hit:string"
    empty = F.array().cast(f"array<struct<{fields}>>")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, z: Column) -> Column:
        start = acc["pos"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["hit"]), F.lit(0))
        hit = F.struct(start.alias("start"), end.alias("end"), z["hit"].alias("hit"))
        return F.struct(
            end.alias("pos"),
            F.when(z["hit"].isNotNull() & keep(z["hit"]), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"),
        )

    def moved(run: Column, by: Column) -> Column:
        # a piece of the text that holds the run and its context: a place in it is found by reading it from its start
        lead = F.least(by, F.lit(context))
        piece = text.substr(by - lead + 1, run["pos"] + lead)
        ahead = lambda p, s: p.substr(F.greatest(s["start"] + lead - context, F.lit(0)) + 1, F.least(s["start"] + lead, F.lit(context)))
        said = lambda p, s: ahead(p, s) if context else F.lit("")
        return bound(piece, lambda p: F.transform(run["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["hit"].alias("hit"), said(p, s).alias("before"))))

    def placed(runs: Column) -> Column:
        ahead = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["pos"])))
        return bound(ahead, lambda a: F.flatten(F.transform(runs, lambda r, i: moved(r, F.get(a, i)))))

    within = lambda runs: F.transform(runs, lambda run: F.aggregate(run, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step))
    found = bound(zipped, lambda z: bound(within(chunked(z)), placed))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<struct<{fields},before:string>>"))


def without_overlap(spans: Column, others: Column, meets=None) -> Column:
    """The spans (start, end, ...) that overlap none of `others`, or for which meets(span, other) holds for none that they overlap.

    The others are put into runs in order of their starts, and a span is held
    against a run's bounds before its members.
    """
    meets = meets or (lambda s, o: F.lit(True))
    whole = lambda run: F.struct(F.array_min(F.transform(run, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(run, lambda s: s["end"])).alias("hi"), run.alias("own"))
    over = lambda s, lo, hi: (lo < s["end"]) & (s["start"] < hi)
    met = lambda s, runs: F.exists(runs, lambda r: over(s, r["lo"], r["hi"]) & F.exists(r["own"], lambda o: over(s, o["start"], o["end"]) & meets(s, o)))
    kept = lambda o: bound(F.transform(chunked(F.array_sort(o)), whole), lambda runs: F.filter(spans, lambda s: ~met(s, runs)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), bound(others, kept)).otherwise(spans)
