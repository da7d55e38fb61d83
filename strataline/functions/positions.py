"""Places of patterns in a text, and what stands around them.  Native columns.

Many patterns are looked for in one text by their needles: a needle is a plain
text of which every match of a pattern holds one, so a substring test keeps
nearly all regular expressions from running, however many there are.

A place is where a match starts and ends, in code points, end exclusive.
Windows around a place are cut out of the text, so that what lies beyond them
can't be met; among headers before a place the last one counts.

Defined cases: a null text has no places (an empty array); a window reaches no
further than the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<start:int,end:int,hit:string>>"


def flags(pattern: str, capitals: bool = False) -> str:
    """The pattern without regard to case (unless `capitals`), in Unicode's sense of letters, digits and blanks."""
    return f"(?{'U' if capitals else 'iU'}){pattern}"


def any_of(patterns: Iterable[str]) -> str:
    """One pattern that is found where any of them is."""
    return "(?:" + "|".join(patterns) + ")"


def folded(text: Column) -> Column:
    """The text in lower case, with the letters that match i and s without regard to case as these."""
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("ı")) | F.contains(text, F.lit("ſ"))
    return F.lower(F.when(odd, F.translate(text, "İıſ", "iis")).otherwise(text))


@dataclass(frozen=True)
class Text:
    """A text beside its folded form."""

    text: Column
    low: Column

    @staticmethod
    def of(text: Column) -> Text:
        return Text(text, folded(text))


def _weight(needles: frozenset[str]) -> tuple[int, int]:
    return min(map(len, needles)), -len(needles)


def _needles(tokens: Sequence) -> frozenset[str] | None:
    """Of a parsed pattern: texts of which every match holds one, the longest to be had; None if there are none."""
    best: frozenset[str] | None = None
    run = ""
    for kind, what in [*tokens, (None, None)]:
        name = str(kind)
        if name == "LITERAL":
            run += chr(what).lower()
            continue
        inner = None
        if name == "SUBPATTERN":
            inner = _needles(what[-1])
        elif name == "BRANCH":
            each = [_needles(x) for x in what[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and what[0] > 0:
            inner = _needles(what[2])
        for new in (frozenset([run]) if run else None, inner):
            if new and (best is None or _weight(new) > _weight(best)):
                best = new
        run = ""
    return best


def needles(pattern: str) -> tuple[str, ...]:
    """Plain texts, in lower case, of which every match of the pattern holds one; empty if that can't be told."""
    return tuple(sorted(_needles(re._parser.parse(pattern)) or ()))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table(patterns: Iterable[str], capitals: bool = False) -> Column:
    """The patterns as rows (n: needles, p: pattern) of a constant array, which the optimizer folds into one value."""
    rows = [f"named_struct('n', array({', '.join(map(_quoted, needles(p) or ('',)))}), 'p', {_quoted(flags(p, capitals))})" for p in patterns]
    return F.expr(f"array({', '.join(rows)})")


def held(low: Column, row: Column) -> Column:
    """Whether a folded text holds a needle of a row of table()."""
    return F.exists(row["n"], lambda n: F.contains(low, n))


def holds(low: Column, words: Sequence[str]) -> Column:
    """Whether a folded text holds any of the words."""
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words])


def found(text: Column | Text, patterns: Iterable[str] | str, capitals: bool = False, words: Sequence[str] = ()) -> Column:
    """Whether any of the patterns is found; false for a null text.

    In a Text each pattern is tried only where its needle is, and none where
    none of `words` is, one of which every match has to hold.
    """
    told = [patterns] if isinstance(patterns, str) else list(patterns)
    if isinstance(text, Text):
        if words and not hold_one(told, words):
            raise ValueError(f"matches without {words}")
        some = F.exists(table(told, capitals), lambda r: held(text.low, r) & F.rlike(text.text, r["p"]))
        return F.coalesce(holds(text.low, words) & some if words else some, F.lit(False))
    return F.coalesce(text.rlike(flags(any_of(told), capitals)), F.lit(False))


def how_many(text: Text, patterns: Iterable[str]) -> Column:
    """How many of the patterns are found."""
    return F.size(F.filter(table(patterns), lambda r: held(text.low, r) & F.rlike(text.text, r["p"])))


def places(text: Column, pattern: Column | str) -> Column:
    """Where the pattern matches, leftmost and without overlap: array of (start, end, hit).

    What is between matches comes from split(), so the lengths of both, added
    up, place each match.
    """
    pattern = F.lit(flags(pattern)) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["hit"]), F.lit(0))
        own = F.struct(start.alias("start"), end.alias("end"), z["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(z["hit"].isNotNull(), F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(PLACE)
    placed = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, pattern), placed).otherwise(none)


#: Longest runs of blanks (and marks between words) and of a word's signs that reach() reckons with; where a window has a longer one, the whole text is searched.
BLANKS, SIGNS = 8, 40
_LONG = rf"(?U)[\s,:\-]{{{BLANKS + 1}}}|[\w/+#.\-]{{{SIGNS + 1}}}"


def _run(tokens: Sequence) -> int:
    """Longest run of a class of characters without a bound of its own."""
    (kind, what), *more = tokens
    told = {(str(k), str(v)) for k, v in (what if str(kind) == "IN" else [(kind, what)])}
    if more or str(kind) not in ("IN", "LITERAL"):
        raise ValueError(f"no bound for repeats of {tokens}")
    if told <= {("CATEGORY", "CATEGORY_SPACE"), *[("LITERAL", str(ord(c))) for c in ",:-"]}:
        return BLANKS
    signs = {("CATEGORY", "CATEGORY_WORD"), ("CATEGORY", "CATEGORY_DIGIT"), *[("LITERAL", str(ord(c))) for c in "/+#.-"]}
    if not told <= signs:
        raise ValueError(f"no bound for repeats of {tokens}")
    return SIGNS


def _reach(tokens: Sequence) -> int:
    out = 0
    for kind, what in tokens:
        name = str(kind)
        if name == "SUBPATTERN":
            out += _reach(what[-1])
        elif name == "BRANCH":
            out += max(map(_reach, what[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            out += _run(what[2]) if what[1] == re._constants.MAXREPEAT else what[1] * _reach(what[2])
        elif name in ("ASSERT", "ASSERT_NOT"):
            out += _reach(what[1])
        elif name == "AT":
            out += 1
        elif name in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY"):
            out += 1
        else:
            raise ValueError(f"no bound for {name}")
    return out


def reach(patterns: Iterable[str]) -> int:
    """Most code points that a match of any of the patterns, with what it looks at, can have while no run is longer than BLANKS or SIGNS."""
    return max(_reach(re._parser.parse(p)) for p in patterns)


def _holds_one(tokens: Sequence, needles: Sequence[str], ahead: str = "") -> bool:
    """Whether what is matched, with the plain text ahead of it, is sure to hold a needle; the parser takes common heads out of branches."""
    run = ahead
    for kind, what in [*tokens, (None, None)]:
        name = str(kind)
        if name == "LITERAL":
            run += chr(what).lower()
            continue
        if any(n in run for n in needles):
            return True
        if name == "SUBPATTERN" and _holds_one(what[-1], needles, run) or name == "BRANCH" and all(_holds_one(x, needles, run) for x in what[1]):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT") and what[0] > 0 and _holds_one(what[2], needles):
            return True
        run = ""
    return False


def hold_one(patterns: Iterable[str], needles: Sequence[str]) -> bool:
    """Whether every match of each pattern is sure to hold one of the needles."""
    return all(_holds_one(re._parser.parse(p), needles) for p in patterns)


def near(text: Text, needles: Sequence[str], patterns: Sequence[str]) -> Column:
    """Windows of a text in which all matches of the patterns lie: array of (at, part, low), in order and apart from each other.

    Each match holds one of the needles, which are looked for in the folded
    text, and reaches no further from it than reach() tells.  If a window has a
    longer run than that reckons with, the whole text is the window.
    """
    if not hold_one(patterns, needles):
        raise ValueError(f"matches without {needles}")
    most = reach(patterns) + max(map(len, needles)) + 1
    # each piece but the first begins with a needle
    pieces = F.split(F.concat(F.lit("\n"), text.low), "(?=" + "|".join(map(re.escape, needles)) + ")", -1)

    def step(acc: Column, piece: Column) -> Column:
        begin, end = acc["at"] - most, acc["at"] + most
        apart = begin > acc["end"]
        own = F.struct(acc["start"].alias("start"), acc["end"].alias("end"))
        # a window is put away once the next one is apart from it, so the array grows by windows, not by needles
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"),
            F.when(apart, begin).otherwise(acc["start"]).alias("start"),
            end.alias("end"),
            F.when(apart & (acc["end"] >= 0), F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"),
        )

    spans = F.array().cast("array<struct<start:int,end:int>>")
    far = F.lit(-(1 << 30))
    zero = lambda ps: F.struct((F.length(F.get(ps, F.lit(0))) - 1).alias("at"), F.lit(0).alias("start"), far.alias("end"), spans.alias("out"))
    told = lambda ps: F.aggregate(F.slice(ps, F.lit(2), F.size(ps)), zero(ps), step, lambda a: F.array_append(a["out"], F.struct(a["start"].alias("start"), a["end"].alias("end"))))
    cut = lambda start, end: F.struct(start.alias("at"), F.substring(text.text, start + 1, end - start).alias("part"), F.substring(text.low, start + 1, end - start).alias("low"))
    whole = F.array(F.struct(F.lit(0).alias("at"), text.text.alias("part"), text.low.alias("low")))
    windows = lambda ps: F.transform(told(ps), lambda w: cut(F.greatest(w["start"], F.lit(0)), w["end"]))
    checked = lambda ws: F.when(F.exists(ws, lambda w: F.rlike(w["part"], F.lit(_LONG))), whole).otherwise(ws)
    bind = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    none = F.array().cast("array<struct<at:int,part:string,low:string>>")
    # a plain search is far cheaper than splitting, and finds nothing in most texts
    return F.when(holds(text.low, needles), bind(pieces, lambda ps: F.when(F.size(ps) > 1, bind(windows(ps), checked)).otherwise(none))).otherwise(none)


def places_near(windows: Column, patterns: Iterable[str]) -> Column:
    """Places in the text of each pattern's matches within the windows of near()."""

    def within(w: Column) -> Column:
        each = F.flatten(F.transform(F.filter(table(patterns), lambda r: held(w["low"], r)), lambda r: places(w["part"], r["p"])))
        return F.transform(each, lambda p: F.struct((p["start"] + w["at"]).alias("start"), (p["end"] + w["at"]).alias("end"), p["hit"].alias("hit")))

    patterns = list(patterns)
    return F.flatten(F.transform(windows, within))


def places_of_each(text: Text, patterns: Iterable[str]) -> Column:
    """Places of each pattern by itself, so that matches of different patterns may overlap."""
    return F.flatten(F.transform(F.filter(table(patterns), lambda r: held(text.low, r)), lambda r: places(text.text, r["p"])))


def before(text: Column, at: Column, most: int) -> Column:
    """Up to `most` code points ahead of a place."""
    return F.substring(text, F.greatest(at - most, F.lit(0)) + 1, F.least(at, F.lit(most)))


def after(text: Column, at: Column, most: int) -> Column:
    """Up to `most` code points from a place on."""
    return F.substring(text, at + 1, F.lit(most))


def around(text: Column, start: Column, end: Column, most: int) -> Column:
    """A match with up to `most` code points to each side."""
    return F.substring(text, F.greatest(start - most, F.lit(0)) + 1, F.least(start, F.lit(most)) + end - start + most)


def once(text: Column, then) -> Column:
    """then(Text), with the text and its folded form computed once."""
    return F.get(F.transform(F.array(F.struct(text.alias("text"), folded(text).alias("low"))), lambda t: then(Text(t["text"], t["low"]))), F.lit(0))


def last_is(window: Column, patterns: Iterable[str], others: Iterable[str]) -> Column:
    """Whether the last header in the window is one of `patterns`; an other one within such a header doesn't count."""
    told, rest = list(patterns), list(others)
    after_last = lambda t: F.regexp_extract(t.text, flags(rf"(?s)\A.*{any_of(told)}(.*)\z"), 1)
    return once(window, lambda t: found(t, told) & ~found(after_last(t), rest))
