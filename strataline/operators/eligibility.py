"""Role families, years of experience, citizenship demands and the eligibility gate.  Native columns.

Rules are rows: a number, an outcome, where to look, what has to be found and
what must not.  A family is the outcome of the first rule that holds, the
gate's codes are the outcomes of all of them, in order.  Patterns are in
`rules`.

A pattern runs only on texts that hold one of its needles (see positions), so
the cost of a text hardly grows with the number of rules.

Defined cases: null titles, descriptions and places count as empty; an empty
description states nothing, and is noted as not verified; an empty place is
outside the country; a null employment type says nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataline.functions import places
from strataline.functions.positions import Text, after, around, flags, folded, found, held, how_many, last_is, near, once, places_near, table
from strataline.functions.positions import places as places_of
from strataline.operators import rules


@dataclass(frozen=True)
class Rule:
    """`outcome` if `says` is found in the text named `on`, and `unless` is not, and `given` (a name of a condition) holds; whatever is said holds one of `words`."""

    number: int
    outcome: str
    on: str = ""
    says: Iterable[str] = ()
    unless: Iterable[str] = ()
    given: str = ""
    words: Sequence[str] = ()

    def holds(self, texts: dict[str, Text], conditions: dict[str, Column]) -> Column:
        out = conditions[self.given] if self.given else F.lit(True)
        if self.says:
            out = out & found(texts[self.on], self.says, words=self.words)
        if self.unless:
            out = out & ~found(texts[self.on], self.unless)
        return out


def first_outcome(told: Iterable[Rule], texts: dict[str, Text], conditions: dict[str, Column], other: str) -> Column:
    """The outcome of the rule with the least number that holds."""
    return F.coalesce(*[F.when(r.holds(texts, conditions), F.lit(r.outcome)) for r in sorted(told, key=lambda r: r.number)], F.lit(other))


def all_outcomes(told: Iterable[Rule], texts: dict[str, Text], conditions: dict[str, Column]) -> Column:
    """The outcomes of all rules that hold, by number."""
    return F.array_compact(F.array(*[F.when(r.holds(texts, conditions), F.lit(r.outcome)) for r in sorted(told, key=lambda r: r.number)]))


def bound(value: Column, then) -> Column:
    """then(value), with `value` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


# -- families

FAMILIES = (
    Rule(1, "OTHER", "singular", rules.STAFF_ELSEWHERE, (*rules.CORE_SOFTWARE, *rules.MACHINE_LEARNING, *rules.DATA_ENGINEERING, *rules.DATA_SCIENCE), "staff"),
    Rule(2, "OTHER", "plain", rules.OTHER_TRADES),
    Rule(3, "COMPILER_ENGINEERING", "singular", rules.COMPILERS),
    Rule(4, "RUNTIME_ENGINEERING", "singular", rules.RUNTIMES),
    Rule(5, "QUALITY_ASSURANCE", "singular", rules.TESTING),
    Rule(6, "FORWARD_DEPLOYED_ENGINEERING", "singular", rules.FORWARD_DEPLOYED),
    Rule(7, "SITE_RELIABILITY_ENGINEERING", "singular", rules.RELIABILITY),
    Rule(8, "AI_ML_ENGINEERING", "singular", rules.MACHINE_LEARNING),
    Rule(9, "AI_ML_ENGINEERING", "singular", rules.STAFF_LEARNING, given="staff"),
    Rule(10, "MOBILE_ENGINEERING", "singular", rules.MOBILE, rules.MOBILE_AND_MORE),
    Rule(11, "INFRASTRUCTURE_ENGINEERING", "singular", rules.DEVOPS),
    Rule(12, "INFRASTRUCTURE_ENGINEERING", "singular", rules.INFRASTRUCTURE, rules.CORE_SOFTWARE),
    Rule(13, "SOFTWARE_ENGINEERING", "singular", rules.SOFTWARE),
    Rule(14, "DATA_ENGINEERING", "occupation", rules.DATA_ENGINEERING),
    Rule(15, "DATA_SCIENCE", "occupation", rules.DATA_SCIENCE),
)
PRIMARY = ("SOFTWARE_ENGINEERING", "AI_ML_ENGINEERING")
SECONDARY = ("FORWARD_DEPLOYED_ENGINEERING", "DATA_ENGINEERING", "DATA_SCIENCE")
#: Families that are known and not wanted.
UNWANTED = ("SITE_RELIABILITY_ENGINEERING", "MOBILE_ENGINEERING", "INFRASTRUCTURE_ENGINEERING", "COMPILER_ENGINEERING", "RUNTIME_ENGINEERING", "QUALITY_ASSURANCE")

_STAFF = r"\bmember of technical staff\b"


def _singular(title: Column) -> Column:
    return F.regexp_replace(title, r"\b(engineer|developer|scientist|programmer)s\b", "$1")


def role_family(title: Column) -> Column:
    """The family of a title.  Nouns count in the singular; of technical staff, abbreviations are written out."""
    low = folded(F.coalesce(title, F.lit("")))
    staff = found(low, _STAFF)
    spelt = F.regexp_replace(F.regexp_replace(low, r"\beng\.?(?=\s|$|[),;])", "engineer"), r"\binfra\b", "infrastructure")

    def of(plain: Column) -> Column:
        occupation = F.get(F.split(plain, r"\s+-\s+(?:department|institute|school)\s+(?:of|for)\b", 2), F.lit(0))
        forms = F.struct(plain.alias("plain"), _singular(plain).alias("singular"), _singular(occupation).alias("occupation"), staff.alias("staff"))
        # a title that has been put in lower case is its own folded form
        return bound(forms, lambda t: first_outcome(FAMILIES, {c: Text(t[c], t[c]) for c in ("plain", "singular", "occupation")}, {"staff": t["staff"]}, "OTHER"))

    return bound(F.when(staff, spelt).otherwise(low), of)


def role_priority(family: Column) -> Column:
    return F.when(family.isin(*PRIMARY), "PRIMARY").when(family.isin(*SECONDARY), "SECONDARY").otherwise("NONE")


# -- years of experience

_UNIT = r"(?:years?|yrs?)"
#: Texts of which every figure holds one.
YEAR_WORDS = ("year", "yr")
_FLOOR = rf"(?<![\w-])(?:(?:at\s+least|(?:a\s+)?minimum(?:\s+of)?|no\s+less\s+than)\s+(?:{rules.WRITTEN_NUMBER}|\d{{1,2}})\s+{_UNIT}|(?:{rules.WRITTEN_NUMBER}|\d{{1,2}})\s+or\s+more\s+{_UNIT})\b"
#: What a figure looks like: a range, one with a noun after it, one with a noun before it, and a bare one with a plus.
RANGE = rf"\d{{1,2}}\s*(?:-|–|—|\s+to\s+)\s*\d{{1,2}}\s*{rules.PLUS}?\s*{_UNIT}\s+{rules.EXPERIENCE_CONTEXT}"
SINGLE = rf"\d{{1,2}}\s*{rules.PLUS}?\s*{_UNIT}\s+{rules.EXPERIENCE_CONTEXT}"
TRAILING = rf"(?:experience|expertise|background)[\s:]*[\(\[]?\s*(?:of\s+|at\s+least\s+)?\d{{1,2}}\s*{rules.PLUS}?\s*{_UNIT}"
BARE = rf"\d{{1,2}}\s*{rules.PLUS}\s*{_UNIT}\b"
#: Numbers as words, with their values.
_NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_NUMBERS |= {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_INSTEAD = flags(r"\b(?:may|can)\s+be\s+(?:considered|accepted)\s+(?:in\s+place\s+of|in\s+lieu\s+of)\s+(?:an?\s+)?(?:bachelor|master)(?:['’]?s)?\s+degree\b")

#: Code points after a figure that are cut out with it; most clauses end there.
CLAUSE_REACH = 2000
FIGURE = "struct<years:int,high:int,optional:boolean,open:boolean,read:boolean>"


def written_floors(whole: Text) -> Column:
    """struct(text, low): the text with minimums in words as digits: "at least five years" as "at least 5 years", "five or more years" as "5+ years"."""
    text, low, pattern = whole.text, whole.low, flags(_FLOOR)
    values = F.create_map(*[F.lit(x) for kv in _NUMBERS.items() for x in kv])

    def said(hit: Column) -> Column:
        words = F.lower(F.regexp_extract(hit, flags(rf"({rules.WRITTEN_NUMBER}|\d{{1,2}})\s+(?:or\s+more\s+)?{_UNIT}$"), 1))
        number = F.when(words.rlike(r"^\d"), words.cast("int")).otherwise(F.aggregate(F.split(words, r"[-\s]+"), F.lit(0), lambda n, w: n + F.coalesce(values[w], F.lit(0))))
        unit = F.regexp_extract(hit, flags(rf"({_UNIT})$"), 1)
        lead = F.regexp_extract(hit, flags(r"^(at\s+least|(?:a\s+)?minimum(?:\s+of)?|no\s+less\s+than)"), 1)
        return F.when(lead != "", F.concat_ws(" ", lead, number.cast("string"), unit)).otherwise(F.concat(number.cast("string"), F.lit("+ "), unit))

    def rewritten(part: Column) -> Column:
        return F.array_join(F.zip_with(F.split(part, pattern, -1), F.regexp_extract_all(part, F.lit(pattern), F.lit(0)), lambda gap, hit: F.concat(gap, F.coalesce(said(hit), F.lit("")))), "")

    def joined(windows: Column) -> Column:
        """The text with each window rewritten, and what is between them."""
        upto = F.transform(windows, lambda w: w["at"] + F.length(w["part"]))
        each = F.zip_with(windows, F.concat(F.array(F.lit(0)), upto), lambda w, end: F.when(w.isNotNull(), F.concat(F.substring(text, end + 1, w["at"] - end), rewritten(w["part"]))).otherwise(F.substring(text, end + 1, F.length(text))))
        return F.array_join(each, "")

    marked = low.contains("least") | low.contains("minimum") | low.contains("less") | low.contains("more")
    some = lambda ws: F.exists(ws, lambda w: F.rlike(w["part"], F.lit(pattern)))
    changed = lambda ws: bound(joined(ws), lambda new: F.struct(new.alias("text"), folded(new).alias("low")))
    same = F.struct(text.alias("text"), low.alias("low"))
    return F.when(marked, bound(near(whole, YEAR_WORDS, [_FLOOR]), lambda ws: F.when(some(ws), changed(ws)).otherwise(same))).otherwise(same)


def _around(text: Column, p: Column) -> Column:
    """A place's (start, hit) with what lies ahead of it and from it on, cut out of the text once: each cut costs the text up to there."""
    most = rules.SECTION_REACH
    cut = F.substring(text, F.greatest(p["start"] - most, F.lit(0)) + 1, F.least(p["start"], F.lit(most)) + F.length(p["hit"]) + CLAUSE_REACH)
    size = F.least(p["start"], F.lit(most))
    parts = lambda c: F.struct(p["start"].alias("start"), p["hit"].alias("hit"), F.substring(c, F.lit(1), size).alias("ahead"), F.substring(c, size + 1, F.length(p["hit"]) + CLAUSE_REACH).alias("rest"))
    return bound(cut, parts)


def _optional(text: Column, p: Column) -> Column:
    """Whether the last header before a figure, or its own clause, makes it optional."""

    def clause_ahead(ahead: Column) -> Column:
        for mark in ".;,\n":
            ahead = F.substring_index(ahead, mark, -1)
        return ahead

    # a clause that begins or ends beyond what was cut out is cut out of the whole text
    known = (p["start"] <= rules.SECTION_REACH) | p["ahead"].rlike(r"[.;,\n]")
    ahead = F.when(known, clause_ahead(p["ahead"])).otherwise(clause_ahead(F.substring(text, F.lit(1), p["start"])))
    ends = p["rest"].rlike(r"[.;,\n]") | (F.length(p["rest"]) < F.length(p["hit"]) + CLAUSE_REACH)
    rest = F.when(ends, p["rest"]).otherwise(F.substring(text, p["start"] + 1, F.length(text)))
    clause = F.lower(F.concat(ahead, F.regexp_extract(rest, r"\A([^.;,\n]*)", 1)))

    def has_word(c: Column) -> Column:
        words = F.lit(False)
        for w in rules.OPTIONAL_WORDS:
            words = words | c.contains(w)
        return words

    return last_is(p["ahead"], rules.PREFERRED_HEADERS, rules.REQUIRED_HEADERS) | bound(clause, has_word)


def _instead_of_degree(p: Column) -> Column:
    """Whether the figure is what may stand for a degree: the only one ahead of these words in its clause."""
    clause = F.regexp_extract(F.substring(p["rest"], F.lit(1), F.lit(250)), r"\A([^.;!?\n]*)", 1)
    figures = F.regexp_count(F.regexp_extract(clause, rf"(?s)\A(.*?){_INSTEAD}", 1), F.lit(flags(rf"(?<![\w-])(?:{rules.WRITTEN_NUMBER}|\d{{1,2}})\s*{rules.PLUS}?\s*{_UNIT}\b")))
    return clause.rlike(_INSTEAD) & (figures == 1)


def figures(description: Column | Text) -> Column:
    """Figures of experience: array of (years, high, optional, open, read).

    Ranges claim their text first and count by their low end; single figures
    that start within a range are no figures.  `high` is a range's upper end,
    `open` tells floors from bounds, and a bare figure outside of sections of
    qualifications is not `read` as a requirement.  Figures of a company, and
    those that stand for a degree, are left out.
    """

    def of(said: Text) -> Column:
        text = said.text
        number = lambda hit, n: F.get(F.regexp_extract_all(hit, F.lit(r"(\d{1,2})"), F.lit(1)), F.lit(n)).cast("int")
        last = lambda p, n: F.substring(p["ahead"], F.greatest(F.length(p["ahead"]) - n, F.lit(0)) + 1, F.lit(n))

        def claimed(windows: Column, ranges: Column) -> Column:
            first = F.transform(
                F.filter(F.transform(ranges, lambda p: _around(text, p)), lambda p: ~_instead_of_degree(p)),
                lambda p: F.struct(number(p["hit"], 0).alias("years"), number(p["hit"], 1).alias("high"), _optional(text, p).alias("optional"), F.lit(False).alias("open"), F.lit(True).alias("read")).cast(FIGURE),
            )
            outside = lambda ps: F.filter(ps, lambda p: ~F.exists(ranges, lambda r: (r["start"] <= p["start"]) & (p["start"] < r["end"])))
            cut = lambda patterns, read: F.transform(F.transform(outside(places_near(windows, patterns)), lambda p: _around(text, p)), lambda p: p.withField("read", read(p)))
            headed = lambda p: once(p["ahead"], lambda t: found(t, (*rules.REQUIRED_HEADERS, *rules.PREFERRED_HEADERS)))
            each = F.concat(cut((SINGLE, TRAILING), lambda p: F.lit(True)), cut((BARE,), headed))
            free = F.filter(each, lambda p: ~_instead_of_degree(p) & ~found(last(p, 90), rules.COLLECTIVE))

            def single(p: Column) -> Column:
                skip = F.length(F.regexp_extract(p["hit"], r"\A(\D*)", 1))
                end = skip + F.length(F.regexp_extract(p["hit"], r"(\d{1,2})", 1))
                # up to 26 code points ahead of the number itself
                whole = F.concat(last(p, 26), F.substring(p["hit"], F.lit(1), skip))
                ahead = F.substring(whole, F.greatest(F.length(whole) - 26, F.lit(0)) + 1, F.lit(26))
                is_open = lambda a: ~found(a, rules.CEILING) & (found(after(p["rest"], end, 22), rules.FLOOR_AFTER) | found(a, rules.FLOOR_BEFORE))
                return F.struct(number(p["hit"], 0).alias("years"), F.lit(None).cast("int").alias("high"), _optional(text, p).alias("optional"), bound(ahead, is_open).alias("open"), p["read"].alias("read")).cast(FIGURE)

            return F.concat(first, F.transform(free, single))

        return bound(near(said, YEAR_WORDS, (RANGE, SINGLE, TRAILING, BARE)), lambda ws: bound(places_near(ws, (RANGE,)), lambda ranges: claimed(ws, ranges)))

    def told(said: Text) -> Column:
        some = (said.low.contains("year") | said.low.contains("yr")) & said.low.rlike("(?<![a-z])(?:year|yr)")
        return F.when(some, bound(written_floors(said), lambda t: of(Text(t["text"], t["low"])))).otherwise(F.array().cast(f"array<{FIGURE}>"))

    return told(description) if isinstance(description, Text) else once(F.coalesce(description, F.lit("")), told)


def years_of(told: Column) -> Column:
    """struct(required, open, ceiling) of figures(): the most years required, else the most that are optional; the most of open floors; the highest end of a range."""
    most = lambda keep, what="years": F.array_max(F.transform(F.filter(told, keep), lambda f: f[what]))
    return F.struct(
        F.coalesce(most(lambda f: f["read"] & ~f["optional"]), most(lambda f: f["read"] & f["optional"])).alias("required"),
        most(lambda f: f["open"] & ~f["optional"]).alias("open"),
        most(lambda f: f["high"].isNotNull(), "high").alias("ceiling"),
    )


def required_years(description: Column) -> Column:
    """Years of experience asked for, null if none are."""
    return bound(figures(description), lambda told: years_of(told)["required"])


def title_years(title: Column) -> Column:
    """Years in a title such as "BS+10 yrs or MS+8": the least of alternatives, else the most; null without a unit."""
    pattern = flags(r"\b(?:bs|ms|ba|ma|bsc|msc)\s*\+\s*\d{1,2}\s*(?:years?|yrs?)?\b")
    hits = F.regexp_extract_all(title, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(title, pattern, -1), 2, F.greatest(F.size(hits) - 1, F.lit(0)))
    told = F.transform(hits, lambda h: F.regexp_extract(h, r"(\d{1,2})", 1).cast("int"))
    either = (F.size(hits) > 1) & F.forall(between, lambda g: found(g, r"\bor\b"))
    return F.when(F.exists(hits, lambda h: found(h, _UNIT)), F.when(either, F.array_min(told)).otherwise(F.array_max(told)))


# -- citizenship

DEMANDS = (*[p.replace(".", r"\.") for p in rules.CITIZEN_PHRASES], *rules.CITIZEN_PATTERNS)


#: Texts of which every demand holds one.
DEMAND_WORDS = ("citizen", "person", "itar", "export", "usc", "national")


def demands_citizenship(said: Text) -> Column:
    """Whether a demand for citizenship stands without a way to a licence within 200 code points of it."""
    shut = lambda p: ~found(F.regexp_replace(around(said.text, p["start"], p["end"], rules.LICENCE_REACH), flags(rules.LICENCE_CLOSED), " "), rules.LICENCE_ROUTES)
    # pattern by pattern in each window, so the first demand that stands ends the search
    moved = lambda w, p: F.struct((p["start"] + w["at"]).alias("start"), (p["end"] + w["at"]).alias("end"))
    stands = lambda w: F.exists(table(DEMANDS), lambda r: held(w["low"], r) & F.exists(places_of(w["part"], r["p"]), lambda p: shut(moved(w, p))))
    return F.coalesce(F.exists(near(said, DEMAND_WORDS, DEMANDS), stands), F.lit(False))


# -- doctorates

_SECTION_KINDS = "(?:required|minimum|basic|preferred|desired)"
_CLAUSE = rf"[.;]\s+(?=[A-Z])|\n+|\s[-*•]\s+|(?=\b{_SECTION_KINDS}\s+(?:qualifications|requirements)\b)|(?<!{_SECTION_KINDS}\s)\b(?=(?:qualifications|requirements)\b)"
#: A cheap look at a folded text: whatever is a doctorate in `rules` holds this.
_DOCTOR = r"ph[^a-z]*+d|doctor"
_NOT_NEEDED = r"\b(?:preferred|optional|ideally|beneficial|a\s+(?:plus|bonus)|nice[- ]to[- ]have|not\s+(?:required|necessary|essential)|(?:don't|do not)\s+need|would\s+be\s+great|also\s+considered|can\s+be\s+an?\s+exception|welcome\s+to\s+apply)\b"
_CLAIM = r"(?:^\W*|\b(?:have|hold|possess|education|degree|qualifications|requirements|enrolled\s+in|graduated\s+from|obtaining)\s*[:,]?\s*)(?:an?\s+)?(?:relevant\s+)?(?:ph\.?\s*d\.?(?!\w)|doctoral\s+degree\b|doctorate\b)"


def wants_doctorate(title: Text, said: Text) -> Column:
    """Whether the title is a doctor's, or a clause of the description asks for a doctorate and for no other degree instead.

    Clauses that call it optional, or stand in an optional section, don't
    count.  Outside of sections of qualifications only an outright demand does.
    """
    cut = F.split(F.regexp_replace(said.text, flags(r"\bph\.\s*d\.?"), "phd"), flags(_CLAUSE), -1)

    def step(acc: Column, clause: Column) -> Column:
        wanted = found(clause, rules.DOCTORATE)
        optional = found(clause, _NOT_NEEDED) | (acc["soft"] & ~found(clause, rules.REQUIRED_HEADERS))
        other = found(clause, rules.OTHER_DEGREE)
        asked = found(clause, rules.DOCTOR_REQUIRED) | (acc["section"] & found(clause, _CLAIM))
        hit = acc["hit"] | (wanted & ~optional & ~other & asked)
        soft = lambda headed: F.when(headed, last_is(clause, rules.PREFERRED_HEADERS, rules.REQUIRED_HEADERS)).otherwise(acc["soft"])
        return bound(found(clause, (*rules.PREFERRED_HEADERS, *rules.REQUIRED_HEADERS)), lambda headed: F.struct(hit.alias("hit"), soft(headed).alias("soft"), (acc["section"] | headed).alias("section")))

    start = F.struct(F.lit(False).alias("hit"), F.lit(False).alias("soft"), F.lit(False).alias("section"))
    return found(title, rules.DOCTOR_TITLE) | F.coalesce(F.when(said.low.rlike(_DOCTOR) & found(said, rules.DOCTORATE), F.aggregate(cut, start, step, lambda a: a["hit"])), F.lit(False))


# -- the gate

#: Texts of which every match of these rules holds one.
CLEARANCE_WORDS = ("clear", "secret", "sci", "polygraph")
SPONSOR_WORDS = ("sponsor",)
REJECTS = (
    Rule(1, "NON_TARGET_ROLE", given="other_family"),
    Rule(2, "NON_TARGET_ROLE", given="unwanted_family"),
    Rule(3, "OUTSIDE_US", given="elsewhere"),
    Rule(4, "SENIOR_TITLE", given="senior"),
    Rule(5, "PHD_TARGETED_ROLE", given="doctorate"),
    Rule(6, "SENIOR_TITLE", "title", (rules.LEVEL_THREE,), given="level_three"),
    Rule(7, "EXPERIENCE_TOO_HIGH", given="experienced"),
    Rule(8, "INTERNSHIP_ROLE", "title_alone", rules.INTERNSHIP),
    Rule(9, "CONTRACT_ROLE", given="contract"),
    Rule(10, "PART_TIME_ROLE", given="part_time"),
    Rule(11, "NON_TARGET_ROLE", given="paid_tasks"),
    Rule(12, "SECURITY_ROLE", "title", rules.SECURITY),
    Rule(13, "HARDWARE_EMBEDDED_ROLE", given="hardware"),
    Rule(14, "NON_TARGET_ROLE", "title", rules.PRODUCT_ENGINEER, given="not_yet_other"),
    Rule(15, "SYSTEMS_LANGUAGE_ONLY", given="systems_only"),
    Rule(16, "CITIZENSHIP_BLOCKER", given="citizenship"),
    Rule(17, "CLEARANCE_BLOCKER", given="clearance"),
    Rule(18, "SPONSORSHIP_BLOCKER", "both", (*rules.SPONSOR_PHRASES, *rules.SPONSOR_PATTERNS), words=SPONSOR_WORDS),
)
NOTES = (
    Rule(1, "NO_HARD_BLOCKER"),
    Rule(2, "LOCATION_UNCERTAIN", given="uncertain"),
    Rule(3, "REQUIREMENTS_NOT_VERIFIED", given="unverified"),
    Rule(4, "EARLY_CAREER_SIGNAL", given="early"),
    Rule(5, "NEW_GRAD_TITLE", "title", rules.NEW_GRAD),
    Rule(6, "EXPORT_CONTROL_CAVEAT", "both", (rules.EXPORT_CONTROL,), rules.LICENCE_ROUTES, "no_demand"),
)


def _hardware(title: Text, description: Text) -> Column:
    return found(title, rules.HARDWARE) | (how_many(description, [rf"\b{m}s?\b" for m in rules.HARDWARE_MARKERS]) >= rules.LEAST_MARKERS)


def _systems_only(both: Text) -> Column:
    """Whether C or C++ are named and no other language."""
    *plain, capital = rules.SYSTEMS_LANGUAGES
    named = found(both, plain) | (both.text.contains("C") & found(both, capital, capitals=True))
    return named & ~found(both, rules.OTHER_LANGUAGES) & ~found(both, rules.CAPITAL_LANGUAGES, capitals=True)


def gate(title: Column, description: Column, location: Column, employment_type: Column | None = None, most_years: int = rules.MOST_YEARS, most_open_years: int = rules.MOST_OPEN_YEARS) -> Column:
    """struct(status, family, priority, codes, years): REJECT with the codes of all failing rules in order, else PASS with notes."""
    title, description, location = (F.coalesce(c, F.lit("")) for c in (title, description, location))
    kind = F.lower(F.coalesce(employment_type, F.lit(""))) if employment_type is not None else F.lit("")

    def told(known: Column) -> Column:
        title, description, both = (Text(known[c], known[f"{c}_low"]) for c in ("title", "description", "both"))
        family, years, where = known["family"], known["years"], known["where"]
        required = F.greatest(years["required"], known["title_years"])
        ranked = F.regexp_replace(title.text, flags(_STAFF), "software engineer")
        senior = found(Text.of(ranked), rules.SENIOR) | (found(title, _STAFF) & found(title, r"\btlm\b"))
        part_time = lambda c: found(c, rules.PART_TIME) & ~found(c, rules.FULL_TIME)
        over = lambda c, most: F.coalesce(c > most, F.lit(False))
        unwanted = family.isin(*UNWANTED)
        paid = found(description, rules.PARTICIPANT) & found(description, rules.PAID_TASK)
        texts = {"title": title, "both": both, "title_alone": Text(F.regexp_replace(title.text, flags(rules.FORMER_INTERNS), ""), title.low)}
        rejects = all_outcomes(REJECTS, texts, {
            "other_family": family == "OTHER",
            "unwanted_family": unwanted,
            "elsewhere": ~where.isin("US", "ANYWHERE"),
            "senior": senior,
            "doctorate": wants_doctorate(title, description),
            "level_three": ~senior & (required.isNull() | (required > most_open_years)),
            "experienced": over(years["open"], most_open_years - 1) | over(required, most_years - 1),
            "contract": kind.contains("contract") | found(title, rules.CONTRACT),
            "part_time": part_time(title) | part_time(kind),
            "paid_tasks": paid,
            "hardware": _hardware(title, description),
            "not_yet_other": ~((family == "OTHER") | unwanted | paid),
            "systems_only": _systems_only(both),
            "citizenship": known["citizenship"],
            "clearance": found(both, (*rules.CLEARANCE_PHRASES, *rules.CLEARANCE_PATTERNS), words=CLEARANCE_WORDS) | found(title, rules.CLEARANCE_TITLES),
        })
        early = ~over(required, rules.EARLY_YEARS) & ~over(years["ceiling"], most_years) & (found(title, rules.EARLY_CAREER) | found(description, rules.EARLY_CAREER) | required.isNotNull())
        notes = all_outcomes(NOTES, texts, {
            "uncertain": where == "ANYWHERE",
            "unverified": F.length(F.trim(description.text)) < 400,
            "early": early,
            "no_demand": ~known["citizenship"],
        })
        return bound(rejects, lambda no: F.struct(F.when(F.size(no) > 0, "REJECT").otherwise("PASS").alias("status"), family.alias("family"), role_priority(family).alias("priority"), F.when(F.size(no) > 0, no).otherwise(notes).alias("codes"), required.alias("years")))

    both = F.concat_ws("\n", title, description)
    texts = {"title": title, "description": description, "both": both}
    lows = F.struct(*[c.alias(k) for k, c in texts.items()], *[folded(c).alias(f"{k}_low") for k, c in texts.items()])
    known = lambda t: F.struct(
        *[t[c].alias(c) for k in texts for c in (k, f"{k}_low")],
        role_family(t["title"]).alias("family"),
        bound(figures(Text(t["description"], t["description_low"])), years_of).alias("years"),
        title_years(t["title"]).alias("title_years"),
        places.kind_of_place(location).alias("where"),
        demands_citizenship(Text(t["both"], t["both_low"])).alias("citizenship"),
    )
    return bound(lows, lambda t: bound(known(t), told))
