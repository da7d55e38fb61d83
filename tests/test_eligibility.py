"""Families, figures of experience, citizenship demands and the gate: cases, and a plain reading of the same rules."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strataline import plans
from strataline.functions import positions
from strataline.functions.positions import Text
from strataline.operators import eligibility, rules
from strataline.sources.tables import table

I = re.IGNORECASE  # noqa: E741
PAD = "Build Python and Go software services. Review code and document reliable APIs. " * 6 + "\n"


def each(spark, values, column):
    """column over rows of `x`, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string").repartition(4)
    return [r.y for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


# -- a plain reading of figures


def plain_floors(text):
    number = rf"(?:{rules.WRITTEN_NUMBER}|\d{{1,2}})"
    words = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
    words |= {w: 10 * i for i, w in enumerate("x x twenty thirty forty fifty sixty seventy eighty ninety".split())}
    value = lambda w: int(w) if w.isdigit() else sum(words[x] for x in re.split(r"[-\s]+", w.lower()))
    pattern = rf"(?<![\w-])(?:(at\s+least|(?:a\s+)?minimum(?:\s+of)?|no\s+less\s+than)\s+({number})\s+(years?|yrs?)|({number})\s+or\s+more\s+(years?|yrs?))\b"
    return re.sub(pattern, lambda m: f"{m[1]} {value(m[2])} {m[3]}" if m[1] else f"{value(m[4])}+ {m[5]}", text, flags=I)


def plain_figures(text):
    """(years, high, optional, open, read) of each figure, by scanning."""
    text = plain_floors(text)
    taken, out = [], []

    def optional(at):
        window, last, end, soft = text[max(0, at - 1200) : at], -1, -1, False
        for p in rules.PREFERRED_HEADERS:
            for m in re.finditer(p, window, I):
                if m.start() > last:
                    last, end = m.start(), m.end()
        if last >= 0:
            soft = not any(re.search(p, window[end:], I) for p in rules.REQUIRED_HEADERS)
        a = max(text.rfind(c, 0, at) for c in ".;,\n") + 1
        b = min([k for c in ".;,\n" if (k := text.find(c, at)) >= 0], default=len(text))
        return soft or any(w in text[a:b].lower() for w in rules.OPTIONAL_WORDS)

    def instead(at):
        clause = re.split(r"[.;!?\n]", text[at : at + 250])[0]
        m = re.search(r"\b(?:may|can)\s+be\s+(?:considered|accepted)\s+(?:in\s+place\s+of|in\s+lieu\s+of)\s+(?:an?\s+)?(?:bachelor|master)(?:['’]?s)?\s+degree\b", clause, I)
        return bool(m) and len(re.findall(rf"(?<![\w-])(?:{rules.WRITTEN_NUMBER}|\d{{1,2}})\s*{rules.PLUS}?\s*(?:years?|yrs?)\b", clause[: m.start()], I)) == 1

    for m in re.finditer(eligibility.RANGE, text, I):
        taken.append(m.span())
        if not instead(m.start()):
            low, high = re.findall(r"\d{1,2}", m[0])[:2]
            out.append((int(low), int(high), optional(m.start()), False, True))
    for pattern in (eligibility.SINGLE, eligibility.TRAILING, eligibility.BARE):
        for m in re.finditer(pattern, text, I):
            at = m.start()
            if any(a <= at < b for a, b in taken) or instead(at) or re.search(rules.COLLECTIVE, text[max(0, at - 90) : at], I):
                continue
            n = re.search(r"\d{1,2}", m[0])
            ahead, behind = text[max(0, at + n.start() - 26) : at + n.start()], text[at + n.end() : at + n.end() + 22]
            floor = not re.search(rules.CEILING, ahead, I) and bool(re.search(rules.FLOOR_AFTER, behind, I) or re.search(rules.FLOOR_BEFORE, ahead, I))
            read = pattern is not eligibility.BARE or any(re.search(p, text[max(0, at - 1200) : at], I) for p in (*rules.REQUIRED_HEADERS, *rules.PREFERRED_HEADERS))
            out.append((int(n[0]), None, optional(at), floor, read))
    return Counter(out)


def plain_years(text):
    told = plain_figures(text or "")
    return max([f[0] for f in told if f[4] and not f[2]], default=None) or max([f[0] for f in told if f[4] and f[2]], default=None)


SNIPPETS = [
    "Minimum qualifications\n", "Preferred qualifications:\n", "Requirements: ", "Nice to have\n", "What you'll bring\n", "Our team has ", "We have ", "combined ", "5+ years of experience", "2-5 years of software experience", "2 to 10+ years of work",
    "3 years of Go programming", "seven or more years", "At least twenty-one years of engineering", "a minimum of 4 yrs in development", "experience (6+ years)", "background of at least 8 years", "6+ years", "5 (+) years", "no more than 3 years of professional experience",
    "up to 2 yrs of industry", "1 year or more of experience", "may be accepted in lieu of a bachelor's degree", "can be considered in place of master degree", " preferred", ", ideally ", ". ", "; ", "\n", " ", " word " * 30, "x" * 1150, "in 2015 years old", "é😀 ", " ", "4–6 yrs experience", "10-12 years of experience",
]


def test_figures_match_a_plain_reading(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(SNIPPETS) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    got = each(spark, texts, F.struct(eligibility.figures(F.col("x")).alias("f"), eligibility.required_years(F.col("x")).alias("n")))
    for text, r in zip(texts, got, strict=True):
        want = plain_figures(text)
        assert Counter(tuple(f) for f in r.f) == want, text
        assert r.n == plain_years(text) or (not r.n and not plain_years(text))
    assert sum(any(f.optional for f in r.f) for r in got) > 50 and sum(any(f.high for f in r.f) for r in got) > 50


YEARS = [
    ("Requires 2-5 years of Go experience.", 2), ("5+ years of experience in C.\nPreferred qualifications\n8 years of Rust experience.", 5), ("Nice to have: 4 years of experience.", 4), ("none", None), (None, None), ("A company 20 years old.", None),
    ("Our team has 10+ years of combined experience.", None), ("Relevant industry experience (6+ years)", 6), ("Qualifications\n6+ years in EDA", 6), ("6+ years in EDA", None), ("Five or more years of experience", 5), ("3+ years preferred, 1+ years of experience required", 1),
    ("4 years of experience may be accepted in lieu of a bachelor's degree.", None),
]


def test_required_years(spark):
    assert dict(zip([said for said, _ in YEARS], each(spark, [said for said, _ in YEARS], eligibility.required_years(F.col("x"))), strict=True)) == dict(YEARS)


def test_years_of_titles(spark):
    titles = ["Engineer BS+10 yrs or MS+8", "Engineer MS+3 years", "Engineer BS+5", "BS+2 yrs, MS + 4 yrs", "Engineer", None]
    assert each(spark, titles, eligibility.title_years(F.col("x"))) == [8, 3, None, 4, None, None]


# -- families


FAMILIES = [
    ("Software Engineering, New Grad", "SOFTWARE_ENGINEERING"), ("Machine Learning Software Engineer", "AI_ML_ENGINEERING"), ("Forward Deployed Software Engineer", "FORWARD_DEPLOYED_ENGINEERING"),
    ("Site Reliability Engineer, AI Infrastructure", "SITE_RELIABILITY_ENGINEERING"), ("Machine Learning Engineer, Android", "AI_ML_ENGINEERING"), ("Full Stack Engineer (Web and Mobile)", "SOFTWARE_ENGINEERING"), ("Software Engineers, Mobile", "MOBILE_ENGINEERING"),
    ("DevOps Software Engineer", "INFRASTRUCTURE_ENGINEERING"), ("Software Engineer, Infrastructure", "SOFTWARE_ENGINEERING"), ("Platform Engineer", "INFRASTRUCTURE_ENGINEERING"), ("Data Platform Engineer", "DATA_ENGINEERING"), ("Factory Infrastructure Engineer", "OTHER"),
    ("Medical Informaticist - Institute for Data Science", "OTHER"), ("Data Scientist - Department of Health", "DATA_SCIENCE"), ("Member of Technical Staff, Product Design", "OTHER"), ("Member of Technical Staff - Backend", "SOFTWARE_ENGINEERING"),
    ("Member of Technical Staff, Inference Infra", "AI_ML_ENGINEERING"), ("Member of Technical Staff, Cloud", "INFRASTRUCTURE_ENGINEERING"), ("SDET II", "QUALITY_ASSURANCE"), ("Compiler Engineer", "COMPILER_ENGINEERING"), ("Nurse", "OTHER"), ("", "OTHER"), (None, "OTHER"),
]


def test_family(spark):
    assert dict(zip([t for t, _ in FAMILIES], each(spark, [t for t, _ in FAMILIES], eligibility.role_family(F.col("x"))), strict=True)) == dict(FAMILIES)


# -- citizenship


def test_demands_and_ways_to_a_licence(spark):
    demand, way, shut = "You must be a (i) U.S. citizen or national", "otherwise eligible for deemed export licensing", "without obtaining an export license"
    texts = [demand, f"{demand} {way}", f"{demand} {'x' * 220} {way}", f"{way} {'x' * 130} {demand}", f"{demand} {shut}", f"export {shut}", "GC/CITIZEN can apply", "Only GC/Citizen, OPT, EAD, H4", "an international team", "", None]
    texts += [f"{demand} {way}. {'x ' * 300} Only U.S. citizens."]
    got = each(spark, texts, eligibility.demands_citizenship(Text.of(F.col("x"))))
    assert got == [True, False, True, False, True, True, True, False, False, False, False, True]


# -- the gate


GIVEN = {"title": "Software Engineer", "description": PAD, "location": "Seattle, Washington", "kind": None}
DECISIONS = [
    ({}, ["NO_HARD_BLOCKER"]),
    ({"title": "Senior Software Engineer", "location": "London"}, ["OUTSIDE_US", "SENIOR_TITLE"]),
    ({"title": "Member of Technical Staff, Software"}, ["NO_HARD_BLOCKER"]),
    ({"title": "Staff Member of Technical Staff, Software"}, ["SENIOR_TITLE"]),
    ({"title": "New Grad SWE", "description": "short"}, ["NO_HARD_BLOCKER", "REQUIREMENTS_NOT_VERIFIED", "EARLY_CAREER_SIGNAL", "NEW_GRAD_TITLE"]),
    ({"title": "Software Engineer III"}, ["SENIOR_TITLE"]),
    ({"title": "Software Engineer III", "description": PAD + "Requires 2-5 years of experience"}, ["NO_HARD_BLOCKER"]),
    ({"title": "Software Engineer III", "description": PAD + "Requires 2-4 years of experience"}, ["NO_HARD_BLOCKER", "EARLY_CAREER_SIGNAL"]),
    ({"description": PAD + "At least 3 years of experience"}, ["EXPERIENCE_TOO_HIGH"]),
    ({"description": PAD + "3 years of experience"}, ["NO_HARD_BLOCKER"]),
    ({"description": PAD + "No more than 4 years of experience"}, ["EXPERIENCE_TOO_HIGH"]),
    ({"description": PAD + "Preferred qualifications\n3+ years of experience"}, ["NO_HARD_BLOCKER"]),
    ({"title": "Software Engineer (for current/previous Acme interns only)"}, ["NO_HARD_BLOCKER"]),
    ({"title": "Software Engineering Internships"}, ["INTERNSHIP_ROLE"]),
    ({"kind": "Part-time or full-time"}, ["NO_HARD_BLOCKER"]),
    ({"kind": "part_time"}, ["PART_TIME_ROLE"]),
    ({"title": "Product Engineer"}, ["NON_TARGET_ROLE"]),
    ({"title": "Software Engineer, Product Engineer"}, ["NON_TARGET_ROLE"]),
    ({"description": "You write C. " * 40}, ["SYSTEMS_LANGUAGE_ONLY"]),
    ({"description": "You write C and R. " * 40}, ["NO_HARD_BLOCKER"]),
    ({"title": "Software Engineer - Ctj - Poly"}, ["CLEARANCE_BLOCKER"]),
    ({"description": PAD + "This position is not eligible for Acme immigration sponsorship"}, ["SPONSORSHIP_BLOCKER"]),
    ({"description": PAD + "Subject to export control regulations"}, ["NO_HARD_BLOCKER", "EXPORT_CONTROL_CAVEAT"]),
    ({"description": PAD + "Work with UART on Stuart's boards, firmware and inspired people"}, ["NO_HARD_BLOCKER"]),
    ({"description": PAD + "Basic qualifications\nPhD in physics"}, ["PHD_TARGETED_ROLE"]),
    ({"description": PAD + "Basic qualifications\nPhD or Master's degree"}, ["NO_HARD_BLOCKER"]),
    ({"description": PAD + "Preferred qualifications\nPhD in physics"}, ["NO_HARD_BLOCKER"]),
    ({"location": "Remote"}, ["NO_HARD_BLOCKER", "LOCATION_UNCERTAIN"]),
    ({"location": None}, ["OUTSIDE_US"]),
    ({"title": None, "description": None}, ["NON_TARGET_ROLE"]),
]


def test_gate(spark):
    rows = [(i, *(GIVEN | given).values()) for i, (given, _) in enumerate(DECISIONS)]
    df = spark.createDataFrame(rows, "i long, title string, description string, location string, kind string")
    g = eligibility.gate(*[F.col(c) for c in GIVEN])
    got = {r.i: (r.g.status, r.g.codes) for r in df.select("i", g.alias("g")).collect()}
    for i, (given, codes) in enumerate(DECISIONS):
        assert got[i] == ("PASS" if codes[0] == "NO_HARD_BLOCKER" else "REJECT", codes), given


def test_every_code_is_met(spark, sf):
    met = {c for r in plans.QUERIES["gate_decision"](spark, sf.replace("sf0.001", "sf0.01")).select("codes").distinct().collect() for c in r.codes.split(",")}
    assert met == {r.outcome for r in (*eligibility.REJECTS, *eligibility.NOTES)}


def test_years_of_all_documents(spark, sf):
    tails = ["\nRequirements:\n{}-9 years of work experience.", "\nPreferred qualifications:\nAt least five years of Go programming.", "\nYou have 3+ years of experience, 8 years of experience preferred.", ""]
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: r.years for r in plans.QUERIES["experience_years"](spark, sf).collect()}
    assert got == {i: plain_years((t or "") + tails[i % 4].format(2 + i % 3)) for i, t in docs}


# -- needles and places


def test_a_match_holds_a_needle():
    told = [p for v in vars(rules).values() if isinstance(v, tuple) for p in v]
    rng, words = random.Random(2), sorted({w for p in told for n in positions.needles(p) for w in [n]})
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(4))
        for p in rng.sample(told, 20):
            if re.search(p, text, I):
                assert any(n in text for n in positions.needles(p)), (p, text)
    assert positions.needles(r"a(?:bc|de)?f+\d") == ("a",) and positions.needles(r"\d+|x") == () and positions.needles(r"(?:foo|ba)r\s") == ("ba", "foo")


def test_places(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a1", "é", "😀 ", "22", "xyz", "333 "]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "1"]
    got = each(spark, texts, positions.places(F.col("x"), r"\d{2,}"))
    for text, own in zip(texts, got, strict=True):
        assert [tuple(p) for p in own] == [(*m.span(), m[0]) for m in re.finditer(r"\d{2,}", text or "")]
