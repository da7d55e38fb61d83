"""Windows around needles: the same places as in whole texts, and no more of a text than lies near a needle."""

import random

import pytest
from pyspark.sql import functions as F

from strataline import plans
from strataline.functions import positions
from strataline.functions.positions import Text
from strataline.operators import eligibility
from tests.test_eligibility import SNIPPETS, each

SAID = [
    "You must be a U.S. citizen.", "must be (iv) a united states person", "İTAR controlled", "itar requirements", "export control applies, and without obtaining an export license", " US person status is required", "citizenship will be verified", "USC / GC holders", "gc or us citizens, no OPT",
    "guitar", "international", " " * 12, "x" * 60, "word " * 120, "\n", ". ", "must be\n\n\n\n\n\n\n\n\n\n\na us citizen", "requires u.s. persons status", "requir" + "e" * 50 + " us person status", "é😀",
]
FIGURES = (eligibility.RANGE, eligibility.SINGLE, eligibility.TRAILING, eligibility.BARE)


@pytest.mark.parametrize(("snippets", "needles", "patterns"), [(SAID, eligibility.DEMAND_WORDS, eligibility.DEMANDS), (SNIPPETS, eligibility.YEAR_WORDS, FIGURES)])
def test_places_are_those_of_whole_texts(spark, snippets, needles, patterns):
    rng = random.Random(3)
    texts = ["", None, *["".join(rng.choice(snippets) for _ in range(rng.randint(1, 8))) for _ in range(300)]]
    text = Text.of(F.col("x"))
    windows = positions.near(text, needles, patterns)
    got = each(spark, texts, F.struct(F.array_sort(positions.places_near(windows, patterns)).alias("a"), F.array_sort(positions.places_of_each(text, patterns)).alias("b")))
    for t, r in zip(texts, got, strict=True):
        assert (r.a or []) == (r.b or []), t
    assert sum(len(r.b or []) for r in got) > 100


def test_only_what_is_near_is_searched(spark):
    far = "x y " * 50_000
    windows = positions.near(Text.of(F.col("x")), eligibility.YEAR_WORDS, FIGURES)
    size = lambda ws: F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w["part"]))
    got = each(spark, [f"{far}5+ years of experience{far}3 yrs of software experience{far}", far, "year " * 20_000], F.struct(F.size(windows).alias("n"), size(windows).alias("size")))
    assert got[0].n == 2 and got[0].size < 2000 and got[1].n == 0 and got[2].n == 1


def test_needles_have_to_be_in_every_match():
    assert positions.hold_one((r"\d+\s*(?:years?|yrs?)",), ("year", "yr")) and not positions.hold_one((r"us (?:citizen|native)",), ("citizen",))
    with pytest.raises(ValueError, match="no bound"):
        positions.reach([r"a.*b"])
    assert positions.reach([r"ab\s+c{2,3}(?!de)"]) == 2 + positions.BLANKS + 3 + 2


def test_skills_of_a_resume_are_computed_once(spark, sf):
    plan = plans.QUERIES["resume_assessment"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:license)(?!") == 1
