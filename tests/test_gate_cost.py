"""What the gate cuts out of a text once is what it would meet in the whole text, and shared words keep patterns from running."""

import pytest
from pyspark.sql import functions as F

from strataline.functions.positions import Text, found, near
from strataline.operators import eligibility, rules
from tests.test_eligibility import each, plain_figures


def test_clauses_and_runs_longer_than_what_is_cut_out(spark):
    long = "word " * 400
    texts = [
        f"Preferred: {long}5+ years of experience", f"preferred. {long}5+ years of experience", f"requirements\n{long}5+ years of experience, {long}ideally", f"3 years of experience {long}preferred",
        f"experience{' ' * 2500}at least 5 years or more", f"ideally {long}{long}2-5 years of experience", f"{long}\nmore than 5 years of experience", "at least experience: 7 yrs plus",
    ]
    got = each(spark, texts, eligibility.figures(F.col("x")))
    for text, told in zip(texts, got, strict=True):
        assert {tuple(f): 1 for f in told} == dict(plain_figures(text)), text[:40]
    assert all(f.optional for f in (*got[0], *got[3])) and not any(f.optional for f in got[1])


def test_words_of_all_patterns(spark):
    texts = ["We will not sponsor visas.", "An active TOP SECRET clearance", "TS/SCI", "nothing", None, "polygraph", "sponsor", "SPONSORSHIP IS NOT AVAILABLE"]
    text = Text.of(F.col("x"))
    for patterns, words in (((*rules.SPONSOR_PHRASES, *rules.SPONSOR_PATTERNS), eligibility.SPONSOR_WORDS), ((*rules.CLEARANCE_PHRASES, *rules.CLEARANCE_PATTERNS), eligibility.CLEARANCE_WORDS)):
        got = each(spark, texts, F.struct(found(text, patterns, words=words).alias("a"), found(text, patterns).alias("b")))
        assert [r.a for r in got] == [r.b for r in got] and any(r.a for r in got)
    with pytest.raises(ValueError, match="without"):
        found(text, rules.EARLY_CAREER, words=("grad",))
    assert each(spark, ["none", None], F.size(near(text, ("year",), (r"\byears\b",)))) == [0, 0]


def test_doctorates_pass_the_cheap_look(spark):
    said = ["PhD", "Ph. D.", "ph.d", "PH D", "doctorate", "doctoral degree", "graph data", "phone", "ph"]
    text = Text.of(F.col("x"))
    got = each(spark, said, F.struct(text.low.rlike(eligibility._DOCTOR).alias("look"), found(text, rules.DOCTORATE).alias("is")))
    assert all(r["look"] or not r["is"] for r in got) and sum(r["is"] for r in got) == 6 and not got[-1]["look"]
