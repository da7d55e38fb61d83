"""Cells of markdown tables are read once each, and plain ones without the steps for marked-up text."""

from pyspark.sql import functions as F

from strataline import plans
from strataline.functions import text
from tests.test_eligibility import each


def test_cells_are_read_once(spark, sf):
    plan = plans.QUERIES["read_markdown_lists"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("(script|style)") <= 4


def test_plain_text_needs_no_markup_steps(spark):
    told = {"a  b\n c": "a b c", "": "", None: "", "a &amp; b": "a & b", "x<br>y": "x y", " a > b ; #35;": "a > b ; #35;", "<!-- x --> y": "y"}
    assert each(spark, list(told), text.html_to_text(F.col("x"))) == list(told.values())
