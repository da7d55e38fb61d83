"""Links and titles of imported rows are worked out once, however many tiers read them."""

from strataline import plans


def test_links_are_normalised_once(spark, sf):
    plan = plans.QUERIES["import_resolution"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "https://www.example.com/jobs/" not in plan
