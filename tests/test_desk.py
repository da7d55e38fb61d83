"""Desk operators on rows with nulls, ties and clashing values."""

from datetime import datetime

from pyspark.sql import functions as F

from strataline.operators import desk


def test_watchlist_names(spark):
    pages = [('{"companyName": "Moody\\u2019s"} {"companyName":"A \\"B\\" C"}',), ('"companyName" : "Moody\\u2019s", "companyName":"x"',), (None,), ("",), ('"companyName":"  Acme  " "companyName":"bad \\q escape"',)]
    got = {r.name for r in desk.watchlist_names(spark.createDataFrame(pages, "html string")).collect()}
    assert got == {"Moody’s", 'A "B" C', "Acme"}


def test_agencies(spark):
    long = "We build things for people who need them. " * 10
    rows = [("a", long)] * 4 + [("a", long + "Duration: 6 months")] + [("b", "Rate: 5")] * 9 + [("c", long + " C2C only")] * 2 + [(None, long), ("d", None)]
    boards = [("a", "Acme"), ("b", "Beta"), ("c", "Gamma"), ("d", "Delta Staffing"), ("e", None)]
    out = desk.agencies(spark.createDataFrame(boards, "board string, company_name string"), spark.createDataFrame(rows, "board string, description string"))
    assert {r.board: (r.described, r.templated, r.agency) for r in out.collect()} == {"a": (5, 1, "template"), "b": (0, 0, None), "c": (2, 2, None), "d": (0, 0, "name"), "e": (0, 0, None)}


def test_due_order(spark):
    now = datetime(2024, 1, 20, 12)
    at = lambda h: datetime(2024, 1, 20, h)
    rows = [(1, "workday", 3600, at(11), False), (2, "lever", 3600, at(11), None), (3, "lever", 900, at(10), False), (4, "workday", 3600, at(5), False), (5, "lever", 900, at(13), False), (6, "lever", 900, at(9), True), (7, "lever", 900, None, False), (8, "workday", 900, at(11), False)]
    boards = spark.createDataFrame(rows, "position int, source_type string, poll_interval_seconds int, due_at timestamp_ntz, in_flight boolean")
    assert [r.position for r in desk.due(boards, F.lit(now).cast("timestamp_ntz")).collect()] == [4, 3, 2, 8, 1]


def test_miss_reasons(spark):
    roles = [(1, "Acme, Inc.", "https://boards.greenhouse.io/acme/jobs/1"), (2, "Beta", "https://jobs.lever.co/beta/x"), (3, "Gamma", "https://jobs.lever.co/gamma/x"), (4, "Delta Global", "https://example.com/x"), (5, "Eps", "https://careers.site.com/1"), (6, "Zeta", None), (7, None, None), (8, "Agency", "https://jobs.lever.co/agency/1"), (9, "Late", None)]
    boards = [("greenhouse:acme", "Acme", True, False, False), ("lever:beta", "Beta", False, False, False), ("lever:agency", "Agency", False, True, False), ("x:delta", "Delta", True, False, False), ("x:late", "Late", True, False, True)]
    leads = [("Zeta Labs", "no_board"), ("Other", "polling")]
    out = desk.miss_reasons(spark.createDataFrame(roles, "role_id int, company string, link string"), spark.createDataFrame(boards, "board_key string, company string, enabled boolean, agency boolean, stale boolean"), spark.createDataFrame(leads, "company string, state string"), {"no_board": "No board was found"}, {"site.com": "Site"}, "No lead")
    assert {r.role_id: r.reason for r in out.collect()} == {1: "The board is read", 2: "The board is off", 3: "A board that can be read and is not added", 4: "The board is read", 5: "Posted on Site, which can't be read yet", 6: "No board was found", 7: "No lead", 8: "The board is an agency's and off", 9: "The board was not read lately"}
