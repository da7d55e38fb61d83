from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from strataline.operators import lifecycle, listing, matching, reports
from strataline.sources import readers


def test_suppress_feed_copies(spark):
    rows = spark.createDataFrame(
        [
            (1, "simplify", "Acme", "Engineer", "https://a.com/1", True),
            (2, "board", " acme", "ENGINEER ", "https://b.com/2", True),
            (3, "simplify", "Beta", "Dev", "http://www.c.com/en-us/3", True),
            (4, "board", "Gamma", "Other", "https://c.com/3", True),
            (5, "simplify", "Delta", "Dev", "https://d.com/5", True),
            (6, "board", "Delta", "Dev", "https://e.com/6", False),
            (7, "simplify", "Staff Co", "Dev", None, True),
            (8, "simplify", None, None, None, True),
        ],
        "id int, source string, company string, title string, official_url string, is_active boolean",
    )
    blocked = spark.createDataFrame([("staff co ",)], "company_name string")
    kept = matching.suppress_feed_copies(rows, ("simplify",), blocked)
    assert sorted(r.id for r in kept.collect()) == [2, 4, 5, 6, 8]


def test_opened_within(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, "b", "x", t(20), t(20)), (2, "b", "x", t(1), t(20)), (3, "feed", "x", t(1), t(20)), (4, "b", "y", None, t(5)), (5, "b", "y", None, t(20))], "id int, source string, account string, posted_at timestamp, first_seen_at timestamp")
    states = spark.createDataFrame([("b", "x", t(2)), ("b", "y", None)], "source string, account string, initialized_at timestamp")
    out = matching.opened_within(rows, states, ["source", "account"], F.lit(t(10)), ("feed",))
    assert sorted(r.id for r in out.collect()) == [1, 2, 5]


def test_resolve(spark):
    stored = spark.createDataFrame(
        [(1, "Acme Inc", "Software Engineer", "https://acme.com/jobs/1", "NYC", False), (2, "Acme", "Data Scientist", "https://acme.com/jobs?id=2", "NYC", False), (3, "Acme", "Data Scientist", "https://acme.com/jobs?id=3", "LA", True), (4, "Beta", "Platform Engineer", "https://beta.com/4", "NYC", False), (5, "Beta", "Platform Engineer", "https://beta.com/5", "NYC", False)],
        "id long, company string, title string, official_url string, location string, is_applied boolean",
    )
    rows = spark.createDataFrame(
        [(1, "x", "y", "http://www.acme.com/jobs/1/?utm_source=z", ""), (2, "ACME", "Data Scientist", None, ""), (3, "Beta", "Platform Engineer", None, ""), (4, "Beta", "Gardener", None, ""), (5, None, "Engineer", None, ""), (6, "acme", "SWE", None, "")],
        "row_number long, company string, title string, url string, location string",
    )
    out = {r.row_number: (r.status, r.method, r.job_id, r.candidates) for r in matching.resolve(rows, stored).collect()}
    assert out == {1: ("matched", "url", 1, []), 2: ("matched", "title", 3, []), 3: ("ambiguous", "title", None, [4, 5]), 4: ("unmatched", None, None, []), 5: ("unusable", None, None, []), 6: ("matched", "title", 1, [])}


def test_recall(spark):
    listed = spark.createDataFrame([(1, "Acme, Inc.", "Software Engineer", "https://acme.com/jobs/77001"), (2, "Beta Industries", "New Grad Software Engineer 2026", None), (3, "Gamma", "Analyst", None), (4, "Acme", "Engineer Intern", None)], "role_id int, company string, title string, link string")
    jobs = spark.createDataFrame([(1, "simplify", "Acme", "Backend", "https://acme.com/jobs/77001"), (2, "greenhouse", "Beta", "Software Engineer Search Graduate", "u"), (3, "board", "Gamma", "Painter", "v"), (4, "simplify", "Acme", "Engineer Intern", "w"), (5, "board", "Gamma", "Senior Analyst Lead", "y")], "id int, source string, company string, title string, official_url string")
    assert {r.role_id: r.outcome for r in matching.recall(listed, jobs, ("simplify",)).collect()} == {1: "feed", 2: "board", 3: "missed", 4: "feed"}


def test_snapshot(spark):
    now = datetime(2024, 1, 2)
    old = datetime(2024, 1, 1)
    stored = spark.createDataFrame([("a", "A", "1", True, old, old, None), ("b", "B", "1", True, old, old, None), ("c", "C", "1", False, old, old, old), ("d", "D", "1", True, old, old, None)], "k string, title string, content_hash string, is_active boolean, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp")
    incoming = spark.createDataFrame([("a", "A", "1", 0), ("b", "B2", "0", 0), ("b", "B3", "2", 1), ("c", "C", "1", 0), ("e", "E", "1", 0)], "k string, title string, content_hash string, position int")
    state, changes = lifecycle.apply_snapshot(stored, incoming, ["k"], F.lit(now))
    assert {r.k: r.change for r in changes.collect()} == {"a": "UNCHANGED", "b": "UPDATED", "c": "REOPENED", "d": "CLOSED", "e": "NEW"}
    got = {r.k: (r.title, r.is_active, r.first_seen_at, r.last_seen_at, r.closed_at) for r in state.collect()}
    assert got == {"a": ("A", True, old, now, None), "b": ("B3", True, old, now, None), "c": ("C", True, old, now, None), "d": ("D", False, old, old, now), "e": ("E", True, now, now, None)}
    _, partial = lifecycle.apply_snapshot(stored, incoming, ["k"], F.lit(now), complete=False)
    assert "CLOSED" not in {r.change for r in partial.collect()}
    with pytest.raises(ValueError):
        lifecycle.apply_snapshot(stored, incoming.limit(0), ["k"], F.lit(now))


def test_ledger(spark):
    ledger = spark.createDataFrame([(1, "a", None)], "id int, dedupe_key string, undo_of_id int")
    events = spark.createDataFrame([(2, "a", None), (3, "b", None), (4, "c", 3)], "id int, dedupe_key string, undo_of_id int")
    out = lifecycle.append_ledger(ledger, events)
    assert sorted(r.id for r in out.collect()) == [1, 3, 4]
    assert [r.id for r in lifecycle.without_undone(out).collect()] == [1]


def test_cohort_parts_sum_up(spark):
    now = datetime(2024, 3, 1)
    apps = spark.createDataFrame([(i, None if i == 9 else datetime(2024, 1, 1) if i < 7 else datetime(2024, 2, 20), i % 2 == 0) for i in range(10)], "k int, at timestamp, withdrawn boolean")
    outcome = spark.createDataFrame([(0, "positive"), (1, "rejected")], "k int, polarity string")
    r = reports.cohort(apps, outcome, "k", "at", F.lit(now)).first()
    assert (r.total, r.undated, r.eligible) == (10, 1, 7) and r.positive + r.rejected + r.pending + r.unknown == r.eligible


def test_polarity_ties(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "offer", t), (1, "rejection", t), (2, "offer", t)], "k int, kind string, at timestamp")
    out = reports.polarity(rows, "k", F.col("kind") == "offer", F.col("kind") == "rejection", "at")
    assert {r.k: r.polarity for r in out.collect()} == {1: "rejected", 2: "positive"}


def test_paging_is_stable(spark):
    rows = spark.range(30).select(F.col("id"), F.lit(datetime(2024, 1, 1)).alias("first_seen_at"), (F.col("id") % 3).alias("score"))
    ids = []
    for offset in range(0, 30, 7):
        ids += [r.id for r in listing.page(rows, listing.Filters(sorts=("best_match",), limit=7, offset=offset)).collect()]
    assert ids == sorted(range(30), key=lambda i: (-(i % 3), -i))
    assert listing.parse_sort(" newest, bad ,newest,title,company") == ("newest", "bad", "title")


def test_confusion_without_rows(spark):
    rows = spark.createDataFrame([("a", "a")], "e string, p string")
    out = {r.category: (r.precision, r.recall) for r in reports.confusion(rows, "e", "p", ["a", "b"]).collect()}
    assert out == {"a": (1.0, 1.0), "b": (None, None)}


@pytest.mark.parametrize("kind", sorted(readers.JSON_SOURCES))
def test_readers_take_bad_payloads(spark, kind):
    rows = spark.createDataFrame([("Acme", None), ("Acme", ""), ("Acme", "{"), ("Acme", "{}"), ("Acme", "[]"), ("Acme", '{"jobs": [null, {}]}')], "company string, payload string")
    out = readers.read_json(rows, kind)
    assert out.columns == readers.FIELDS and out.count() == 0


def test_ashby_and_unknown_reader(spark):
    payload = '{"jobs": [{"id": "1", "title": "Engineer", "location": "NYC", "secondaryLocations": [{"location": "LA"}], "descriptionPlain": "x", "jobUrl": "u", "isListed": true}, {"id": "2", "isListed": false}]}'
    rows = readers.read_json(spark.createDataFrame([("Acme", payload)], "company string, payload string"), "ashby").collect()
    assert [(r.external_id, r.title, r.location, r.company) for r in rows] == [("1", "Engineer", "NYC; LA", "Acme")]
    with pytest.raises(ValueError):
        readers.read_json(spark.createDataFrame([("a", "b")], "company string, payload string"), "no such board")


def test_job_posting_page(spark):
    html = '<html><script type="application/ld+json">{"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Acme"}, "datePosted": "2024-03-01", "description": "<p>Hi</p>"}</script></html>'
    r = readers.read_job_posting_pages(spark.createDataFrame([("https://x.com/1", html), ("https://x.com/2", "<p>none</p>")], "url string, html string")).collect()
    assert [(x.title, x.company, x.description, x.posted_at.date()) for x in r] == [("Dev", "Acme", "Hi", date(2024, 3, 1))]


def test_map_columns():
    assert readers.map_columns(["Company", "Job Title", "Date Applied", "Link", "Status"]) == {"company": "Company", "title": "Job Title", "applied_at": "Date Applied", "url": "Link", "status": "Status"}
