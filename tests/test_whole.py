"""Queries over whole tables, on rows that id prefixes or filters would lose."""

import json
import random
import re
from datetime import datetime, timedelta

from strataline import plans
from strataline.sources import readers
from tests.test_eligibility import plain_years

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _run(spark, folder, name, **tables):
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return [tuple(r) for r in plans.QUERIES[name](spark, str(folder)).collect()]


def test_rows_beyond_the_old_cuts(spark, tmp_path):
    day = datetime(2024, 1, 20)
    events = [(100 + i, day + timedelta(hours=i), 4000, "purchase", float(i), '{"k": 1}') for i in range(21)] + [(200, day, 4001, "error", 1.0, '{"k": 2}'), (201, day, 4002, "view", 1.0, '{"k": 2}'), (202, day, 4003, "view", 2.0, '{"k": 3}')]
    orders = [(5000, 1, "F", 1.0, day, "a"), (5001, 1, "F", 1.0, day, "b"), (5002, 1, "F", 1.0, day, "c"), (5003, 1, "F", 1.0, day, "b"), (5200, 2, "O", 1.0, day, "a")]
    customers = spark.createDataFrame([(4000,), (4001,), (4003,)], "c_custkey long")
    ev = spark.createDataFrame(events, EVENTS)
    run = lambda name, **t: sorted(_run(spark, tmp_path, name, **t))
    assert run("message_conflicts", events=ev) == [(i,) for i in (*range(100, 121), 202)]
    assert run("cohort_polarity") == [(4000, "positive"), (4001, "rejected")]
    assert run("speed_median_p90") == [(4000, 21, 10.0, 18.0), (4001, 1, None, None), (4002, 1, None, None), (4003, 1, None, None)]
    # applied 40, 41 and 43 days before the first of February
    assert run("cohort_maturity", customer=customers) == [(3, 0, 3, 1, 1, 1, 0)]
    assert run("lag_histogram") == [("15-30", 1, 28.0)]
    assert run("message_links", orders=spark.createDataFrame(orders, ORDERS)) == [(5000, 5000, "title"), (5001, 5001, "link"), (5002, 5002, "title"), (5003, None, "several"), (5200, 5200, "title")]
    assert run("inventory_same_key_diff") == [(5200,)]


def _plain_text(page):
    page = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", page or "")
    page = re.sub(r"(?s)<[^>]*>", " ", page)
    for _ in range(3):
        for entity, sign in {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "ndash": "–", "mdash": "—", "amp": "&"}.items():
            page = page.replace(f"&{entity};", sign)
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", page).strip(" ")


def test_rows_that_were_hard_for_sql(spark, tmp_path):
    run = lambda name, **t: dict(x[:2] for x in _run(spark, tmp_path, name, **t))
    tails = ["\nRequirements:\n{}-9 years of work experience.", "\nPreferred qualifications:\nAt least five years of Go programming.", "\nYou have 3+ years of experience, 8 years of experience preferred.", ""]
    texts = ["We ask for 7 years of work.", "Needs 4+ yrs of Go work; 12 years of work preferred.", "Nice to have:\n6 years of C experience", "2 to 5 years of Rust.\nA company 30 years old.", "no figure", "10yrs", None, "3 years"]
    docs = list(enumerate(texts))
    assert run("experience_years", documents=spark.createDataFrame(docs, "doc_id long, text string")) == {i: plain_years((t or "") + tails[i % 4].format(2 + i % 3)) for i, t in docs}

    pages = ["<title>Research &amp; Development</title><p>a &amp;lt;b&amp;gt; c</p>", "<title>A <b>bold</b> one</title>x &apos;y&apos; &ndash; &mdash; z", "<title>t</title><!-- <script>var a; --> shown <!-- <style> --> too", "<script>if (a < b) {}</script>q<style>p {}</style>", "<title>plain</title> words \n here", None]
    rows = [(i, f"https://x.com/{i}", p) for i, p in enumerate(pages)]
    assert run("html_to_text", pages=spark.createDataFrame(rows, "page_id long, url string, html string")) == {i: _plain_text(p) for i, _, p in rows}
    title = lambda p: (re.search(r"(?is)<title>(.*?)</title>", p or "") or ["", ""])[1]
    assert run("read_pages") == {i: _plain_text(title(p)) for i, _, p in rows if p} | {5: ""}

    at = [datetime(2024, 1, 29, 23, 14, 59), datetime(2024, 1, 29, 23, 44, 59, 999_999), datetime(2024, 1, 29, 23, 45), datetime(2024, 1, 29, 23, 15), datetime(2024, 1, 30, 0, 0, 59), datetime(2024, 1, 31, 7, 20)]
    events = spark.createDataFrame([(i, t, 1, "view", 1.0, "{}") for i, t in enumerate(at)], EVENTS)
    states = {r[0]: r[1:] for r in _run(spark, tmp_path, "pull_states", events=events)}
    assert {i: s for i, (_, s) in states.items()} == {0: "stalled", 1: "delayed", 2: "live", 3: "delayed", 4: "live", 5: "live"}
    assert {i: b.replace(tzinfo=None) for i, (b, _) in states.items()} == {i: t.replace(minute=t.minute // 15 * 15, second=0, microsecond=0) for i, t in enumerate(at)}


def test_job_postings_in_any_block(spark):
    tag = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    job = lambda n, kind="JobPosting": {"@type": kind, "title": n, "hiringOrganization": {"name": "Acme"}, "identifier": {"value": n}}
    other = {"@type": "Organization", "title": "not a job", "name": "Acme"}
    pages = [tag(other) + tag(job("second")), tag([other, job("list"), job("list2")]), tag({"@graph": [other, job("graph", ["Thing", "JobPosting"])]}), tag([{"@graph": [job("deep")]}]) + "<script type='application/ld+json'>{broken</script>", tag(other), tag([[job("nested")]]), tag({"@graph": job("single")})]
    got = readers.read_job_posting_pages(spark.createDataFrame([(f"https://x.com/{i}", p) for i, p in enumerate(pages)], "url string, html string")).collect()
    assert sorted((r.external_id, r.title) for r in got) == [(x, x) for x in ("deep", "graph", "list", "list2", "nested", "second", "single")]


def test_recall_of_any_part(spark, tmp_path):
    items = [(1, "a b c d e f g h"), (2, "q w e r t y"), (3, "two words"), (4, "not held"), (5, "x b c d e f z"), (6, "")]
    docs = [(1, "zz c d e f\n g  h zz"), (2, "some two words here"), (3, "q w e r t"), (4, None), (5, "")]
    t = {"benchmark": spark.createDataFrame(items, "item_id long, text string"), "documents": spark.createDataFrame(docs, "doc_id long, text string")}
    assert _run(spark, tmp_path, "recall_lists", **t) == [(6, 2, 0.333333)]


def _trips(rows, most, within, first=600, longest=7200):
    """One lane's pauses, event after event."""
    recent, trips, until, out = [], 0, 0.0, []
    for t, refused in sorted(rows, key=lambda r: r[0]):
        if not refused:
            recent, trips = [], 0
        elif t >= until:
            recent = [x for x in recent if t - x <= within] + [t]
            if len(recent) >= most:
                pause = min(first * 2**trips, longest)
                trips, until, recent = trips + 1, t + pause, []
                out.append((t, pause, trips))
    return out


def test_breaker_matches_event_by_event(spark, tmp_path):
    rng, day = random.Random(4), datetime(2024, 1, 1)
    seen, rows = set(), []
    for i in range(600):
        user, at = rng.randint(1, 3), rng.randint(0, 200_000)
        if (user, at) not in seen:
            seen.add((user, at))
            rows.append((i, day + timedelta(seconds=at), user, rng.choice(["error"] * 5 + ["view"]), 1.0, "{}"))
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.lane, r.paused_at, r.pause_s, r.trips) for r in plans.QUERIES["stream_breaker"](spark, str(tmp_path)).collect())
    micros = lambda t: (t - datetime(1970, 1, 1)).total_seconds()
    want = sorted((str(u), *x) for u in (1, 2, 3) for x in _trips([(micros(t), k == "error") for _, t, v, k, _, _ in rows if v == u], 2, 3600))
    assert got == want and len(want) > 20
