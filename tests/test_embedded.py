"""Planted pages of two boards: rows by position and by path, and broken parts beside them."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from strataline.sources import embedded


def listed(rows):
    return f"<script>AF_initDataCallback({{key: 'ds:0', hash: '1', data:[1], sideChannel: {{}}}});</script><script nonce=x>AF_initDataCallback({{key: 'ds:1', hash: '2', data:{json.dumps([rows])}, sideChannel: {{}}}});</script>"


def row(number, title, **at):
    out = [number, title, None, [None, "<p>Build &amp; ship</p>"], None, None, None, "YouTube", None, [["New York, NY, USA"], ["Austin, TX, USA"]], [None, "<p>Summary</p>"], None, [1704067200, 5], None, [1704153600, 0]]
    for i, v in at.items():
        out[int(i[1:])] = v
    return out


def test_rows_by_position(spark):
    pages = [
        ("p1", listed([row(11, " Software   Engineer, II "), row("12", "Data Scientist", _7=None, _9=None, _3="moved", _12="x"), row(None, "No id"), row("14", None), "not a list", row(15, {"title": "moved"})])),
        ("p2", listed([])), ("p3", "<html>nothing</html>"), ("p4", None), ("p5", listed([row(1, "x")]).replace("[[[", "[[[[")), ("p6", listed("moved")),
    ]
    rows, broken = embedded.read_positional(spark.createDataFrame(pages, "url string, html string"))
    got = {r.external_id: r for r in rows.collect()}
    assert set(got) == {"11", "12"}
    a, b = got["11"], got["12"]
    assert (a.title, a.company, a.location, a.official_url) == ("Software Engineer, II", "YouTube", "New York, NY, USA; Austin, TX, USA", embedded.LIST_POSTING + "11-software-engineer-ii")
    assert (a.posted_at, a.updated_at) == (datetime(2024, 1, 1), datetime(2024, 1, 2)) and "Build & ship" in a.description and "Summary" in a.description
    assert (b.company, b.location, b.posted_at) == ("Google", "United States", None) and "moved" not in b.description
    told = sorted((r.page, r.reason) for r in broken.collect())
    assert [x for x in told if x[0] != "p1"] == [("p3", "no data"), ("p4", "no data"), ("p5", "not JSON"), ("p6", "no rows")]
    assert told.count(("p1", "row without a title")) == 2 and told.count(("p1", "row without an id")) == 2


def test_rows_in_a_string(spark):
    data = {"loaderData": {"search": {"searchResults": [
        {"positionId": "200", "postingTitle": "ML  Engineer", "transformedPostingTitle": "ml-engineer", "locations": [{"name": "Cupertino"}, {"name": None}], "homeOffice": True, "postDateInGMT": "2026-10-09T01:57:37.474065956Z", "jobSummary": "a \"quoted\" word"},
        {"positionId": 201, "postingTitle": "SWE", "locations": "moved", "homeOffice": "moved", "postDateInGMT": 5}, {"postingTitle": "no id"}, {"positionId": "202"},
    ]}}}
    page = lambda d: f"<script>window.__staticRouterHydrationData = JSON.parse({json.dumps(json.dumps(d))});</script>"
    pages = [("p1", page(data)), ("p2", page({"loaderData": {}})), ("p3", "none"), ("p4", page(data).replace('{\\"loaderData', '{\\"loader[Data'))]
    rows, broken = embedded.read_stringed(spark.createDataFrame(pages, "url string, html string"))
    got = {r.external_id: r for r in rows.collect()}
    assert set(got) == {"200", "201"}
    a, b = got["200"], got["201"]
    assert (a.title, a.location, a.official_url, a.description) == ("ML Engineer", "Cupertino, United States; Remote, United States", embedded.STRING_POSTING + "200/ml-engineer", 'a "quoted" word')
    assert a.posted_at.replace(microsecond=0) == datetime(2026, 10, 9, 1, 57, 37) and (b.title, b.location, b.posted_at) == ("SWE", "", None)
    assert sorted((r.page, r.reason) for r in broken.collect()) == [("p1", "row without a title"), ("p1", "row without an id"), ("p2", "no rows"), ("p3", "no data"), ("p4", "no rows")]
    empty = spark.createDataFrame([], "url string, html string")
    assert [df.count() for read in (embedded.read_stringed, embedded.read_positional) for df in read(empty)] == [0, 0, 0, 0]
    assert set(rows.columns) >= {"source", "title", "official_url"} and rows.select(F.col("source")).distinct().count() == 1
