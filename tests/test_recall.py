"""Held-out roles against postings: every pair of an employer by hand, and an employer of 20,000 postings."""

import random

from pyspark.sql import functions as F

from strataline.functions import text, urls
from strataline.operators import matching

LISTED = "role_id int, company string, title string, link string"
JOBS = "id int, source string, company string, title string, official_url string"


def described(df, link):
    """What the match is about, as plain Python values."""
    rows = df.select("*", text.company_keys(F.col("company")).alias("keys"), text.title_forms(F.col("title")).alias("forms"), text.title_core(F.col("title")).alias("core"), text.is_early_title(F.col("title")).alias("early"), urls.place_key(F.col(link)).alias("place"), urls.tokens(F.col(link)).alias("tokens"), F.coalesce(F.col("title").rlike(matching.INTERN_TITLE), F.lit(False)).alias("intern"))
    return rows.collect()


def met(role, jobs):
    """The postings that are the role, by trying each."""
    own = [j for j in jobs if set(j["keys"]) & set(role["keys"]) and (role.intern or not j.intern)]
    same = {j.id for j in own}
    exact = [j for j in jobs if (role.place and j.place == role.place) or any(t in (j.tokens or []) and (j.id in same or len(t) >= 8) for t in role.tokens or [])]
    if exact:
        return exact
    if title := [j for j in own if set(j.forms) & set(role.forms)]:
        return title
    mine, names, out = set(role.core), {w for k in role["keys"] for w in k.split()}, []
    for j in own:
        small, large = sorted((mine, set(j.core)), key=len)
        if len(mine) >= 2 and j.early and len(small) >= 2 and small <= large and len(large - small - names) <= 3:
            out.append(j)
    return out


def test_every_pair(spark):
    rng = random.Random(21)
    companies = ["Acme, Inc.", "Acme Industries", "acme", "Beta Systems LLC", "Beta", "Gamma", None, "Delta Labs"]
    words = ["Software", "Engineer", "Backend", "Data", "Payments", "New Grad", "2026", "Graduate", "Intern", "Acme", "-", "(Search)", "University", "Platform", "Senior", "Search"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    link = lambda: rng.choice([None, "", f"https://x.com/jobs/{rng.randint(0, 30)}", f"https://x.com/p?id=1234567{rng.randint(0, 9)}", f"https://www.X.com/a/job{rng.randint(0, 9)}1/", "not a link"])
    listed = spark.createDataFrame([(i, rng.choice(companies), title(), link()) for i in range(250)], LISTED)
    jobs = spark.createDataFrame([(i, rng.choice(["simplify", "greenhouse", "board"]), rng.choice(companies), title(), link()) for i in range(250)], JOBS)
    told = described(jobs, "official_url")
    want = {}
    for role in described(listed, "link"):
        own = met(role, told)
        want[role.role_id] = "missed" if not own else "board" if any(j.source != "simplify" for j in own) else "feed"
    got = {r.role_id: r.outcome for r in matching.recall(listed, jobs, ("simplify",)).collect()}
    assert got == want
    assert min(list(want.values()).count(x) for x in ("missed", "board", "feed")) > 10


def test_an_employer_of_many_postings(spark):
    """100 roles and 20,000 postings of one employer have two million pairs; few are compared."""
    rng = random.Random(4)
    teams = [f"team{i}" for i in range(400)]
    core = lambda: sorted({"software", "engineer", rng.choice(teams), rng.choice(["backend", "data", "web", "mobile"])})
    left = spark.createDataFrame([("acme", i, core()) for i in range(100)], "ck string, role_id int, core array<string>")
    right = spark.createDataFrame([("acme", i, core()) for i in range(20_000)], "ck string, id int, r_core array<string>")
    pairs = matching.core_candidates(left, right)
    assert pairs.count() < 20_000
    inside = pairs.where((F.size(F.array_except("core", "r_core")) == 0) | (F.size(F.array_except("r_core", "core")) == 0)).select("role_id", "id").collect()
    lefts, rights = [(r.role_id, set(r.core)) for r in left.collect()], [(r.id, set(r.r_core)) for r in right.collect()]
    assert {tuple(x) for x in inside} == {(i, j) for i, a in lefts for j, b in rights if a <= b or b <= a}


def test_no_roles_and_no_postings(spark):
    listed, jobs = spark.createDataFrame([(1, "Acme", "Engineer", None)], LISTED), spark.createDataFrame([], JOBS)
    assert [tuple(r) for r in matching.recall(listed, jobs, ()).collect()] == [(1, "missed")]
    assert matching.recall(listed.limit(0), jobs, ()).count() == 0


def test_overlapping_titles(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    title = lambda: sorted(rng.sample(words, rng.randint(0, 6)))
    left = spark.createDataFrame([(rng.choice("ab"), title()) for _ in range(150)], "c string, t array<string>").distinct()
    right = spark.createDataFrame([(rng.choice("ab"), title()) for _ in range(150)], "c string, o array<string>").distinct()
    got = sorted((r.c, r.t, r.o) for r in matching.overlapping(left, right, 0.75).collect())
    want = sorted((a.c, a.t, b.o) for a in left.collect() for b in right.collect() if a.c == b.c and a.t and b.o and len(set(a.t) & set(b.o)) >= 0.75 * min(len(a.t), len(b.o)))
    assert got == want and len(want) > 100


def test_rows_of_one_employer_keep_eight_candidates(spark):
    stored = spark.createDataFrame([(i, "Acme", f"Platform Engineer {'Payments' if i % 2 else ''}", None, "NYC", False) for i in range(40)], "id long, company string, title string, official_url string, location string, is_applied boolean")
    rows = spark.createDataFrame([(1, "Acme", "Platform Engineer", None, ""), (2, "Acme", "Platform Engineer Payments Core", None, "")], "row_number long, company string, title string, url string, location string")
    out = {r.row_number: (r.status, r.method, r.candidates) for r in matching.resolve(rows, stored).collect()}
    assert out == {1: ("ambiguous", "title", list(range(0, 16, 2))), 2: ("ambiguous", "overlap", list(range(8)))}
