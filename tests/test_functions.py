import html
import random
from datetime import date, datetime
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from strataline.functions import dates, text, urls
from strataline.operators import scoring


def one(spark, column, **values):
    row = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[v.alias(k) for k, v in row.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.com/en-US/Jobs/1", "https://example.com/jobs/1"),
    ("https://example.com/a", "https://example.com/a"),
    (None, None),
])
def test_link_key(spark, url, key):
    assert one(spark, urls.link_key(F.col("u").cast("string")), u=url) == key


@pytest.mark.parametrize(("url", "key"), [
    ("https://www.example.com/a/?utm_source=x&b=2&a=1", "example.com/a?a=1&b=2"),
    ("example.com/jobs?gh_jid=12", "example.com/jobs?gh_jid=12"),
    ("  ", None),
    ("https://example.com/a?ref=&src=z", "example.com/a"),
    ("ht tp://bad", None),
    ("https://WWW.Example.com/jobs/12/?UTM_Source=x&Job_Id=A%20b&empty=", "example.com/jobs/12?job_id=A b"),
    ("example.com/x?b=2&B=1&a+c=d%3De", "example.com/x?b=1&a c=d=e&b=2"),
])
def test_normalized(spark, url, key):
    assert one(spark, urls.normalized(F.col("u")), u=url) == key


def test_hiring_system(spark):
    found = lambda u: one(spark, urls.hiring_system(F.col("u")), u=u)
    assert tuple(found("https://boards.greenhouse.io/acme/jobs/1")) == ("greenhouse", "acme")
    assert tuple(found("jobs.lever.co/Beta/x")) == ("lever", "beta")
    assert tuple(found("https://gamma.wd5.myworkdayjobs.com/x")) == ("workday", "gamma")
    assert found("https://example.com/greenhouse.io") is None


@pytest.mark.parametrize(("name", "key"), [("Stripe, Inc.", "stripe"), ("OPEN  AI Labs", "open ai"), (None, ""), ("Inc", "")])
def test_company_key(spark, name, key):
    assert one(spark, text.company_key(F.col("c").cast("string")), c=name) == key


def test_company_keys(spark):
    assert one(spark, text.company_keys(F.col("c")), c="Anvil Industries Global, Inc.") == ["anvil industries global", "anvil industries", "anvil"]
    assert one(spark, text.company_keys(F.col("c")), c="Global") == ["global"]
    assert one(spark, text.company_keys(F.col("c")), c="") == []
    assert len(one(spark, text.company_keys(F.col("c")), c="Acme Global Digital Software Systems Solutions Services")) == 7


def test_titles(spark):
    assert one(spark, text.title_tokens(F.col("t")), t="SDE II, New Grad (ML)") == ["development", "engineer", "learning", "machine", "software"]
    assert one(spark, text.title_forms(F.col("t")), t="New Grad 2027: Software Engineer - Search") == ["software engineer", "software engineer search"]
    assert one(spark, text.title_core(F.col("t")), t="Software Engineer, New Grad 2027") == ["software", "engineer"]
    assert one(spark, text.places_match(F.col("a"), F.col("b")), a="Seattle, WA", b="seattle") is True


def test_html(spark):
    assert one(spark, text.html_to_text(F.col("h")), h="<p>a &amp; b</p><script>x<y</script><!-- c --> d&nbsp;e") == "a & b d e"
    assert one(spark, text.unescape(F.col("h")), h="&amp;amp;lt;") == "<"


def test_entities_as_the_library_reads_them(spark):
    """All names, numbers in both notations, old names without their closing mark, and what is no entity at all."""
    rng = random.Random(8)
    some = [f"&{n}" for n in rng.sample(sorted(html5), 300)] + [f"&#{n};" for n in (0, 9, 11, 13, 31, 39, 65, 127, 128, 129, 146, 159, 160, 233, 8217, 55296, 64976, 65535, 128512, 1114111, 1114112, 99999999999)]
    some += [f"&#x{n:X};" for n in (0x27, 0x2019, 0x1F600)] + ["&#X41", "&#65", "&#", "&#x;", "&", "&;", "&nosuch;", "&notit;", "&ampamp;", "&LT", "&copycat", "plain", " ", "&amp;eacute;"]
    rows = [(i, "".join(rng.choice(some) + rng.choice(["", " ", "x"]) for _ in range(rng.randint(1, 6)))) for i in range(400)] + [(1000 + i, x) for i, x in enumerate(some)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "i long, t string")

    def whole(t):
        for _ in range(5):
            t = html.unescape(t)
        return t

    got = {r.i: r.u for r in df.select("i", text.unescape(F.col("t")).alias("u")).collect()}
    wrong = {t: (got[i], whole(t)) for i, t in rows if t is not None and got[i] != whole(t)}
    assert not wrong and got[5000] is None


@pytest.mark.parametrize(("written", "day"), [
    ("2024-03-05", date(2024, 3, 5)), ("3/5/2024", date(2024, 3, 5)), ("13/2/2024", date(2024, 2, 13)), ("Mar 5, 2024", date(2024, 3, 5)),
    ("Mar 5", date(2024, 3, 5)), ("Nov 12", date(2023, 11, 12)), ("soon", None), (None, None), ("", None),
])
def test_parse_date(spark, written, day):
    assert one(spark, dates.parse_date(F.col("d").cast("string"), date(2024, 3, 10)), d=written) == day


def test_relative_day(spark):
    day = lambda s: one(spark, dates.relative_day(F.col("s"), F.lit(date(2024, 3, 10))), s=s)
    assert day("Posted Today") == date(2024, 3, 10)
    assert day("Posted 3 Days Ago") == date(2024, 3, 7)
    assert day("Posted 30+ Days Ago") is None


def test_local_days(spark):
    # the day on which clocks go forward has 23 hours
    start = one(spark, dates.day_start(F.col("d"), "America/Los_Angeles"), d=date(2024, 3, 10))
    end = one(spark, dates.day_start(F.col("d"), "America/Los_Angeles"), d=date(2024, 3, 11))
    assert (end - start).total_seconds() == 23 * 3600


def test_match_score(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    related = scoring.related_map([("go", "rust")])
    m = scoring.match(words("c", "go", "java", "sql"), words("c", "rust", "sql"), related, F.lit(True))
    row = one(spark, m, x=1)
    assert (row.score, row.matched, row.related, row.evidence, row.missing) == (62, ["c", "sql"], ["go"], ["rust"], ["java"])
    few = one(spark, scoring.match(words("c", "go"), words("c"), related, F.lit(True)), x=1)
    assert few.score is None and few.matched == ["c"]
    none = one(spark, scoring.match(words("c", "go", "sql"), words("c"), related, F.lit(False)), x=1)
    assert none.score is None and none.matched == []


def test_intent(spark):
    intent = lambda b: one(spark, scoring.message_intent(F.col("b")), b=b)
    assert intent("Thank you for applying. We regret to inform you.") == "rejection"
    assert intent("If we extend an offer, we call you.") == "unknown"
    assert intent("Thank you for applying.") == "confirmation"


def test_pull_state(spark):
    now = F.lit(datetime(2024, 1, 1, 12))
    state = lambda m: one(spark, dates.pull_state(F.lit(m).cast("timestamp_ntz"), now), x=1)
    assert [state(datetime(2024, 1, 1, 11, 50)), state(datetime(2024, 1, 1, 11, 20)), state(datetime(2024, 1, 1, 9)), state(None)] == ["live", "delayed", "stalled", "unknown"]
