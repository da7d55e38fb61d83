"""Joins that find copies, owners and earlier records of a posting.

Everything is an equi-join on a derived key, with what can't be a key as a
residual test; a disjunction is a union of two such joins.  No side is
broadcast by hand: its size is the optimizer's business.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import text, urls
from strataline.session import Scratch


def hide_copies(feed: DataFrame, direct: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    """Rows of `feed` that no row of `direct` equals in all keys; a null key equals nothing.

    Each key is (column of feed, column of direct).
    """
    names = [f"__k{i}" for i in range(len(keys))]
    left = feed.select("*", *[a.alias(n) for n, (a, _) in zip(names, keys, strict=True)])
    right = direct.select(*[b.alias(n) for n, (_, b) in zip(names, keys, strict=True)]).distinct()
    return left.join(right, names, "left_anti").select(*feed.columns)


def suppress_feed_copies(postings: DataFrame, feeds: tuple[str, ...], blocked: DataFrame | None = None, source: str = "source", company: str = "company", title: str = "title", url: str = "official_url", active: str = "is_active") -> DataFrame:
    """Postings without the feed rows that an active direct posting repeats (by company and title, or by link), or whose company a blocked source names."""
    is_feed = F.col(source).isin(*feeds)
    direct = postings.where(~is_feed)
    live = direct.where(F.col(active))
    feed = postings.where(is_feed)
    key = lambda c: text.plain_key(F.col(c))
    feed = hide_copies(feed, live, [(key(company), key(company)), (key(title), key(title))])
    feed = hide_copies(feed, live, [(urls.link_key(F.col(url)), urls.link_key(F.col(url)))])
    if blocked is not None:
        feed = hide_copies(feed, blocked, [(key(company), key("company_name"))])
    return direct.unionByName(feed)


def first_of_either(left: DataFrame, right: DataFrame, keys: list[list[tuple[str, str]]], id_col: str, least: str) -> DataFrame:
    """left_id, first: for rows of `left` that some row of `right` equals in any one of several key lists, the least value of `least` among these.

    `right` is summed up by each key list before it is joined, so a key of any
    number of rows on both sides gives no more rows than `left` has.
    """
    parts = []
    for pairs in keys:
        names = [f"__k{i}" for i in range(len(pairs))]
        told = right.select(*[F.col(b).alias(n) for n, (_, b) in zip(names, pairs, strict=True)], F.col(least).alias("first")).groupBy(*names).agg(F.min("first").alias("first"))
        parts.append(left.select(F.col(id_col).alias("left_id"), *[F.col(a).alias(n) for n, (a, _) in zip(names, pairs, strict=True)]).join(told, names).select("left_id", "first"))
    return reduce(DataFrame.union, parts).groupBy("left_id").agg(F.min("first").alias("first"))


def opened_within(postings: DataFrame, states: DataFrame, keys: list[str], cutoff: Column, feeds: tuple[str, ...], posted: str = "posted_at", seen: str = "first_seen_at", source: str = "source") -> DataFrame:
    """Posted (or else seen) after the cutoff, or seen after it directly and after the source's baseline."""
    joined = postings.join(states.select(*keys, F.col("initialized_at").alias("__base")), keys, "left")
    late = (F.col(seen) > cutoff) & ~F.col(source).isin(*feeds) & F.coalesce(F.col(seen) > F.col("__base"), F.lit(False))
    return joined.where((F.coalesce(posted, seen) > cutoff) | late).select(*postings.columns)


def applied_before(rows: DataFrame, key: list[Column], id_col: str, place: Column, applied: str, countries: tuple[str, ...] = ("united states", "usa", "us", "remote")) -> DataFrame:
    """id, n_before, last_applied: other rows with the same key at the same place, or at one of which only the country is known."""
    names = [f"__k{i}" for i in range(len(key))]
    keyed = rows.select(F.col(id_col).alias("__id"), F.col(applied).alias("__at"), place.alias("__place"), *[k.alias(n) for k, n in zip(key, names, strict=True)])
    history = keyed.where(F.col("__at").isNotNull())
    same = (F.col("a.__place") == F.col("b.__place")) | F.col("a.__place").isin(*countries) | F.col("b.__place").isin(*countries)
    met = keyed.alias("a").join(history.alias("b"), [F.col(f"a.{n}") == F.col(f"b.{n}") for n in names] + [F.col("a.__id") != F.col("b.__id"), same])
    return met.groupBy(F.col("a.__id").alias(id_col)).agg(F.count("*").alias("n_before"), F.max("b.__at").alias("last_applied"))


def overlapping(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """c, t, o: word sets t of left and o of right, of one company c, that share at least `threshold` of the smaller one.

    The smaller set has a shared word among its rarest ones: if it has s words,
    ceil(threshold * s) have to be shared, so one of the s - that + 1 rarest is.
    Only these are its keys, and all words of the larger one are looked up.
    """
    counts = right.select("c", F.explode("o").alias("word")).groupBy("c", "word").agg(F.count("*").alias("n"))

    def keyed(rows: DataFrame, words: str) -> DataFrame:
        each = rows.select("c", words, F.explode(words).alias("word")).join(counts, ["c", "word"], "left")
        ranked = each.groupBy("c", words).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("by"))  # a title's words
        few = F.size(words) - F.ceil(F.lit(threshold) * F.size(words) - 1e-9).cast("int") + 1
        return ranked.select("c", words, F.explode(F.slice(F.col("by.word"), 1, few)).alias("word"))

    all_ = lambda rows, words: rows.select("c", words, F.explode(words).alias("word"))
    short_left = keyed(left, "t").join(all_(right, "o"), ["c", "word"]).where(F.size("t") <= F.size("o"))
    short_right = all_(left, "t").join(keyed(right, "o"), ["c", "word"]).where(F.size("t") > F.size("o"))
    met = short_left.select("c", "t", "o").unionByName(short_right.select("c", "t", "o")).distinct()
    return met.where(text.overlap(F.col("t"), F.col("o")) >= threshold)


#: Members of a block of one word set, and pairs of rows that a task makes, about.
BLOCK, PAIRS = 4096, 8_000_000


def overlapping_pairs(rows: DataFrame, threshold: float, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """id, other, share: pairs id < other of one company c whose word sets t share at least `threshold` of the smaller one.

    Only different sets are compared, each once.  What two sets share then
    holds for all their rows, so every row of the result costs no more than
    itself: rows of a set come in blocks of about `block`, and two blocks meet
    in a row of their own, dealt to as many tasks as there are pairs to make.
    """
    scratch = Scratch(rows.sparkSession, "pairs")
    sets = scratch.save(rows.where("c is not null").groupBy("c", "t").agg(F.count("*").alias("n")).withColumn("k", F.monotonically_increasing_id()).withColumn("n_blocks", F.ceil(F.col("n") / block)), "sets")
    own = rows.join(sets, ["c", "t"]).select("id", "k", F.pmod(F.xxhash64("id"), "n_blocks").alias("i"))
    members = scratch.save(own.groupBy("k", "i").agg(F.collect_list("id").alias("ids")), "members")
    met = overlapping(sets.select("c", "t"), sets.select("c", F.col("t").alias("o")), threshold)
    # columns of each side as (k, n, n_blocks), then blocks against blocks, those of one set each once
    side = lambda words, x: sets.select("c", F.col("t").alias(words), F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("n_blocks").alias(f"b{x}"))
    linked = met.join(side("t", 1), ["c", "t"]).join(side("o", 2), ["c", "o"]).where("k1 <= k2")
    links = scratch.save(linked.select("k1", "k2", "n1", "n2", "b1", "b2", text.overlap(F.col("t"), F.col("o")).alias("share")), "links")
    many = links.agg(F.sum(F.col("n1") * F.col("n2"))).head()[0] or 0
    units = links.select("k1", "k2", "share", F.explode(F.sequence(F.lit(0), F.col("b1") - 1)).alias("i1"), "b2").select("*", F.explode(F.sequence(F.lit(0), F.col("b2") - 1)).alias("i2")).where("k1 < k2 or i1 <= i2")
    for x in (1, 2):
        units = units.join(members.select(F.col("k").alias(f"k{x}"), F.col("i").alias(f"i{x}"), F.col("ids").alias(f"ids{x}")), [f"k{x}", f"i{x}"])
    units = units.repartition(min(many // pairs + 1, 20_000), "k1", "i1", "k2", "i2")
    alone = ((F.col("k1") == F.col("k2")) & (F.col("i1") == F.col("i2"))).alias("alone")
    each = units.select(alone, "share", F.explode("ids1").alias("x"), "ids2").select("alone", "share", "x", F.explode("ids2").alias("y"))
    return each.where("x < y or (x > y and not alone)").select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other"), "share")


def resolve(imported: DataFrame, stored: DataFrame, threshold: float = 0.75, most: int = 8) -> DataFrame:
    """row_number, status, method, job_id, candidates: each imported row's posting.

    imported: row_number, company, title, url, location; stored: id, company,
    title, official_url, location, is_applied.  Rows go down a cascade; what a
    tier decides does not reach the next: link, path that names one posting,
    equal title words within the company, title overlap within the company.
    Of several, the only one applied to wins, else the only one at the place,
    else the row is ambiguous.
    """
    rows = imported.select("row_number", "company", "title", "url", "location", urls.normalized(F.col("url")).alias("u"), text.company_tight_key(F.col("company")).alias("c"), text.title_tokens(F.col("title")).alias("t"))
    jobs = stored.select("id", "location", "is_applied", urls.normalized(F.col("official_url")).alias("u"), text.company_tight_key(F.col("company")).alias("c"), text.title_tokens(F.col("title")).alias("t"))
    # saved, as several joins read them, and links and titles would be worked out anew for each
    scratch = Scratch(imported.sparkSession, "resolve")
    rows, jobs = scratch.save(rows, "rows"), scratch.save(jobs, "jobs")
    blank = (F.col("u").isNull()) & ((F.trim(F.coalesce("company", F.lit(""))) == "") | (F.trim(F.coalesce("title", F.lit(""))) == ""))
    unusable = rows.where(blank)
    rows = rows.where(~blank)

    def decided(found: DataFrame, method: str) -> DataFrame:
        return found.select("row_number", F.lit("matched").alias("status"), F.lit(method).alias("method"), "job_id", F.array().cast("array<long>").alias("candidates"))

    first = jobs.where("u is not null").groupBy("u").agg(F.min("id").alias("job_id"))
    by_url = decided(rows.join(first, "u").select("row_number", "job_id"), "url")
    rest = rows.join(by_url, "row_number", "left_anti")
    strip = lambda c: F.split_part(c, F.lit("?"), F.lit(1))
    lone = jobs.where("u is not null").groupBy(strip(F.col("u")).alias("p")).agg(F.min("id").alias("job_id"), F.count("*").alias("n")).where("n = 1")
    by_path = decided(rest.withColumn("p", strip(F.col("u"))).join(lone, "p").select("row_number", "job_id"), "path")
    rest = rest.join(by_path, "row_number", "left_anti").where("c <> ''")
    titles = scratch.save(rest.select("row_number", "c", "t", F.col("location").alias("wanted")), "titles")
    offers = scratch.save(jobs.where("c <> ''").select("c", F.col("t").alias("o"), F.col("id").alias("job_id"), "is_applied", F.col("location").alias("place")), "offers")
    same = titles.join(offers, (titles["c"] == offers["c"]) & (titles["t"] == offers["o"])).select("row_number", "wanted", "job_id", "is_applied", "place", F.lit(True).alias("same"))
    others = titles.join(same.select("row_number").distinct(), "row_number", "left_anti")
    # titles of one employer are compared as sets of words, each set once
    sets = overlapping(others.select("c", "t").distinct(), offers.select("c", "o").distinct(), threshold)
    like = others.join(sets, ["c", "t"]).join(offers, ["c", "o"]).select("row_number", "wanted", "job_id", "is_applied", "place", F.lit(False).alias("same"))
    pool = same.unionByName(like).withColumn("here", text.places_match(F.col("wanted"), F.col("place")))
    told = pool.groupBy("row_number").agg(
        F.count("*").alias("n"),
        F.max("same").alias("same"),
        F.min("job_id").alias("only"),
        F.count_if("is_applied").alias("n_applied"),
        F.min(F.when(F.col("is_applied"), F.col("job_id"))).alias("applied_id"),
        F.count_if("here").alias("n_here"),
        F.min(F.when(F.col("here"), F.col("job_id"))).alias("here_id"),
    )
    first = pool.withColumn("place_", F.row_number().over(Window.partitionBy("row_number").orderBy("job_id"))).where(F.col("place_") <= most)
    told = told.join(first.groupBy("row_number").agg(F.array_sort(F.collect_list("job_id")).alias("some")), "row_number")
    job = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_applied") == 1, F.col("applied_id")).when(F.col("n_here") == 1, F.col("here_id"))
    by_title = told.select("row_number", F.when(job.isNotNull(), "matched").otherwise("ambiguous").alias("status"), F.when(F.col("same"), "title").otherwise("overlap").alias("method"), job.alias("job_id"), F.when(job.isNull(), F.col("some")).otherwise(F.array().cast("array<long>")).alias("candidates"))
    done = by_url.unionByName(by_path).unionByName(by_title)
    none = F.lit(None).cast("long").alias("job_id")
    empty = F.array().cast("array<long>").alias("candidates")
    left = imported.select("row_number").join(done, "row_number", "left_anti").join(unusable.select("row_number"), "row_number", "left_anti")
    unmatched = left.select("row_number", F.lit("unmatched").alias("status"), F.lit(None).cast("string").alias("method"), none, empty)
    return done.unionByName(unmatched).unionByName(unusable.select("row_number", F.lit("unusable").alias("status"), F.lit(None).cast("string").alias("method"), none, empty))


#: Titles of internships, words that one title may have more than the other, and letters of a link token that names a posting by itself.
INTERN_TITLE = r"(?i)\b(?:intern|interns|internship|co-?op)\b"
MOST_EXTRA, LONE_TOKEN = 3, 8


def _rarest(cores: DataFrame, counts: DataFrame) -> DataFrame:
    """`cores` (ck, core, ...) with the word of each core that the fewest cores of its company hold."""
    own = [c for c in cores.columns]
    words = cores.select(*own, F.explode("core").alias("word")).join(counts, ["ck", "word"], "left")
    return words.groupBy(*own).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).select(*own, F.col("r.word").alias("word"))


def core_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of cores of one company of which the smaller may lie in the larger: all that do are among them.

    left: ck, core and others; right: ck, r_core and others; cores are sets of
    two words or more.  If the smaller core lies in the larger, its rarest word
    does, so only that is its key, and the larger one's words are looked up.
    """
    counts = right.select("ck", F.explode("r_core").alias("word")).groupBy("ck", "word").agg(F.count("*").alias("n"))
    turned = right.withColumnRenamed("r_core", "core")
    short_left = _rarest(left, counts).join(right.select("*", F.explode("r_core").alias("word")), ["ck", "word"]).where(F.size("core") <= F.size("r_core"))
    short_right = left.select("*", F.explode("core").alias("word")).join(_rarest(turned, counts).withColumnRenamed("core", "r_core"), ["ck", "word"]).where(F.size("core") > F.size("r_core"))
    return short_left.unionByName(short_right).drop("word")


def recall(listed: DataFrame, jobs: DataFrame, feeds: tuple[str, ...]) -> DataFrame:
    """role_id, outcome: board, feed or missed for each listed role.

    listed: role_id, company, title, link; jobs: id, source, company, title,
    official_url.  A role is met by its link (an equal place, an equal token
    within its company, or one of LONE_TOKEN letters anywhere); else by an
    equal title form within its company; else by early-career postings whose
    core lies in its own, or the other way round, with at most MOST_EXTRA
    words more, those of the company's name aside.  No internship meets a role
    that is none.

    Postings are summed up by each key before they are joined, so an employer
    of any number of postings gives a row or two for each key.
    """
    listed = listed.select("role_id", "company", "title", "link")
    intern = lambda c: F.coalesce(F.col(c).rlike(INTERN_TITLE), F.lit(False))
    core = lambda c: F.array_sort(F.array_distinct(text.title_core(F.col(c))))
    keys = text.company_keys(F.col("company"))
    l = listed.select("role_id", keys.alias("cks"), intern("title").alias("intern"), text.title_forms(F.col("title")).alias("forms"), core("title").alias("core"), urls.place_key(F.col("link")).alias("uk"), urls.tokens(F.col("link")).alias("tok"))  # noqa: E741
    r = jobs.select(F.col("source").isin(*feeds).alias("feed"), keys.alias("cks"), intern("title").alias("r_intern"), text.title_forms(F.col("title")).alias("forms"), core("title").alias("r_core"), text.is_early_title(F.col("title")).alias("early"), urls.place_key(F.col("official_url")).alias("uk"), urls.tokens(F.col("official_url")).alias("tok"))
    best = lambda df, *by: df.groupBy(*by).agg(F.min("feed").alias("feed"))
    fits = F.col("intern") | ~F.col("r_intern")
    near, far = l.select("*", F.explode("cks").alias("ck")), r.select("*", F.explode("cks").alias("ck"))

    def tier(n: int, met: DataFrame) -> DataFrame:
        return met.select("role_id", F.lit(n).alias("tier"), "feed")

    by_place = l.where("uk <> ''").join(best(r.where("uk <> ''"), "uk"), "uk")
    tokens = best(far.select("ck", "r_intern", "feed", F.explode("tok").alias("t")), "ck", "t", "r_intern")
    by_token = near.select("role_id", "ck", "intern", F.explode("tok").alias("t")).join(tokens, ["ck", "t"]).where(fits)
    lone = best(r.select("feed", F.explode("tok").alias("t")).where(F.length("t") >= LONE_TOKEN), "t")
    by_lone = l.select("role_id", F.explode("tok").alias("t")).join(lone, "t")
    forms = best(far.select("ck", "r_intern", "feed", F.explode("forms").alias("form")), "ck", "form", "r_intern")
    by_form = near.select("role_id", "ck", "intern", F.explode("forms").alias("form")).join(forms, ["ck", "form"]).where(fits)
    named = F.array_distinct(F.flatten(F.transform("cks", lambda k: F.split(k, " "))))
    mine = near.where(F.size("core") >= 2).select("role_id", "ck", "intern", "core", named.alias("named"))
    theirs = best(far.where(F.col("early") & (F.size("r_core") >= 2)), "ck", "r_core", "r_intern")
    small, large = F.when(F.size("core") <= F.size("r_core"), F.col("core")).otherwise(F.col("r_core")), F.when(F.size("core") <= F.size("r_core"), F.col("r_core")).otherwise(F.col("core"))
    more = F.array_except(F.array_except(large, small), F.col("named"))
    by_core = core_candidates(mine, theirs).where(fits & (F.size(F.array_except(small, large)) == 0) & (F.size(more) <= MOST_EXTRA))
    met = reduce(DataFrame.union, [tier(1, by_place), tier(1, by_token), tier(1, by_lone), tier(2, by_form), tier(3, by_core)])
    told = met.groupBy("role_id").agg(F.min(F.struct("tier", "feed")).alias("m"))
    return listed.select("role_id").join(told, "role_id", "left").select("role_id", F.when(F.col("m").isNull(), "missed").when(F.col("m.feed"), "feed").otherwise("board").alias("outcome"))


def inventory(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """shared, left_only, right_only: distinct keys in both inventories and in one."""
    a, b = left.select(*key).distinct().withColumn("__l", F.lit(1)), right.select(*key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("shared"), F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"))


#: Largest set of different windows that is broadcast (some 100 bytes each).
MOST_WINDOWS = 1_000_000


def window_recall(items: DataFrame, docs: DataFrame, key: str, words: str, size: int = 6) -> DataFrame:
    """listed, reached, recall: how many items share a window of `size` words (fewer, if the item has) with any document.

    The documents' windows stream past the different windows of the items,
    which are broadcast while they are few; what is met is made distinct in
    each task before it moves.  Items without words are never reached.
    """
    each = F.expr(f"explode(transform(sequence(1, size(`{words}`) - n + 1), i -> array_join(slice(`{words}`, i, n), ' ')))").alias("g")
    listed = items.withColumn("n", F.least(F.size(words), F.lit(size))).where("n > 0").select(key, "n", each).where("g <> ''")
    told = listed.select("n", "g").distinct()
    lengths = F.array(*[F.lit(r.n) for r in told.select("n").distinct().collect()]).cast("array<int>")  # at most `size` numbers
    held = docs.select(words, F.explode(lengths).alias("n")).where(F.size(words) >= F.col("n")).select("n", each)
    met = held.join(F.broadcast(told) if told.count() <= MOST_WINDOWS else told, ["n", "g"], "left_semi").distinct()
    reached = listed.join(met, ["n", "g"], "left_semi").select(key).distinct().withColumn("hit", F.lit(1))
    return items.select(key).join(reached, key, "left").agg(F.count("*").alias("listed"), F.count("hit").alias("reached"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
