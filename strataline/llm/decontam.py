"""Benchmark decontamination by a broadcast set of hashed word windows.

Words are runs of characters other than ASCII marks, controls and spaces,
after A-Z are lower-cased.  Every run of `window` consecutive words of an item
is a window (an item with fewer words is one window).  All windows of whole
documents are hashed in place and looked up in the set of the items' hashes;
what the set lets through is compared word by word with the items' windows.

The set of hashes is broadcast while it takes at most MOST_BYTES; windows are
rows only between being hashed and being looked up, and texts are not
shuffled.  For a larger benchmark the hashes of all windows are shuffled
instead, with the same result.  Which items a window belongs to is joined to
the few windows that are left, and is never broadcast by hand.
Native expressions only.

Defined cases: a null or empty text has no words, is never hit and keeps its
row; a null item id takes no part; equal item ids count once; repeated
document rows each get the same result; an empty benchmark hits nothing; only
doc_id, text, item_id and text of the items are read, other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fingerprint, lower_ascii, need
from strataline.session import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Largest set of window hashes that is broadcast, and what one takes there.
MOST_BYTES, HASH_BYTES = 256 << 20, 64
MOST_HASHES = MOST_BYTES // HASH_BYTES

#: Largest number of documents to drop that is broadcast (an id and a fingerprint each, about 100 bytes).
MOST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _hash_at(hashes: str, i: str, n: int) -> str:
    """The hash of n words from word i on, which tells lengths apart."""
    return f"xxhash64({n}, {', '.join(f'get({hashes}, {i} + {k})' for k in range(n))})"


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """item_id string, n int (words in it), said string (the words), hash long: one row for each item and different window."""
    split = need(items, "item_id", "text").where("item_id is not null").select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("words"))
    sized = split.where("size(words) > 0").select("item_id", "words", F.least(F.size("words"), F.lit(window)).alias("n"))
    rows = sized.select("item_id", "n", F.expr("explode(transform(sequence(0, size(words) - n), i -> slice(words, i + 1, n)))").alias("w"))
    hashed = F.expr("transform(w, x -> xxhash64(x))")
    by_length = F.coalesce(*[F.when(F.col("n") == k, F.expr(_hash_at("h", "0", k))) for k in range(1, window + 1)])
    return rows.select("item_id", "n", F.array_join("w", " ").alias("said"), hashed.alias("h")).select("item_id", "n", "said", by_length.alias("hash")).distinct()


def scan(docs: DataFrame, items: DataFrame, window: int = 10, most: int = MOST_HASHES) -> DataFrame:
    """doc_id, print, n_words, hit_words (array of word positions inside any occurrence), item_ids (sorted strings): a saved row for each hit (doc_id, print)."""
    scratch = Scratch(docs.sparkSession, "decontam")
    bench = scratch.save(item_windows(items, window), "windows")
    lengths = sorted(r.n for r in bench.select("n").distinct().collect())  # at most `window` numbers
    keys = bench.select("hash").distinct()
    rows = need(docs, "doc_id", "text").select("doc_id", fingerprint(F.col("text")).alias("print"), words_of(F.col("text")).alias("words"))
    hashed = rows.select("*", F.expr("transform(words, x -> xxhash64(x))").alias("h"))
    every = [f"if(size(words) >= {n}, transform(sequence(0, size(words) - {n}), i -> struct(i as at, {n} as n, {_hash_at('h', 'i', n)} as hash)), array())" for n in lengths]
    spots = F.expr(f"concat({', '.join(every)})") if every else F.expr("array()").cast("array<struct<at:int,n:int,hash:bigint>>")
    said = F.expr("array_join(slice(words, at + 1, n), ' ')").alias("said")
    # the array is a column before it is exploded, and exploded with its empty ones: so it is computed once a row, and the words are not copied for each window
    one = hashed.select("doc_id", "print", "words", spots.alias("spots"))
    if keys.count() <= most:
        met = one.select("doc_id", "print", "words", F.explode_outer("spots").alias("s")).select("doc_id", "print", "words", "s.*").join(F.broadcast(keys), "hash", "left_semi")
    else:
        near = one.select("doc_id", "print", F.explode("spots").alias("s")).select("doc_id", "print", "s.*").join(keys.hint("merge"), "hash", "left_semi")
        near = near.groupBy("doc_id", "print").agg(F.collect_set(F.struct("at", "n")).alias("s"))  # windows of one text
        again = rows.alias("r").join(near.alias("m").hint("merge"), F.expr("r.doc_id <=> m.doc_id and r.print = m.print")).select("r.doc_id", "r.print", "words", "s")
        met = again.select("doc_id", "print", "words", F.explode_outer("s").alias("s")).select("doc_id", "print", "words", "s.*")
    spotted = met.select("doc_id", "print", F.size("words").cast("long").alias("n_words"), "at", "n", said)
    exact = spotted.join(bench.select("n", "said", "item_id"), ["n", "said"])
    hits = exact.groupBy("doc_id", "print", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at, at + n - 1)")))).alias("hit_words"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    return scratch.save(hits, "hits")


def report(docs: DataFrame, items: DataFrame, window: int = 10, most: int = MOST_HASHES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document row."""
    hits = scan(docs, items, window, most).drop("n_words")
    base = need(docs, "doc_id", "text").select("doc_id", fingerprint(F.col("text")).alias("print"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = base.alias("b").join(hits.alias("h"), F.expr("b.doc_id <=> h.doc_id and b.print = h.print"), "left")
    ids = F.coalesce(F.col("h.item_ids"), F.array().cast("array<string>"))
    return joined.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        F.when(F.col("h.print").isNull(), F.lit(0)).otherwise(F.size("h.hit_words")).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("h.print").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, most: int = MOST_HASHES, least_share: float = 0.0) -> DataFrame:
    """`docs` without the documents of which more than least_share of the words are hit; all columns stay.

    Who goes is broadcast if that is at most MOST_IDS documents, and joined by
    a shuffle of texts beyond.
    """
    hits = scan(docs, items, window, most)
    bad = hits.where(F.size("hit_words") > F.lit(least_share) * F.col("n_words")).select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"))
    bad = F.broadcast(bad) if bad.count() <= MOST_IDS else bad.hint("merge")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (fingerprint(F.col("text")) == F.col("__print")), "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, window: int = 10, most: int = MOST_HASHES) -> DataFrame:
    """`docs` with the hit words, and what stands between two hit words, taken out of `text`; all columns and rows stay.

    The hit words of a text are replaced by nothing; words that remain are
    unchanged, and so is everything between them.
    """
    hits = scan(docs, items, window, most)
    h = hits.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), F.col("hit_words").alias("__hit"))
    joined = docs.join(h, F.col("doc_id").eqNullSafe(F.col("__id")) & (fingerprint(F.col("text")) == F.col("__print")), "left")
    low = lower_ascii(F.col("text"))
    split = joined.withColumn("__gaps", F.split(low, WORD, -1)).withColumn("__words", F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).withColumn("__flag", F.expr("transform(sequence(0, size(__words)), i -> array_contains(__hit, i))"))
    # state: position in the text, what is kept so far, whether the word before was hit
    cut = F.expr("""aggregate(sequence(0, size(__gaps) - 1), named_struct('pos', 1, 'out', '', 'was', false),
        (a, i) -> named_struct(
            'pos', a.pos + length(get(__gaps, i)) + coalesce(length(get(__words, i)), 0),
            'out', concat(a.out,
                          if(a.was and coalesce(get(__flag, i), false) and i < size(__words), '', substr(text, a.pos, length(get(__gaps, i)))),
                          if(i < size(__words) and not get(__flag, i), substr(text, a.pos + length(get(__gaps, i)), length(get(__words, i))), '')),
            'was', i < size(__words) and get(__flag, i)),
        a -> a.out)""")
    text = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(cut)
    return split.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
