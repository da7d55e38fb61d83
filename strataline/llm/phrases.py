"""Collocations: frequent phrases whose parts meet more often than chance would have it.

Texts are cut into pieces at marks, pieces into words, everything by language.
A suffix pointer is a word's place; what follows it in its piece, up to `depth`
words, is its suffix, and phrases are beginnings of suffixes.

1. Words are counted; a phrase is no more frequent than its rarest word.
2. Pairs of frequent words are counted by PAIR_CELLS cells of a hash, summed up
   in each task before they are shuffled.  Cells short of `least` hold no
   frequent pair.
3. Suffixes end before the first word, or pair, that is not frequent.  Their
   pairs are counted exactly, and those of three words or more are routed over
   the cluster by their two leading words.
   A lead with over MOST_ROWS suffixes is routed by three words, or four, so no
   group of unbounded size comes to one task; its own count is a plain count
   with partial aggregation.
4. A task sorts what it gets by multikey three-way quicksort: pointers are
   parted at a pivot word into less, equal and greater; the equal part goes one
   word deeper.  The size of an equal part is its phrase's count, and a part
   with a size under `least` is abandoned unsorted.

Which words and pairs are frequent is told to tasks by a table of bits of
fixed size (WORD_BITS, PAIR_BITS).  A bit that is set by mistake costs a row
more, and never a count; with far more words than bits nothing is left out
early, and counts stay right.  Words travel as 64-bit hashes: v different words
of a language hold two with the same hash with chance v^2 / 2^65.

Scores are exact: products are decimals of 38 digits, and the quotient is a
whole number.

Defined cases: null and empty texts have no words; a null language is `und`;
repeated rows count as often as they occur; rows with null ids count; an empty
table gives an empty result; only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import lower_ascii, need
from strataline.llm.minhash import mix, text_slices
from strataline.llm.words import ODD, blanks, text_bytes, word_bounds, word_hashes
from strataline.session import Scratch

#: Marks that end a piece.
CUTS = b".,;:!?\n\v\f\r"
#: Bits of the tables of frequent words (1 MB) and pairs (8 MB).
WORD_BITS, PAIR_BITS = 1 << 23, 1 << 26
#: Cells that pairs are counted by: two pairs in one are taken for frequent too early, at the cost of rows.
PAIR_CELLS = 1 << 40
#: Rows with the same leading words that are sorted in one task.
MOST_ROWS = 1 << 17

_CUT, _BLANK = blanks(CUTS), blanks(CUTS + b" \t")


def _key(lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """64 bits of a language and words."""
    key = lang.astype(np.uint64)
    for w in words:
        key = mix(key * ODD + w.astype(np.uint64))
    return key


def _cell(lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """The cell that a pair is counted by."""
    return _key(lang, *words) % np.uint64(PAIR_CELLS)


def bit_table(keys: DataFrame, bits: int) -> Broadcast:
    """A table of `bits` bits with those set of the rows' keys.

    Each partition hands over its distinct places, and one partition at a time
    is with the driver; all are at most `bits` numbers of four bytes.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"places": pa.array([batch.column("place").to_numpy().astype("<u4").tobytes()], pa.binary())})

    table = np.zeros(bits, bool)
    told = keys.select(F.pmod("key", F.lit(bits)).alias("place")).distinct()
    for r in told.mapInArrow(packed, "places binary").toLocalIterator():
        table[np.frombuffer(r.places, "<u4")] = True
    return keys.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little"))


def _has(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key % np.uint64(len(table) * 8)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words; zero is kept for no word."""
    h = word_hashes(data, start, end)
    h[h == 0] = 1
    return h


def pointers(batch: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the batch: id, language, and whether it and the next one stand in one piece and may be frequent."""
    data, offsets = text_bytes(batch.column("text"))
    start, end = word_bounds(data, offsets, _BLANK)
    ids = word_ids(data, start, end)
    text = np.searchsorted(offsets, start, side="right") - 1
    lang = batch.column("lang_id").to_numpy().view(np.uint64)[text]
    piece = np.cumsum(_CUT[data])[start] if len(start) else start
    fine = _has(words, _key(lang, ids))
    pair = np.zeros(len(ids), bool)
    pair[:-1] = fine[:-1] & fine[1:] & (text[:-1] == text[1:]) & (piece[:-1] == piece[1:])
    return ids, lang, pair


def _told(columns: list[np.ndarray], **more: np.ndarray) -> pa.RecordBatch:
    names = ["lang_id", *[f"w{i + 1}" for i in range(len(columns) - 1)]]
    return pa.RecordBatch.from_pydict({k: c.view(np.int64) for k, c in zip(names, columns, strict=True)} | more)


def pair_cells(texts: DataFrame, words: Broadcast) -> DataFrame:
    """key, f: cells of pairs of words that may be frequent, with counts of parts of the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(text_slices(b, 4 << 20) for b in batches):
            ids, lang, pair = pointers(batch, words.value)
            i = np.flatnonzero(pair)
            cell, n = np.unique(_cell(lang[i], ids[i], ids[i + 1]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": cell.view(np.int64), "f": n.astype(np.int64)})

    return texts.mapInArrow(count, "key long, f long")


def suffixes(texts: DataFrame, words: Broadcast, frequent: Broadcast, depth: int) -> DataFrame:
    """lang_id, w1, ...: a row for each suffix of two words or more, up to the first pair that is not frequent; 0 where it has ended."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(text_slices(b, 4 << 20) for b in batches):
            ids, lang, pair = pointers(batch, words.value)
            i = np.flatnonzero(pair)
            pair[i] = _has(frequent.value, _cell(lang[i], ids[i], ids[i + 1]))
            reach, on = np.ones(len(ids), np.int64), np.ones(len(ids), bool)
            for k in range(depth - 1):
                on[: len(on) - k] &= pair[k:]
                on[len(on) - k :] = False
                reach += on
            i = np.flatnonzero(reach >= 2)
            yield _told([lang[i], *[np.where(reach[i] > k, ids[np.minimum(i + k, len(ids) - 1)], np.uint64(0)) for k in range(depth)]])

    return texts.mapInArrow(cut, "lang_id long, " + ", ".join(f"w{k + 1} long" for k in range(depth)))


def quicksorted(columns: list[np.ndarray], beyond: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent beginnings with more than `beyond` words: a row that has it, its number of words, its count.

    The first column is the language, the others are words, 0 where a suffix
    has ended.
    """
    found: list[tuple[int, int, int]] = []
    todo = [(np.arange(len(columns[0])), 0)]
    while todo:
        p, at = todo.pop()
        key = columns[at][p]
        ends = np.sort(key[[0, len(key) // 2, -1]])
        pivot = ends[1]
        equal = p[key == pivot]
        if len(equal) >= least and (at == 0 or pivot):
            if at > beyond:
                found.append((int(equal[0]), at, len(equal)))
            if at + 1 < len(columns):
                todo.append((equal, at + 1))
        for part in (p[key < pivot], p[key > pivot]):
            if len(part) >= least:
                todo.append((part, at))
    row, words, f = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return row, words, f


def sorted_counts(lead: int, depth: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over suffixes that are dealt out and ordered by `lead` leading words: frequent phrases of more words, with their counts."""
    names = ["lang_id", *[f"w{i + 1}" for i in range(depth)]]

    def counted(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(n).to_numpy().view(np.uint64) for n in names]
        row, words, f = quicksorted(columns, lead, least)
        return _told([columns[0][row], *[np.where(words > k, c[row], np.uint64(0)) for k, c in enumerate(columns[1:])]], f=f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            if held.num_rows < MOST_ROWS:
                continue
            last = [held.column(n).to_numpy() for n in names[: lead + 1]]
            same = np.logical_and.reduce([c == c[-1] for c in last])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            if cut:
                yield counted(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield counted(held)

    return run


def frequent_phrases(docs: DataFrame, least: int, depth: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (lang_id, p: array of word ids, f), words (lang_id, id, word, f) and languages (lang, lang_id, n: words in all)."""
    texts = need(docs, "text", "lang").select(F.xxhash64(F.coalesce("lang", F.lit("und"))).alias("lang_id"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    marks = "".join(f"\\x{c:02X}" for c in CUTS + b" \t")
    each = texts.select("lang", "lang_id", F.explode(F.split(lower_ascii(F.col("text")), f"[{marks}]+")).alias("word")).where("word <> ''")
    counted = scratch.save(each.groupBy("lang", "lang_id", "word").agg(F.count("*").alias("f")), "words")
    langs = counted.groupBy("lang", "lang_id").agg(F.sum("f").alias("n"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("word"))
            ids = word_ids(data, at[:-1], at[1:])
            key = _key(batch.column("lang_id").to_numpy().view(np.uint64), ids)
            yield pa.RecordBatch.from_pydict({"lang_id": batch.column("lang_id"), "w1": ids.view(np.int64), "word": batch.column("word"), "f": batch.column("f"), "key": (key % np.uint64(WORD_BITS)).astype(np.int64)})

    words = scratch.save(counted.where(F.col("f") >= least).select("lang_id", "word", "f").mapInArrow(named, "lang_id long, w1 long, word string, f long, key long"), "frequent-words")
    told_words = bit_table(words, WORD_BITS)
    plain = texts.select("lang_id", "text")
    cells = pair_cells(plain, told_words).groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    every = scratch.save(suffixes(plain, told_words, bit_table(cells, PAIR_BITS), depth), "suffixes")
    rest = every.where("w3 <> 0")
    frequent_pairs = every.groupBy("lang_id", "w1", "w2").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    names = [f"w{k + 1}" for k in range(depth)]
    filled = lambda df, n: df.select("lang_id", *names[:n], *[F.lit(0).cast("long").alias(c) for c in names[n:]], "f")
    found = [filled(words, 1), filled(frequent_pairs, 2)]
    schema = "lang_id long, " + ", ".join(f"{c} long" for c in names) + ", f long"
    for lead in range(2, depth):
        keys = ["lang_id", *names[:lead]]
        hot = scratch.save(rest.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > MOST_ROWS).select(*keys), "hot")
        last = hot.isEmpty()
        own = rest if last else rest.join(hot, keys, "left_anti")
        found.append(own.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(sorted_counts(lead, depth, least), schema))
        if last:
            break
        rest = rest.join(hot, keys, "left_semi").where(F.col(names[lead]) != 0)
        deeper = rest.groupBy(*keys, names[lead]).agg(F.count("*").alias("f")).where(F.col("f") >= least)
        found.append(filled(deeper, lead + 1))
    told = reduce(DataFrame.unionByName, found)
    return told.select("lang_id", F.filter(F.array(*names), lambda x: x != 0).alias("p"), "f"), words.select("lang_id", F.col("w1").alias("id"), "word", "f"), langs


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, top: int = 2000, percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `depth` words by score, a (both descending) and phrase.

    A phrase that occurs `least` times or more is a candidate; one that lies in
    a longer candidate with at least `percent` in a hundred of its count is
    left out.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    phrases, words, langs = frequent_phrases(docs, least, depth, scratch)
    phrases, langs = scratch.save(phrases, "phrases"), scratch.save(langs, "languages")
    candidates = phrases.where(F.size("p") > 1).withColumnRenamed("f", "a")
    part = lambda side: phrases.select("lang_id", F.col("p").alias(side), F.col("f").alias(side[0]))
    cuts = candidates.select("lang_id", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("lang_id", "p", "a", "k", F.slice("p", 1, F.col("k")).alias("left"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("right"))
    met = cuts.join(part("left"), ["lang_id", "left"]).join(part("right"), ["lang_id", "right"]).join(langs.select("lang_id", "n"), "lang_id")
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(20,0)))")
    scored = met.groupBy("lang_id", "p").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("s")).select("lang_id", "p", "s.*")
    # every shorter stretch of two words or more of each candidate
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda i: F.slice("p", i, n))))
    within = candidates.where(F.size("p") > 2).select("lang_id", F.col("a").alias("longer"), F.explode(inner).alias("p")).groupBy("lang_id", "p").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang_id", "p"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")
    spelt = kept.select("*", F.posexplode("p").alias("pos", "id")).join(words.select("lang_id", "id", "word"), ["lang_id", "id"])
    spelt = spelt.groupBy("lang_id", "p").agg(*[F.first(c).alias(c) for c in ("score", "a", "l", "r", "n")], F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("said"))
    named = spelt.join(langs.select("lang_id", "lang"), "lang_id").select("lang", F.array_join(F.col("said.word"), " ").alias("phrase"), "a", "l", "r", "n", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
