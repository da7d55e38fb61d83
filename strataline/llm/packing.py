"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is decided on the
histogram of lengths (at most `capacity` numbers, summed by Spark over all
documents) and never on the documents: a recipe says which lengths fill a
sequence and how many sequences are filled that way.  Pieces then find their
place by their rank among the pieces of their length, which is known from a
count for each input partition; no group of equal lengths is gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import need
from strataline.llm.minhash import text_slices
from strataline.llm.tokens import default_tokenizer, encoder
from strataline.session import Scratch


def recipes(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, the lengths in each), by best-two-fit.

    A sequence is filled greedily, each time with the longest piece that
    fits.  If room is left, its smallest piece gives way to the two unpacked
    ones that together fill the widened gap best, if they fill it better.  As
    long as all pieces it took are there in number, the next sequence would be
    filled the same, so they are planned together.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] = n
    out = []
    while left.any():
        free, gap, taken = left.copy(), capacity, []
        while gap and len(fits := np.flatnonzero(free[: gap + 1])):
            taken.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= taken[-1]
        used = np.bincount(taken, minlength=capacity + 1)
        if gap and (pair := _best_pair(free, gap + taken[-1], taken[-1])):
            taken = [*taken[:-1], *pair]
            used = np.maximum(used, np.bincount(taken, minlength=capacity + 1))
        own = np.bincount(taken, minlength=capacity + 1)
        many = int((left[used > 0] // used[used > 0]).min())
        left -= many * own
        out.append((many, taken))
    return out


def _best_pair(free: np.ndarray, gap: int, beat: int) -> tuple[int, int] | None:
    """Two free lengths with the largest sum over `beat` and at most `gap`; the longest first on ties."""
    for total in range(gap, beat, -1):
        a = np.arange(total - 1, (total - 1) // 2, -1)
        a = a[(a < len(free)) & (a < total)]
        b = total - a
        ok = (free[a] > 0) & (free[b] > 0) & ((a != b) | (free[a] > 1))
        if ok.any():
            k = int(np.argmax(ok))
            return int(a[k]), int(b[k])
    return None


def layout(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces of it in a sequence, first sequence, first offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for many, lengths in plan:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            k = lengths.count(length)
            rows.append((length, rank.get(length, 0), k, sequence, offset))
            rank[length] = rank.get(length, 0) + many * k
            offset += k * length
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenises whole texts, appends end_id and cuts longer documents into pieces of `capacity` (the first may be shorter).

    doc_id, piece, start, length, ids_crc32, part, rank (and ids, u32
    little-endian): rank counts the pieces of a length within the input
    partition `part`.  Save the result before using it twice.
    """
    tokenizer = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in chain.from_iterable(text_slices(b, 4 << 20) for b in batches):
            ids, lens = enc.encode(batch.column("text"))
            ends = np.cumsum(lens)
            ids = ids.astype("<u4")
            n = lens + 1
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            begin = (ends - lens)[doc] + start
            end = np.minimum(begin + length, ends[doc])
            tail = np.array([end_id], "<u4").tobytes()
            last = piece == count[doc] - 1
            data = [ids[a:b].tobytes() + (tail if z else b"") for a, b, z in zip(begin, end, last, strict=True)]
            rank = np.zeros(len(doc), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, at, sizes = np.unique(length[order], return_index=True, return_counts=True)
            rank[order] = np.arange(len(doc)) - np.repeat(at, sizes) + np.repeat(seen[kinds], sizes)
            seen[kinds] += sizes
            cols = {"doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": start, "length": length, "ids_crc32": pa.array(map(zlib.crc32, data), pa.int64()), "part": pa.array(np.full(len(doc), part, np.int32)), "rank": rank}
            yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(data, pa.binary())} if with_ids else {}))

    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts give a piece with the end id alone; a null doc_id
    stays null; repeated rows are packed each for itself; an empty table gives
    an empty result.  Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, capacity, tokenizer, end_id, with_ids), "pieces")
    counts = scratch.save(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = layout(recipes(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    wide = 1 << 40
    keys = table[:, 0] * wide + table[:, 1]
    last = ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            nth, k = rank - row[:, 1], np.maximum(row[:, 2], 1)
            got = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": row[:, 3] + nth // k, "offset": row[:, 4] + nth % k * length}
            yield pa.RecordBatch.from_pydict(got | {c: batch.column(c) for c in last})

    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *last).mapInArrow(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, ids (binary), doc_ids; needs pack(with_ids=True). A group holds at most `capacity` ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    return grouped.select("sequence_id", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("length"), F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids"), F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"))
