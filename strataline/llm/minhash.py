"""Near-duplicate groups by one-permutation hashing, and one kept document of each.

Signature.  A text's set is its distinct runs of `shingle` words, as 64-bit
hashes.  One hash value serves all bins: its high bits name the bin, the least
value of a bin is the signature there.  An empty bin takes over the value of
the first filled bin in an order of its own (optimal densification: each bin
draws anew, so bins stay unbiased and independent).  Bands of `rows` bins are
hashed to bucket keys.

Candidates.  Texts with equal sets are one node from the start.  In each
bucket the member that shares most bucket places with others is the centre of
a star, and it alone is compared with the others, on the full sets.  That
connects nearly all true groups.  Where a bucket still holds several
components, its members outside the largest one are searched for links among
all members of such buckets by their rarest shingles: two sets of similarity
t share one of the |s| - ceil(t |s|) + 1 first shingles of each in any common
order, so with rare ones first few pairs are left to compare, and none is
lost.  A bucket of copies, or of copies of copies, never costs all its pairs.

What remains to chance is that two texts at the threshold share no band:
0.8^5 a band, (1 - 0.328)^36 = 6e-7 in all.

Defined cases: a text without words has the empty set and is linked with
nothing; a null text likewise; a text of fewer words than a shingle is one
shingle; a row with a null id is linked with nothing, has a null component and
is kept; rows equal in id and text are one document; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fingerprint, need
from strataline.llm.words import ODD, blanks, text_bytes, word_bounds, word_hashes
from strataline.session import Scratch

BANDS, ROWS = 36, 5

#: Cells of the table of shingle counts that orders shingles by rarity: 8 MB, whatever the corpus.
CELLS = 1 << 20

#: Largest number of ids that is broadcast to pick texts (16 bytes each in the hash table).
MOST_IDS = 1_000_000

_ODD = ODD
_SPACE = blanks(b" \t\n\v\f\r")


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that lie in `data` between offsets, and where it starts."""
    start, end = word_bounds(data, offsets, _SPACE)
    return word_hashes(data, start, end), start


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and where each text's begin (one more than texts)."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    words, start = hashed_words(data, offsets)
    upto = np.searchsorted(start, offsets)
    count = np.diff(upto)
    g = np.full(max(len(words) - shingle + 1, 0), np.uint64(shingle))
    for k in range(shingle):
        g = mix(g * _ODD + words[k : k + len(g)])
    sets = []
    for first, n in zip(upto[:-1], count, strict=True):
        if n >= shingle:
            own = g[first : first + n - shingle + 1]
            own.sort()  # no two texts share a place in g
            sets.append(own)
        elif n:
            short = np.full(1, np.uint64(n))
            for k in range(n):
                short = mix(short * _ODD + words[first + k : first + k + 1])
            sets.append(short)
        else:
            sets.append(g[:0])
    all_, size = np.concatenate(sets), np.array([len(s) for s in sets])
    text = np.repeat(np.arange(len(sets)), size)
    keep = np.ones(len(all_), bool)
    keep[1:] = (all_[1:] != all_[:-1]) | (text[1:] != text[:-1])
    at = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(np.bincount(text[keep], minlength=len(sets)), out=at[1:])
    return all_[keep], at


def donors(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others for a value."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(bins) for _ in range(bins)])


def band_keys(hashes: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys (texts x bands) of non-empty sets."""
    bins, n = bands * rows, len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    cell = text * bins + (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    sig, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    sig[cell[first]], full[cell[first]] = hashes[first], True
    ask = donors(bins)
    left = np.flatnonzero(~full)
    for t in range(bins):
        if not len(left):
            break
        base = left - left % bins
        giver = base + ask[left % bins, t]
        ok = full[giver]
        sig[left[ok]] = sig[giver[ok]]
        left = left[~ok]
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for k in range(rows):
        key = mix(key * _ODD + sig.reshape(n, bands, rows)[:, :, k])
    return key


def text_slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of about `most` bytes of text; a longer text comes alone.

    Afterwards Arrow's freed memory goes back to the system, as the worker
    lives on beside the ones of later stages.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b
    pa.default_memory_pool().release_unused()


def _identity(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    upto = lambda x, f: np.concatenate([np.zeros(1, np.uint64), f.accumulate(x)])[at]
    a, b = upto(mix(hashes), np.add), upto(mix(hashes ^ _ODD), np.add)
    return (a[1:] - a[:-1]).view(np.int64), (b[1:] - b[:-1]).view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, print, n_shingles, node struct(a, b), bands array<long> (empty for the empty set) for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                hashes, at = shingle_sets(batch.column("text"), shingle)
                size = np.diff(at)
                some = size > 0
                a, b = _identity(hashes, at)
                keys = band_keys(hashes, np.concatenate([[0], np.cumsum(size[some])]), bands, rows).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(some) * bands]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "print": batch.column("print"), "n_shingles": size.astype(np.int64), "a": a, "b": b, "bands": lists})

    told = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), fingerprint(F.col("text")).alias("print"), "text")
    signed = told.mapInArrow(sign, "doc_id long, print string, n_shingles long, a long, b long, bands array<long>")
    return signed.select("doc_id", "print", "n_shingles", F.struct("a", "b").alias("node"), "bands")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (binary, 8 bytes each, sorted) of the texts whose doc_id is in ids."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                hashes, at = shingle_sets(batch.column("text"), shingle)
                a, b = _identity(hashes, at)
                sets = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(hashes.astype("<u8"))]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "hashes": sets})

    small = ids.count() <= MOST_IDS
    texts = need(docs, "doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").select("text")
    return texts.mapInArrow(gather, "a long, b long, hashes binary").select(F.struct("a", "b").alias("node"), "hashes")


def _decoded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose full sets have 100 * intersection >= percent * union."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = _decoded(x.as_py()), _decoded(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    x = sets.select(F.col("node").alias("u"), F.col("hashes").alias("x")).hint("merge")
    y = sets.select(F.col("node").alias("v"), F.col("hashes").alias("y")).hint("merge")
    return pairs.select("u", "v").join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(test, "u struct<a:long,b:long>, v struct<a:long,b:long>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (the least node reachable) for every node of edges (u, v).

    Labels fall to the least label of a neighbour and then to the label of
    their label, so paths halve; each round is saved.
    """
    both = scratch.save(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        jump = low.alias("l").join(labels.select(F.col("node").alias("at"), F.col("comp").alias("far")), F.col("l.low") == F.col("at"), "left")
        new = scratch.save(jump.select("node", "old", F.least("low", F.coalesce("far", "low")).alias("comp")), "labels")
        moved = new.where(F.col("old") != F.col("comp")).limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "comp")
        labels._strataline_path = new._strataline_path
        if not moved:
            return labels


def rare_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of nodes of open_ (node, comp, astray) in different components, one of them astray, that share a shingle of their rarest.

    Two sets of n >= m shingles that are to be linked share `both` of them at
    least, t * n and 2 t / (1 + t) * m.  So one of the first n - t n + 1 of the
    larger one is among the first m - 2 t / (1 + t) m + 1 of the smaller one,
    in any common order.  Only the smaller side's few first shingles are keys,
    by size class, and a shingle that no smaller set has among these meets
    nothing, however many larger ones hold it.  What two texts of one template
    have in common stands behind what each has of its own, if they differ in
    more than the threshold allows.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column("hashes"):
                np.add.at(total, (_decoded(x.as_py()) % CELLS).astype(np.int64), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cell, "n": total[cell]})

    held = open_.join(sets.hint("merge"), "node")
    counts = np.zeros(CELLS, np.int64)
    for r in held.select("hashes").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.cell] = r.n
    shared = open_.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, sh, size, place = [], [], [], []
            for i, x in enumerate(batch.column("hashes")):
                h = _decoded(x.as_py())
                n = len(h)
                k = n - -(-percent * n // 100) + 1
                sh.append(h[np.lexsort((h, rare[(h % CELLS).astype(np.int64)]))[:k]].view(np.int64))
                row.append(np.full(len(sh[-1]), i))
                size.append(np.full(len(sh[-1]), n))
                place.append(np.arange(len(sh[-1])))
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(sh), "n": np.concatenate(size), "place": np.concatenate(place)} | {c: batch.column(c).take(at) for c in ("node", "comp", "astray")})

    node = "struct<a:long,b:long>"
    rows = held.mapInArrow(first, f"shingle long, n long, place long, node {node}, comp {node}, astray boolean")
    rows = rows.withColumn("class", F.floor(F.log(100 / min(percent, 99), F.col("n").cast("double")) + 1e-9))
    both = lambda n, m: f"(({n} + {m}) * {percent} + {99 + percent}) div {100 + percent}"
    small = rows.where(f"place <= n - ({both('n', 'n')})").alias("y")
    # a larger set is of the smaller one's class or the next
    large = rows.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1))).alias("x")
    met = large.join(small.hint("merge"), F.expr("x.shingle = y.shingle and x.class = y.class"))
    least = both("x.n", "y.n")
    met = met.where(f"x.comp <> y.comp and (x.astray or y.astray) and x.n >= y.n and y.n * 100 >= x.n * {percent} and x.place <= x.n - ({least}) and y.place <= y.n - ({least})")
    return met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, print, n_shingles, component_id, kept for every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.save(signatures(docs, shingle, bands, rows), "signatures")
    told = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = scratch.save(told.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    placed = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.save(placed.join(shared.hint("merge"), "bucket"), "members")
    hubs = members.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = scratch.save(hubs.join(nodes.select("node", "n", "rep"), "node"), "hubs")
    sets = scratch.save(full_sets(docs, hubs.select(F.col("rep").alias("doc_id")), shingle).join(hubs.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    weighed = members.select("bucket", "node").join(hubs.select("node", "n", "weight"), "node")
    top = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("c")).select("bucket", F.col("c.node").alias("c"), F.col("c.n").alias("c_n"))
    near = F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * percent
    stars = weighed.join(top, "bucket").where((F.col("node") != F.col("c")) & near).select(F.least("node", "c").alias("u"), F.greatest("node", "c").alias("v")).distinct()
    links = scratch.save(confirmed(stars, sets, percent), "links")
    comps = components(links, scratch)
    # buckets that hold several components, and who is outside the largest one there
    labelled = members.select("bucket", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("most"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("most.comp").alias("main"))
    astray = labelled.join(open_, "bucket").groupBy("node", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("astray"))
    pairs = rare_pairs(scratch.save(astray, "open"), sets, percent)
    links = scratch.save(confirmed(pairs, sets, percent).union(links), "links")
    comps = components(links, scratch)
    # smallest id of each component; nodes without links stand for themselves
    least = comps.join(nodes, "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = comps.join(least, "comp").select("node", "component_id")
    named = nodes.join(of, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "print", "n_shingles", F.col("doc_id").alias("component_id"))
    every = told.join(named, "node").select("doc_id", "print", "n_shingles", "component_id").union(rest)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs`, all columns, with one document of each group."""
    gone = groups(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct()
    # a merge join at every size: what goes grows with the corpus
    return docs.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col("__id")) & (fingerprint(F.col("text")) == F.col("__print")), "left_anti")
