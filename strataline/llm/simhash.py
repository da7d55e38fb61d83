"""SimHash fingerprints, and groups of texts whose fingerprints differ in few bits.

Fingerprint.  Of the 64-bit hashes of all shingles of a text, repeats included,
each bit is set that is set in over half of them.  Counts are kept eight to a
64-bit number while up to 255 hashes are added.

Candidates.  Texts with equal fingerprints are one node.  The 64 bits are cut
into `blocks`; if two fingerprints differ in at most `radius` bits, some
`blocks - radius` of the blocks are the same in both, so every choice of that
many blocks makes one table of buckets and no pair is lost.  More distinct
fingerprints ask for more blocks, so that buckets stay small; any number of
blocks gives the same links.  A bucket of more than LANES members is split into
parts by a hash of the members, and every two parts meet in a task of their
own: no bucket is ever gathered whole.

Comparison.  A part is stored vertically: 64 planes of bits, the k-th of which
holds bit k of 64 members a word.  One fingerprint is held against all 64
members of a word at once: a plane, flipped where the fingerprint has the bit,
is added to bitwise counters by carry-save steps, and one mask says which of
the 64 distances are over the radius.  Words in which all are over it are
abandoned after every few planes.

Links are not written out as pairs: each task joins its members to the least
of their group, so a group of k members gives less than k rows a task.

Defined cases: a null text counts as empty; a text without words has the
fingerprint zero, and is linked like any other; a text of fewer words than a
shingle is one shingle; a row with a null id has a null component unless
others share its group; an empty table gives an empty result; repeated rows
stay; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import need
from strataline.llm.minhash import components, text_slices
from strataline.llm.words import LOWER, blanks, text_bytes, word_bounds
from strataline.session import Scratch

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of a part of a bucket, about.
LANES = 4096
#: Fingerprints a bucket has on average before more blocks are cut.
MEAN = 1024
#: Words of 64 members that are compared at once.
SLAB = 1 << 15

_SPACE = blanks(b" \t\n\v\f\r")
#: For each byte its eight bits as eight bytes, the lowest first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_ALL = ~np.uint64(0)


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of all texts, one after another, and where each text's begin (one more than texts)."""
    data, offsets = text_bytes(texts)
    start, end = word_bounds(data, offsets, _SPACE)
    size = end - start
    # all words in lower case, a space after each: a shingle is one stretch of these bytes
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(at[-1], 32, np.uint8)
    step = np.ones(int(size.sum()), np.int64)
    heads = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    put, take = np.repeat(at[:-1], size), np.repeat(start, size)
    within = np.cumsum(step) - 1 - np.repeat(heads, size)
    joined[put + within] = LOWER[data[take + within]]
    upto = np.searchsorted(start, offsets)
    words = np.diff(upto)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    head = np.arange(first[-1]) - np.repeat(first[:-1] - upto[:-1], count)
    tail = head + np.repeat(np.minimum(words, shingle), count)
    said, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(said[a:b], SEED) for a, b in zip(at[head].tolist(), (at[tail] - 1).tolist(), strict=True)), np.uint64, len(head)), first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number a text: the bits that are set in over half of its hashes."""
    n = np.diff(first)
    runs = -(-n // 255)
    text = np.repeat(np.arange(len(n)), runs)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    cut = first[text] + 255 * nth
    counts = np.zeros((len(n), 64), np.int64)
    for a in range(0, len(cut), 1024):
        own = cut[a : a + 1024]
        last = cut[a + 1024] if a + 1024 < len(cut) else first[-1]
        spread = _SPREAD[hashes[own[0] : last].astype("<u8").view(np.uint8).reshape(-1, 8)]
        packed = np.add.reduceat(spread, own - own[0], axis=0)
        np.add.at(counts, text[a : a + 1024], packed.view(np.uint8).reshape(-1, 64))
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long: the 64 bits) for every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            bits = majority(*shingle_hashes(batch.column("text"), shingle))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": bits.view(np.int64)})

    return need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, fp long")


def blocks_for(n: int, radius: int) -> int:
    """Blocks to cut 64 bits into, for n distinct fingerprints."""
    blocks = radius + 1
    while blocks < 2 * radius and n >> (64 * (blocks - radius) // blocks) > MEAN:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int) -> list[int]:
    """The bits that are to be the same, for each choice of blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(x) for x in combinations(whole, blocks - radius)]


def vertical(fps: np.ndarray) -> np.ndarray:
    """64 planes (rows) of the numbers, whose count is a multiple of 64; lane i of a word is its bit i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").view("<u8")[:, :, 0].T)


def near_words(planes: np.ndarray, word: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the comparisons (a word of 64 members, a number) have any distance within the radius, and the lanes that are.

    Counters of as many bits as the radius has take up one plane after the
    other; what they can't hold is kept as being over.
    """
    some = np.arange(len(word))
    count = [np.zeros(len(word), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(word), np.uint64)
    for k in range(64):
        carry = planes[k][word] ^ (np.uint64(0) - ((asked >> np.uint64(k)) & np.uint64(1)))
        for i, c in enumerate(count):
            count[i], carry = c ^ carry, c & carry
        over |= carry
        if k % 8 == 7 and k > radius:
            # the counters' number is over the radius where it has a higher bit first
            above, same = over, _ALL
            for i in reversed(range(len(count))):
                if radius >> i & 1:
                    same = same & count[i]
                else:
                    above, same = above | (same & count[i]), same & ~count[i]
            alive = above != _ALL
            if k == 63 or 4 * np.count_nonzero(alive) < 3 * len(alive):
                some, word, asked, over, above = some[alive], word[alive], asked[alive], over[alive], above[alive]
                count = [c[alive] for c in count]
    return some, ~above


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Label each node with the least one of its group, after adding the links u to v; in place."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def linked(members: list[np.ndarray], pairs: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of parts (a part with itself too): members that are linked, and the member that stands for their group."""
    size = np.array([len(m) for m in members])
    words = -(-size // 64)
    at = np.concatenate([[0], np.cumsum(words)])
    fps, real = np.zeros(at[-1] * 64, np.uint64), np.zeros(at[-1] * 64, bool)
    for m, a in zip(members, at * 64, strict=False):
        fps[a : a + len(m)], real[a : a + len(m)] = m, True
    planes, valid = vertical(fps), np.packbits(real, bitorder="little").view("<u8")
    label = np.arange(len(fps))
    # a word of the second part is held against members of the first, within one part only against those before its last
    of_word = [(w, at[i] * 64, min(size[i], 64 * (w - at[j] + 1)) if i == j else size[i]) for i, j in pairs for w in range(at[j], at[j] + words[j])]
    w, lo, n = (np.array(x, np.int64) for x in zip(*of_word, strict=True)) if of_word else (np.zeros(0, np.int64),) * 3
    ends = np.cumsum(n)
    for a in range(0, int(ends[-1]) if len(ends) else 0, SLAB):
        nth = np.arange(a, min(a + SLAB, int(ends[-1])))
        row = np.searchsorted(ends, nth, side="right")
        asked = lo[row] + nth - (ends[row] - n[row])
        some, lanes = near_words(planes, w[row], fps[asked], radius)
        hit, lane = np.nonzero(np.unpackbits((lanes & valid[w[row[some]]]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        joined(label, asked[some[hit]], w[row[some[hit]]] * 64 + lane)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[moved], fps[label[moved]]


def links(nodes: DataFrame, radius: int, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """u, v (long): links that join all of nodes (fp) whose fingerprints can be reached from one another by steps of at most `radius` bits."""
    told = masks(blocks or blocks_for(nodes.count(), radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in told]
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    placed = nodes.select("fp", F.inline(tables))
    sizes = placed.groupBy("table", "key").agg(F.count("*").alias("size"))
    big = scratch.save(sizes.where(F.col("size") > LANES).select("table", "key", F.ceil(F.col("size") / LANES).cast("int").alias("parts")), "big")
    if big.isEmpty():
        told_parts = placed.withColumn("parts", F.lit(1))
    else:
        told_parts = placed.join(big, ["table", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = told_parts.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fp"), "parts").cast("int")).otherwise(F.lit(0)))
    parts = parted.groupBy("table", "key", "parts", "part").agg(F.collect_list("fp").alias("fps"))
    if big.isEmpty():
        pairs = parts.where(F.size("fps") > 1).select(F.col("fps").alias("x"), F.lit(None).cast("array<long>").alias("y"))
    else:
        parts = scratch.save(parts.where("parts > 1 or size(fps) > 1"), "parts")
        alone = parts.where(F.size("fps") > 1).select(F.col("fps").alias("x"), F.lit(None).cast("array<long>").alias("y"))
        met = lambda name, low, high: parts.where("parts > 1").select("table", "key", F.col("fps").alias(name), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__i"), "part").where(F.col("__i") > F.col("part") if name == "x" else F.col("__i") < F.col("part")).select("table", "key", name, *[F.col(c).alias(n) for c, n in (("part", low), ("__i", high))])
        pairs = alone.union(met("x", "i", "j").join(met("y", "j", "i"), ["table", "key", "i", "j"]).select("x", "y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, of = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                members.append(x.values.to_numpy().view(np.uint64))
                of.append((len(members) - 1, len(members) - 1 + y.is_valid))
                if y.is_valid:
                    members.append(y.values.to_numpy().view(np.uint64))
            u, v = linked(members, of, radius)
            yield pa.RecordBatch.from_pydict({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.mapInArrow(compare, "u long, v long")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable) for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    signed = scratch.save(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.save(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    comps = components(scratch.save(links(nodes.select("fp"), radius, scratch).distinct(), "links"), scratch)
    named = nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = named.join(least, "comp").select("fp", "component_id")
    return signed.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
