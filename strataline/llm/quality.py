"""Quality scores by positive-unlabelled learning.

A document is described by its shape only: shares of capitals, marks, digits
and repeated words over the whole text and in its worst line, line and word
variety, length.  Each number enters through hat functions at fixed knots, so
the model is piecewise linear in it.

Learning uses trusted positives (labels of 1 in the training fold) and the
training fold's documents as unlabelled text.  With the squared loss the
non-negative risk

    prior * P[l(g, +1)] + max(0, U[l(g, -1)] - prior * P[l(g, -1)])

is a function of first and second moments of the two sets.  Spark sums those
over all documents (a few thousand numbers), and the driver minimises the risk
exactly on them; nothing is sampled.  With this loss g estimates twice the
chance of a positive less one, so the score is (1 + g) / 2, cut to 0..1.

The class prior is estimated from the two sets alone: no region can hold a
smaller share of the unlabelled than prior times its share of the positives,
so the least ratio over regions with enough positives bounds it.

Defined cases: null and empty texts have all-zero shape and get a score like
any other; a null id is never held out and never matches a label; an id with
labels of both kinds is no positive; repeated rows are scored alike; with no
positives every score is the prior 0.5; only doc_id and text, and doc_id and
quality of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fingerprint, need
from strataline.llm.minhash import hashed_words, text_slices
from strataline.llm.words import text_bytes
from strataline.session import Scratch

#: Knots of each number's hat functions.
SHARES = (0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7, 1.0)
KNOTS: dict[str, tuple[float, ...]] = {
    "capitals": SHARES,
    "capitals_worst": SHARES,
    "marks": SHARES,
    "marks_worst": SHARES,
    "digits": SHARES,
    "repeats": SHARES,
    "repeats_worst": SHARES,
    "bars": SHARES,
    "bars_worst": SHARES,
    "word_variety": (0.0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0),
    "line_variety": (0.0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0),
    "word_length": (0.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0, 20.0),
    "length": (0.0, 2.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0),
    "rough_share": SHARES,
}
N_BASIS = 1 + sum(len(k) - 1 for k in KNOTS.values())
_MARKS = np.isin(np.arange(256), list(b"!#$%&*@^~<>{}[]=+_\\/"))
_DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def shapes(texts: pa.Array) -> np.ndarray:
    """One row of numbers, named by KNOTS, for each text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(KNOTS)))
    if not len(data):
        return out
    feed = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= feed
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(data))
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    capital = _CAPITAL[data]
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)

    def per_line(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (upto[ends] - upto[starts]).astype(np.float64)

    size = (ends - starts).astype(np.float64)
    words, at = hashed_words(data, offsets)
    line_of = np.searchsorted(starts, at, side="right") - 1
    n_words = np.bincount(line_of, minlength=len(starts)).astype(np.float64)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    lines = {
        "capitals": per_line(capital),
        "marks": per_line(_MARKS[data]),
        "digits": per_line(_DIGITS[data]),
        "repeats": np.bincount(line_of[same], minlength=len(starts)).astype(np.float64),
        "bars": per_line(data == 124),
    }
    whole = lambda x: np.bincount(text_of, x, minlength=n)
    bytes_, count = np.maximum(whole(size), 1), whole(n_words)
    over = {"repeats": np.maximum(n_words, 1), "bars": np.maximum(n_words, 1)}
    cols = {}
    rough = np.zeros(len(starts), bool)
    for name, x in lines.items():
        share = x / over.get(name, np.maximum(size, 1))
        cols[name] = whole(x) / (np.maximum(count, 1) if name in over else bytes_)
        if name != "digits":
            worst = np.zeros(n)
            long = n_words >= 4
            np.maximum.at(worst, text_of[long], share[long])
            cols[f"{name}_worst"] = worst
            rough |= long & (share > 0.1)
    cols["rough_share"] = whole(size * rough) / bytes_
    bounds = np.searchsorted(at, offsets)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    cols["word_variety"] = distinct / np.maximum(count, 1)
    line_key = np.zeros(len(starts), np.uint64)
    place = np.arange(len(words)) - np.searchsorted(line_of, line_of) + 1
    np.add.at(line_key, line_of, words * (2 * place + 1).astype(np.uint64))
    filled = n_words > 0
    n_lines = np.bincount(text_of[filled], minlength=n)
    pairs = np.unique(np.stack([text_of[filled].astype(np.uint64), line_key[filled]], axis=1), axis=0)
    cols["line_variety"] = np.bincount(pairs[:, 0].astype(np.int64), minlength=n) / np.maximum(n_lines, 1)
    cols["word_length"] = (whole(size) - whole(per_line(data == 32))) / np.maximum(count, 1)
    cols["length"] = np.log1p(count)
    for j, name in enumerate(KNOTS):
        out[:, j] = cols[name]
    out[whole(size) == 0] = 0
    return out


def basis(x: np.ndarray) -> np.ndarray:
    """A constant and the hat functions of each number (less the first of each, as they sum to one)."""
    out = [np.ones((len(x), 1))]
    for j, knots in enumerate(KNOTS.values()):
        k = np.array(knots)
        v = np.clip(x[:, j], k[0], k[-1])
        i = np.clip(np.searchsorted(k, v, side="right") - 1, 0, len(k) - 2)
        t = (v - k[i]) / (k[i + 1] - k[i])
        hats = np.zeros((len(x), len(k)))
        rows = np.arange(len(x))
        hats[rows, i], hats[rows, i + 1] = 1 - t, t
        out.append(hats[:, 1:])
    return np.concatenate(out, axis=1)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(KNOTS))


def moments(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, mean and second moments of their basis, summed by Spark: the driver gets as many numbers as the basis has pairs."""
    upper = np.triu_indices(N_BASIS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_BASIS, N_BASIS))
        for batch in batches:
            b = basis(_numbers(batch))
            total += b.T @ b
        v = total[upper]
        k = np.flatnonzero(v)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k.astype(np.int64)), "v": v[k]})

    s = np.zeros((N_BASIS, N_BASIS))
    for r in rows.select("x").mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        s[upper[0][r.k], upper[1][r.k]] = r.v
    s += np.triu(s, 1).T
    n = s[0, 0]
    return n, s[0] / max(n, 1), s / max(n, 1)


def estimated_prior(m_p: np.ndarray, m_u: np.ndarray, least: float = 0.05) -> float:
    """The least ratio of unlabelled to positive mass over hat functions that hold at least that share of the positives."""
    held = m_p >= least
    return float(np.clip((m_u[held] / m_p[held]).min(initial=1.0), 0.05, 0.99))


def minimise(prior: float, m_p: np.ndarray, s_p: np.ndarray, m_u: np.ndarray, s_u: np.ndarray, ridge: float = 1e-4, steps: int = 500) -> np.ndarray:
    """Weights of least non-negative risk.

    Where the bracket is not negative at the unclamped minimum, that is the
    answer; else steps go down the risk where the bracket is positive and up
    the bracket where it is negative, and the best point met is returned.
    """
    eye = ridge * np.eye(len(m_p))

    def bracket(w: np.ndarray) -> float:
        return (1 + 2 * w @ m_u + w @ s_u @ w) / 4 - prior * (1 + 2 * w @ m_p + w @ s_p @ w) / 4

    def risk(w: np.ndarray) -> float:
        return prior * (1 - 2 * w @ m_p + w @ s_p @ w) / 4 + max(0.0, bracket(w)) + w @ eye @ w

    w = np.linalg.solve(s_u + 4 * eye, 2 * prior * m_p - m_u)
    best = w
    if bracket(w) >= 0:
        return w
    scale = np.linalg.inv(s_u + s_p + 4 * eye)
    for _ in range(steps):
        down = (m_u + s_u @ w - prior * (m_p + s_p @ w)) / 2
        if bracket(w) >= 0:
            grad = prior * (s_p @ w - m_p) / 2 + down + 2 * eye @ w
        else:
            grad = -down
        w = w - 0.5 * scale @ grad
        if risk(w) < risk(best):
            best = w
    return best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, print, held_out, x (array of the shape's numbers) for every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                x = shapes(batch.column("text")).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(KNOTS)), pa.array(x))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "print": batch.column("print"), "held_out": batch.column("held_out"), "x": lists})

    told = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), fingerprint(F.col("text")).alias("print"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return told.mapInArrow(describe, "doc_id long, print string, held_out boolean, x array<double>")


def train(shaped: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the training fold of described documents and the labels of it."""
    trusted = need(labels, "doc_id", "quality").where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    training = shaped.where("not held_out")
    n_p, m_p, s_p = moments(training.join(trusted, "doc_id", "left_semi"))
    n_u, m_u, s_u = moments(training)
    return minimise(estimated_prior(m_p, m_u), m_p, s_p, m_u, s_u) if n_p and n_u else np.zeros(N_BASIS)


def chances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip((1 + basis(x) @ w) / 2, 0, 1)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, print, held_out, score, predicted for every row."""
    shaped = Scratch(docs.sparkSession, "quality").save(described(docs), "shapes")
    w = train(shaped, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chances(_numbers(batch), w)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "print": batch.column("print"), "held_out": batch.column("held_out"), "score": p, "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return shaped.mapInArrow(judge, "doc_id long, print string, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs`, all columns, without the documents that the classifier rejects.

    Texts are described once more where they are, which costs less than
    shuffling them to meet their scores.
    """
    w = train(Scratch(docs.sparkSession, "quality").save(described(docs), "shapes"), labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                yield batch.filter(pa.array(chances(shapes(batch.column("text")), w) >= 0.5))

    return docs.mapInArrow(judge, docs.schema)
