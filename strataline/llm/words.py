"""Words of the texts of an Arrow batch, as places in their bytes and as 64-bit hashes.

Numpy works on all texts of a slice at once.  A hash takes one step for each
of the first LONG bytes of the slice's words; longer words, whatever their
length, are hashed one by one by xxHash.

Defined cases: a null text counts as empty and has no words; a text of nothing
but separators has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
#: The lower-case form of each byte, for A-Z only.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Longest word, in bytes, that is hashed beside the others.
LONG = 64
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def blanks(codes: bytes) -> np.ndarray:
    """For each byte whether it separates words."""
    return np.isin(np.arange(256), list(codes))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more than texts); null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the texts that lie in `data` between offsets starts and ends."""
    space = blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    end = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    return start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word in lower case."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    start_, alive = start[order], size[order]
    long = int(np.searchsorted(-alive, -LONG, side="left"))
    h = np.full(len(start), ODD, np.uint64)
    n, j = len(start), 0
    while n > long:
        h[long:n] = (h[long:n] ^ _BYTE[LOWER[data[start_[long:n] + j]]]) * np.uint64(0xD6E8FEB86659FD93)
        h[long:n] ^= h[long:n] >> np.uint64(32)
        j += 1
        n = int(np.searchsorted(-alive, -j, side="left"))
    for i in range(long):
        h[i] = xxhash.xxh64_intdigest(LOWER[data[start_[i] : start_[i] + alive[i]]].tobytes(), 20)
    out = np.empty_like(h)
    out[order] = h
    return out
