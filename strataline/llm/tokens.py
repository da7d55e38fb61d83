"""Exact, memoised encoding with a byte-level BPE tokenizers file, for Spark tasks.

The file's pre-tokenizer never lets a token cross the start of a " x" pair
(one U+0020 before a character that is no blank of any kind), nor the border
between a letter and a following mark other than an apostrophe.  Texts are
therefore cut at the former, Arrow numbers the distinct pieces of a batch, and
only pieces that this worker has not met go through the library (a word and
the marks after it separately).  A text with a U+0020 before another blank, or
at its end, is cut on its own, so that runs of blanks stay whole.  Before that
a stop after a letter, and a line's end between letters, become pieces of their
own, which makes distinct pieces far fewer.  Added tokens
of the file, such as <|endoftext|>, are one id each wherever they stand.  The
ids equal those of encoding the whole text at once, with the library's
settings as the file sets them.

Defined cases: a null text counts as empty and has no ids; an empty array has
none; texts may be of any length and hold any character.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The sign of pieces (see _OWN), and a space before a blank (in Unicode's sense, and what Python takes for one) or at the end.
_LONE = r"\x01| ([\t-\r\x{1c}-\x{20}\x{85}\x{180e}\p{Z}]|$)"
#: Below this character Python and the library agree on what a letter is; later ones depend on their editions of Unicode.
_SURE = "\u1c80"
_CUT = re.compile(r"(?= \S)")
#: What becomes a piece of its own, behind a space and this sign: a stop between a letter and a space, and what is around a single line's end.
_SIGN = "\x01"
_LETTER = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])"
_OWN = ((rf"{_LETTER}([.,;:!?]) ", f"\\1 {_SIGN}\\2 "), (rf"{_LETTER}([.,;:!?]?)\n{_LETTER}", f"\\1 {_SIGN}\\2 {_SIGN}\n {_SIGN}\\3"))
_TAIL = re.compile(r"( ?[^\W\d_]+)([^\w\s']+)")


def _byte_letters() -> str:
    """The letter that stands for each byte value in byte-level BPE vocabularies: printable bytes stand for themselves, the others for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


def _strings(texts: pa.Array) -> list[str]:
    """As to_pylist(), at a fraction of its time."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Remembers at most about `cap` pieces, or 5 * `cap` ids; beyond, only those stay that were met again since they came or last stayed."""

    def __init__(self, path: str, cap: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would hold memory of its own
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.tok.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.added = frozenset(added)
        self.marks = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.odd = "|".join([_LONE, *map(re.escape, added)])
        self.letters = dict(enumerate(_byte_letters()))
        self.line_end = self.letters[10]
        self.cap = cap
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.n = self.used = 0
        self.again = np.zeros(1 << 16, bool)
        self.at = np.zeros(1 << 16, np.int32)
        self.len = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint16 if self.tok.get_vocab_size() < 1 << 16 else np.uint32)
        self._put([""], np.zeros(0, self.flat.dtype), np.zeros(1, np.int32))

    def thin(self) -> None:
        """Forgets the pieces that were met once; all, if the others are over half of what may stay."""
        kept = 1 + np.flatnonzero(self.again[1 : self.n])
        ids, lens = self._gather(kept)[0], self.len[kept]
        names = list(self.slot)  # in the order of their slots
        self.forget()
        if 2 * len(kept) <= self.cap and 2 * len(ids) <= 5 * self.cap:
            self._put([names[i] for i in kept.tolist()], ids, lens)

    def _put(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n, used = self.n + len(pieces), self.used + len(ids)
        while n > len(self.at):
            self.at, self.len, self.again = (np.concatenate([a, np.zeros_like(a)]) for a in (self.at, self.len, self.again))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = ids
        self.len[self.n : n] = lens
        self.at[self.n : n] = self.used + np.cumsum(lens) - lens
        self.slot.update(zip(pieces, range(self.n, n), strict=True))
        self.n, self.used = n, used

    def _gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in slots k, one after another, and where each ends."""
        n = self.len[k]
        ends = np.cumsum(n, dtype=np.int64)
        where = np.repeat(self.at[k] - (ends - n).astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        return self.flat[where], ends

    def _learn(self, fresh: list[str]) -> None:
        whole, composed = [], []
        sure = max("".join(fresh), default="") < _SURE
        for piece in fresh:
            m = None if (piece[1:] if piece[:1] == " " else piece).isalpha() else _TAIL.fullmatch(piece) if sure or piece and max(piece) < _SURE else None
            (composed.append((piece, m[1], m[2])) if m else whole.append(piece))
        known = self.slot
        whole = list({x for _, a, b in composed for x in (a, b) if x not in known}.union(whole))
        words = [x for x in whole if (x[1:] if x[0] == " " else x).isalpha() and (sure or max(x) < _SURE) and x not in self.added]
        others = list(set(whole).difference(words))
        bpe, letters = self.tok.model.tokenize, self.letters
        spelt = "\n".join(words).encode().decode("latin-1").translate(letters).split(self.line_end) if words else []
        ids, lens = array("I"), array("I")
        for x in spelt:
            got = bpe(x)
            lens.append(len(got))
            ids.extend([t.id for t in got])
        for i in range(0, len(others), 8192):
            for e in self.tok.encode_batch_fast(others[i : i + 8192], add_special_tokens=False):
                lens.append(len(e))
                ids.extend(e.ids)
        self._put(words + others, np.asarray(ids), np.asarray(lens))
        if composed:
            k = np.array([(self.slot[a], self.slot[b]) for _, a, b in composed]).ravel()
            got, _ = self._gather(k)
            self._put([x for x, _, _ in composed], got, self.len[k].reshape(-1, 2).sum(axis=1))

    def _slots(self, pieces: list[str]) -> np.ndarray:
        known = self.n
        if fresh := [x for x in pieces if x not in self.slot]:
            self._learn(list(dict.fromkeys(fresh)))
        k = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        self.again[k[k < known]] = True
        return k

    def _cut(self, text: str) -> list[str]:
        """Pieces of any text; the file's added tokens stay whole, and what is between them is encoded like a text of its own."""
        parts = self.marks.split(text) if self.marks else [text]
        return [x for p in parts for x in ([p] if p in self.added else _CUT.split(p)) if x]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow string array in one array, and the number of ids of each text; null counts as empty."""
        if self.n > self.cap or self.used > 5 * self.cap:
            self.thin()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, self.flat.dtype), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        for pattern, own in _OWN:
            plain = pc.replace_substring_regex(plain, pattern, own)
        split = pc.split_pattern(plain, " ")
        parts = split.flatten().dictionary_encode()
        slots = self._slots([x[1:] if x[:1] == _SIGN else " " + x for x in _strings(parts.dictionary)])[parts.indices.to_numpy()]
        counts = np.diff(split.offsets.to_numpy())
        firsts = np.cumsum(counts) - counts
        # an empty first piece (the text begins with a space) has no ids
        slots[firsts] = self._slots(_strings(parts.dictionary.take(parts.indices.take(pa.array(firsts)))))
        keep = np.repeat(~odd & (pc.binary_length(texts).to_numpy() > 0), counts)
        mixed: list[np.ndarray] = []
        if odd.any():
            at = 0
            for i, n in enumerate(counts):
                if odd[i]:
                    mixed.append(self._slots(self._cut(texts[i].as_py())))
                else:
                    mixed.append(slots[at : at + n][keep[at : at + n]])
                at += n
            k, counts = np.concatenate(mixed), np.array([len(x) for x in mixed])
        else:
            k, counts = slots[keep], np.where(pc.binary_length(texts).to_numpy() > 0, counts, 0)
        ids, ends = self._gather(k)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        pa.default_memory_pool().release_unused()
        return ids, np.diff(upto)


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
