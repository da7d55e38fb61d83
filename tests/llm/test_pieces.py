"""Stops and lines' ends as pieces of their own: ids as of whole texts, few distinct pieces, and frequent pieces stay."""

import random

import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from strataline.llm.tokens import PieceEncoder, default_tokenizer  # noqa: E402


@pytest.mark.parametrize("cap", [300, 400_000])
def test_ids_around_stops_and_line_ends(cap):
    tok, enc, rng = Tokenizer.from_file(default_tokenizer()), PieceEncoder(default_tokenizer(), cap=cap), random.Random(5)
    parts = [*"abÉßÿµªºŁ字1²'.,;:!?\n\n\n\r\t\x01\x02·×", ". ", ", ", ".\n", "\n\n", "'s", "\n'", " ", " ", "word", "<|endoftext|>"]
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(3000)]
        texts += [None, "\x01", "a\nb\nc\nd", "a.\nB. C\nD", "a, \x01b", " a. b", "a,\n\nb", "a. ", "a,b. c"]
        want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        ids, n = enc.encode(pa.array(texts, pa.string()))
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_words_before_and_after_stops_are_shared():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    enc = PieceEncoder(default_tokenizer())
    enc.encode(pa.array(["".join(rng.choice(words) + rng.choice([" ", ", ", ".\n", "\n"]) for _ in range(40)) + "end" for _ in range(2000)]))
    # each word with a space before it and without, and what stands between
    assert enc.n < 2 * len(words) + 200


def test_what_is_met_again_stays():
    rng = random.Random(9)
    enc = PieceEncoder(default_tokenizer(), cap=1000)
    for i in range(30):
        enc.encode(pa.array(["common words stay " + " ".join("".join(rng.choice("qwertz") for _ in range(9)) for _ in range(200))]))
        assert i < 1 or " words" in enc.slot
        assert enc.n < 1000 + 250
    learnt = []
    enc._learn, before = (lambda fresh, f=enc._learn: (learnt.extend(fresh), f(fresh))), enc.n
    enc.thin()
    assert enc.n < before
    enc.encode(pa.array(["common words stay"]))
    assert not learnt
