"""Fill-in-the-middle, collocations and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strataline.llm import fim, phrases, simhash
from strataline.llm.queries import oracle_sql, queries
from strataline.llm.words import blanks, text_bytes, word_bounds, word_hashes
from strataline.session import Scratch
from strataline.sources.tables import table
from tests.llm import brute
from tests.oracle import compare, duck

DOCS = "doc_id long, text string"
TEXTS = [None, "", " ", "a", "Ab1é😀\n\tzz", "x<P>y", "<S", "<M>", "P><S", "a" * 3000, "-" * 3000, "ab-" * 2000, "$1\\2 $3", "\x00 \r\n", "é" * 50, "😀a" * 70]
CLASHING = ["n", "form", "output", "fp", "u", "w1", "f", "rep", "__a", "size"]


def crowded(df):
    """The rows with columns whose names the operators use themselves."""
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


# -- fill in the middle


def middle(doc_id, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_middles_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(TEXTS)) for i in range(400)] + [(500 + i, "".join(rng.choice("aB1 é😀<>PSM\n") for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(None, "some text"), (7, "again"), (7, "again")]
    df = crowded(spark.createDataFrame(rows, DOCS))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.transform(df).collect())
    assert got == Counter((i, *middle(i, t)) for i, t in rows)
    forms = Counter(x[2] for x in got)
    assert min(forms.values()) > 20 and len(forms) == 3
    got = Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.digest(df).collect())
    assert got == Counter((i, brute.sha(middle(i, t)[4]), brute.sha(t or "")) for i, t in rows)


def test_middle_of_a_very_long_text(spark):
    """No recursion and no backtracking: five million characters of one word, of no word, and of both."""
    rows = [(i, t) for i in range(3) for t in ["ab" * 2_500_000, "ab- " * 500_000, "-" * 300_000]]
    got = {(r.doc_id, r.n, r.form, r.output_sha256, r.restored_sha256) for r in fim.digest(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    want = {(i, *(m := middle(i, t))[:2], brute.sha(m[4]), brute.sha(t)) for i, t in rows}
    assert got == want


def test_other_marks_and_seeds(spark):
    df = spark.createDataFrame([(i, f"some $1 text \\ {i} of words") for i in range(50)], DOCS)
    marks = ("[$pre]", "[\\suf]", "[mid]")
    out = fim.transform(df, seed=9, percent=100, spm_percent=50, marks=marks)
    back = out.select("text", "form", fim.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert all(r.text == r.back for r in back) and {r.form for r in back} == {"psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0
    for wrong in (("<P>", "<P>", "<M>"), ("ab", "bc", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="marks overlap"):
            fim.transform(df, marks=wrong)


# -- collocations


def collocations(rows, least, depth, top):
    """Every phrase counted where it stands, scores as fractions."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", brute.lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        f = {p: n for p, n in f.items() if n >= least}
        own = []
        for p, a in f.items():
            if len(p) < 2 or any(len(q) > len(p) and n >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in f.items()):
                continue
            score, _, left, right = min((int(Fraction(1000 * a * total[lang], f[p[:k]] * f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(out)


def some_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "é", "x y", "😀", "New", "YORK", "city"]
    fixed = ["new york city hall", "a b a b a b a b", "the same five words again and again", "é é é"]
    say = lambda: rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary)
    return [(rng.choice(["en", "de", None, "und"]), "".join(say() + rng.choice([" ", "  ", "\t", ". ", ", ", "\n", "!"]) for _ in range(rng.randint(0, 25)))) for _ in range(n)] + [("en", None), ("en", ""), (None, None)]


@pytest.mark.parametrize("most", [1 << 17, 40, 3])
def test_collocations_match_brute_force(spark, monkeypatch, most):
    """With leads of any size, so that hot ones are routed by more words."""
    monkeypatch.setattr(phrases, "MOST_ROWS", most)
    rows = some_texts(most, 400)
    df = crowded(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5))
    got = sorted(tuple(r) for r in phrases.collocations(df, least=8, depth=5, top=60).collect())
    assert got == collocations(rows, 8, 5, 60)
    assert len(got) > 80


def test_full_bit_tables_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WORD_BITS", 8)
    monkeypatch.setattr(phrases, "PAIR_BITS", 8)
    rows = some_texts(77, 200)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(df, least=6, depth=4, top=50).collect()) == collocations(rows, 6, 4, 50)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_past_64_bits(spark, monkeypatch):
    """Counts of a corpus of 4 * 10^12 words."""
    schema = "lang_id long, p array<long>, f long"
    told = spark.createDataFrame([(1, [1], 3 * 10**12), (1, [2], 7 * 10**11), (1, [1, 2], 6 * 10**11 + 1)], schema)
    words = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "y", 1)], "lang_id long, id long, word string, f long")
    langs = spark.createDataFrame([("en", 1, 4 * 10**12)], "lang string, lang_id long, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *a: (told, words, langs))
    (r,) = phrases.collocations(told).collect()
    assert r.score == 1000 * (6 * 10**11 + 1) * 4 * 10**12 // (3 * 10**12 * 7 * 10**11)


def test_quicksort_counts():
    rng = np.random.default_rng(3)
    columns = [rng.integers(1, 3, 3000).astype(np.uint64), *[rng.integers(0, 4, 3000).astype(np.uint64) for _ in range(4)]]
    for k in range(2, 5):
        columns[k] = np.where(columns[k - 1] == 0, 0, columns[k])
    row, words, f = phrases.quicksorted(columns, 0, 12)
    got = {tuple(int(c[i]) for c in columns[: w + 1]): n for i, w, n in zip(row.tolist(), words.tolist(), f.tolist(), strict=True)}
    want = Counter()
    for key in zip(*[c.tolist() for c in columns], strict=True):
        for w in range(1, 5):
            if key[w]:
                want[key[: w + 1]] += 1
            else:
                break
    assert got == {k: n for k, n in want.items() if n >= 12}


# -- words


def test_words_of_any_length():
    rng = random.Random(8)
    texts = ["", None, "  ", *["".join(rng.choice(["aB", "é", " ", "x" * rng.randint(1, 300), "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]]
    data, offsets = text_bytes(pa.array(texts))
    start, end = word_bounds(data, offsets, blanks(b" \t\n\v\f\r"))
    said = [bytes(data[a:b]) for a, b in zip(start, end, strict=True)]
    assert said == [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    h = word_hashes(data, start, end).tolist()
    low = [re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for w in said]
    assert len(set(zip(low, h, strict=True))) == len(set(low)) == len(set(h))


# -- fingerprints


def fingerprint(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", brute.lower(text or ""))
    said = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in said]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reachable(fps, radius):
    """Least index of each number's group, by comparing every pair."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    fps = [fingerprint(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    of = reachable([fps[i] for i in order], 4)
    want = {(rows[i][0], f"{fps[i]:016x}", rows[order[of[k]]][0]) for k, i in enumerate(order)}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries()["op13_simhash_near_dedup"](spark, sf).collect()}
    assert got == want and len({c for _, _, c in got}) < len(got)


def test_awkward_fingerprints(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(1, None), (2, ""), (3, " \n "), (None, base), (5, base.upper()), (5, base), (6, "one two"), (7, "one  TWO"), (8, "é" * 5000 + " b c d"), (9, "w " * 100_000), (None, "nothing like it"), (10, "x" * 300_000)]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(crowded(spark.createDataFrame(rows, DOCS))).collect())
    group = {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}
    assert got == Counter((i, f"{fingerprint(t):016x}", group.get(i, 5 if t == base else None)) for i, t in rows)
    assert simhash.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_majority_of_many_hashes():
    rng = np.random.default_rng(2)
    n = [0, 1, 2, 254, 255, 256, 511, 70_000, 0, 3]
    h = rng.integers(0, 1 << 64, sum(n), np.uint64)
    first = np.concatenate([[0], np.cumsum(n)])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    want = [np.packbits(2 * bits[a:b].sum(axis=0, dtype=int) > b - a, bitorder="little").view("<u8")[0] for a, b in zip(first, first[1:], strict=False)]
    assert simhash.majority(h, first).tolist() == want


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_planes_give_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 64, 640, np.uint64)
    for i in range(1, 640, 2):  # half of them near another
        fps[i] = fps[i - 1]
        for b in rng.choice(64, rng.integers(1, radius + 3), replace=False):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    word, asked = np.repeat(np.arange(10), 640), np.tile(fps, 10)
    some, lanes = simhash.near_words(simhash.vertical(fps), word, asked, radius)
    got = {(int(asked_i), int(word[s]) * 64 + k) for s, m in zip(some.tolist(), lanes.tolist(), strict=True) for asked_i in [s % 640] for k in range(64) if m >> k & 1}
    want = {(i, j) for i in range(640) for j in range(640) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize(("blocks", "lanes"), [(None, 4096), (5, 70), (6, 4096), (7, 300), (8, 65)])
def test_links_join_all_groups(spark, monkeypatch, blocks, lanes):
    """Any number of blocks, and buckets split into many parts, join the same groups."""
    monkeypatch.setattr(simhash, "LANES", lanes)
    rng = random.Random(lanes)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = set(seeds)
    for _ in range(900):
        x = rng.choice(seeds[:3] if rng.random() < 0.6 else seeds)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4), 4, Scratch(spark, "test"), blocks).collect()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        parent[find(r.u)] = find(r.v)
    of = reachable(fps, 4)
    mine: dict = {}
    assert all(mine.setdefault(find(x), g) == g for x, g in zip(signed, of, strict=True)) and len(mine) == len(set(of))


def test_one_block_more_for_more_fingerprints():
    assert simhash.blocks_for(0, 4) == simhash.blocks_for(1_000_000, 4) == 5
    assert [simhash.blocks_for(10**k, 4) for k in (8, 10, 12)] == [6, 7, 8]
    for blocks in (5, 6, 7, 8):
        assert all(m.bit_count() >= 64 * (blocks - 4) // blocks - 1 for m in simhash.masks(blocks, 4))


# -- SQL


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_collocations"])
def test_queries_equal_their_sql(spark, sf, name):
    big = sf.replace("sf0.001", "sf0.01") if name == "op12_collocations" else sf
    assert compare(queries()[name](spark, big), duck(big), oracle_sql()[name]) == ""


def test_a_word_of_five_million_letters(spark):
    """One long word costs what its bytes cost, in sets, shapes, phrases and fingerprints alike."""
    import time

    from strataline.llm import minhash, quality

    texts = pa.array(["x" * 5_000_000, "base64" * 800_000 + " and words", None, "a b c"])
    began = time.perf_counter()
    sets, at = minhash.shingle_sets(texts, 5)
    assert np.diff(at).tolist() == [1, 1, 0, 1] and len(sets) == 3
    assert quality.shapes(texts).shape == (4, len(quality.KNOTS))
    simhash.majority(*simhash.shingle_hashes(texts, 4))
    assert time.perf_counter() - began < 10
