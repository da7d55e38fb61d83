"""Plain Python statements of what the operators have to give."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return text.translate({i: i + 32 for i in range(65, 91)})


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str) -> tuple:
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    said = [f"{kind}:{a}:{b}" for a, _, kind, b in found]
    return (*(sum(x[1] == k for x in found) for k in range(3)), sha(",".join(said))), said


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d * 2 - 9 * (d > 4) if i % 2 else d
    return total % 10 == 0


def pii(text: str) -> tuple:
    bare = lambda h: re.sub("[^0-9]", "", h)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(bare(h)) <= 19 and luhn(bare(h))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(bare(h)) <= 15),
    ]
    said, n = [], []
    for kind, pattern, ok in rules:
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m[0])]
        n.append(len(own))
        said += own
    return (*n, sha(",".join(said))), said


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(items: list[tuple], size: int = 10) -> dict[tuple, set[str]]:
    out: dict[tuple, set[str]] = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text or ""))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            out[tuple(words[i : i + n])].add(str(item))
    return out


def contamination(text: str, held: dict[tuple, set[str]]) -> tuple:
    words, hit, items = WORD.findall(lower(text)), set(), set()
    for n in {len(w) for w in held}:
        for i in range(len(words) - n + 1):
            if (w := tuple(words[i : i + n])) in held:
                hit |= set(range(i, i + n))
                items |= held[w]
    return len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)


def shingles(text: str, size: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_groups(docs: list[tuple], size: int, percent: int = 80) -> dict:
    """doc_id to (set size, component) by comparing every pair."""
    sets = {i: shingles(t or "", size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_dedup(docs: list[tuple], size: int = 3) -> dict:
    """doc_id to (lines, removed, text); docs come in order."""
    seen, gone = {}, defaultdict(set)
    for i, text in sorted(docs):
        lines = text.split("\n")
        for k in range(len(lines) - size + 1):
            w = tuple(lines[k : k + size])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone[i] |= set(range(k, k + size))
            seen.setdefault(w, (i, k))
    return {i: (len(t.split("\n")), len(gone[i]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in docs}


def encoded(texts: list[str], end: int) -> list[list[int]]:
    from tokenizers import Tokenizer

    from strataline.llm.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    return [tok.encode(t, add_special_tokens=False).ids + [end] for t in texts]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """One bin after another, each piece for itself."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        own, gap = [], capacity
        while (fit := next((x for x in left if x <= gap), None)) is not None:
            own.append(fit)
            left.remove(fit)
            gap -= fit
        if gap and len(left) > 1:
            room, best = gap + own[-1], None
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    total = left[i] + left[j]
                    if own[-1] < total <= room and (best is None or (total, left[i]) > best[0]):
                        best = ((total, left[i]), left[i], left[j])
            if best:
                left.append(own.pop())
                for x in best[1:]:
                    left.remove(x)
                    own.append(x)
                left.sort(reverse=True)
        bins.append(own)
    return bins


def slots(shards: list[str], size: int) -> list[int]:
    """Owner of each slot: shards choose in turn, each from its whole order of preference."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    orders = []
    for name in shards:
        start, stride = number(f"{name}|start") % size, number(f"{name}|stride") % (size - 1) + 1
        orders.append(iter([(start + k * stride) % size for k in range(size)]))
    owner: dict[int, int] = {}
    turn = 0
    while len(owner) < size:
        mine = turn % len(shards)
        owner[next(s for s in orders[mine] if s not in owner)] = mine
        turn += 1
    return [owner[s] for s in range(size)]


def slot_of(*keys, size: int) -> int:
    text = "\x1f".join("-" if k is None else f"={k}" for k in keys)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % size


def nearest(rows: list[tuple], asked, k: int) -> dict:
    """Of each asked id the k (id, cosine) of largest cosine, ties to the smaller id; components are summed in order."""
    def dot(x, y):
        total = 0.0  # sum() would compensate for rounding
        for a, b in zip(x, y, strict=True):
            total += a * b
        return total

    out = {}
    for q, x in rows:
        if asked(q):
            near = [(-(dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))), i) for i, y in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out
