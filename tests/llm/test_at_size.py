"""The secret linker against all pairs of parts, and neighbours at a size where the share sets the window."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataline.llm import ann, secrets


def test_links_equal_all_pairs(spark):
    """Random parts in random places: a candidate is linked if, and only if, each complement has a start within the scope."""
    rng = random.Random(13)
    kinds, scope = (*secrets.KINDS, *secrets.WEAK_KINDS), 200
    texts = {}
    for i in range(400):
        spread = rng.choice([300, 1500, 6000])
        starts = sorted(rng.sample(range(spread), rng.randint(1, 14)))
        own = [rng.choice(kinds) for _ in starts]
        texts[f"t{i}"] = [(s, kinds.index(k), s + rng.randint(1, 40), k) for s, k in zip(starts, own, strict=True)]
    texts["edge"] = [(0, 1, 5, "access"), (200, 3, 210, "key"), (401, 3, 410, "key"), (1000, 4, 1010, "login"), (1200, 5, 1210, "endpoint"), (1400, 0, 1410, "assign")]
    df = spark.createDataFrame(list(texts.items()), "key string, all_parts array<struct<start:int,nth:int,end:int,kind:string>>").repartition(4)
    got = {r.key: sorted(map(tuple, r.added)) for r in secrets.links(df, scope).collect()}
    want = {}
    for key, parts in texts.items():
        near = lambda p, role, parts=parts: any(secrets.ROLES[q[3]] == role and abs(q[0] - p[0]) <= scope for q in parts)
        own = sorted(p for p in parts if p[3] in secrets.WEAK_KINDS and all(near(p, role) for role in secrets.NEEDS[p[3]]))
        if own:
            want[key] = own
    assert got == want
    assert want["edge"] == [(200, 3, 210, "key"), (1200, 5, 1210, "endpoint")]
    assert sum(map(len, want.values())) > 300 and sum(sum(p[3] in secrets.WEAK_KINDS for p in t) for t in texts.values()) > sum(map(len, want.values())) + 100


def test_recall_where_the_share_sets_the_window(spark):
    """Of 20,000 random directions, nine in ten of the nearest five are found, and fewer with half the share."""
    n, dims, asked = 20_000, 64, 200
    assert 0.06 * n / 2 > 256  # else the least window would hold
    v = np.random.default_rng(5).normal(size=(n, dims)).astype(np.float32)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(8)
    queries = np.arange(0, n, n // asked)
    near = unit[queries] @ unit.T
    near[np.arange(len(queries)), queries] = -9
    best = {int(q): set(np.argsort(-s)[:5].tolist()) for q, s in zip(queries, near, strict=True)}

    def recall(**how) -> float:
        got: dict = {}
        for r in ann.search(rows, F.col("vec_id") % (n // asked) == 0, k=5, **how).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        return sum(len(best[q] & got[q]) for q in best) / (5 * len(best))

    whole, half = recall(), recall(share=0.03)
    assert whole >= 0.9 > half, (whole, half)
