"""Vector codes and hard negatives against plain brute force, with nulls, ties, repeated rows, unlike lengths and large components."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import codes, hard_negatives
from tessera.llm.hard_negatives import relabelled
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, kf long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def odd_rows(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim)) / 3
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(dim) * 0.2
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    rows += [(n, None, 1), (n + 1, [1.0] * (dim - 1) + [None], 1), (n + 2, [float("nan")] * dim, 2), (n + 3, [float("inf")] * dim, 2)]
    rows += [rows[3], rows[3], (7, rows[8][1], 2), (100, rows[9][1], 1), (n + 4, rows[5][1], None), (None, rows[6][1], 1), (n + 5, [0.0] * dim, 0)]
    rows += [(n + 6 + k, rows[0][1], k % 3) for k in range(40)]  # equal vectors
    random.Random(seed).shuffle(rows)
    return rows


def brute_codes(rows, parts, entries, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if whole(v)]
    if not kept:
        return Counter()
    dim = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (square(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        held = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), h in zip(kept, held) if h[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    held = assign()
    errors = [sum(square(cut(v, p), books[p][h[p]]) for p in range(parts)) for (_, v, _), h in zip(kept, held)]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in h), e, labels[label], digest) for (i, _, label), h, e in zip(kept, held, errors))


@pytest.mark.parametrize("n,dim,scale", [(200, 32, 1.0), (30, 20, 1.0), (90, 16, 3e5), (20, 16, 1e13), (1, 16, 1.0)])
def test_codes(spark, n, dim, scale):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x * scale)) for x in v], label) for i, v, label in odd_rows(n, dim, n)] if n > 1 else [(5, [1.0] * dim, None)]
    if n == 30:
        rows += [(500, [1.0, 2.0], 0), (501, [], 1)]
    assert Counter(map(tuple, codes.codes(table(spark, rows)).collect())) == brute_codes(rows, 16, 64)


def test_codes_of_an_empty_table(spark):
    assert codes.codes(table(spark, [])).collect() == []
    assert codes.codes(table(spark, [(1, None, 2)])).collect() == []


def test_balls_are_plain_assignment():
    rng = np.random.default_rng(1)
    for spread in (1, 3, 40):
        for _ in range(20):
            x = rng.integers(-8 * spread, 8 * spread, (500, 2))
            book = rng.integers(-8 * spread, 8 * spread, (30, 2))
            assert (codes.reassigned(x, book, rng.integers(0, 30, 500)) == codes.nearest(x, book)).all()
            moved = book + rng.integers(-1, 2, book.shape)
            assert (codes.reassigned(x, moved, codes.nearest(x, book)) == codes.nearest(x, moved)).all()


def brute_negatives(rows):
    kept = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows if whole(v) and label is not None]
    out = Counter()
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, o)))), j, l) for b, (j, o, l) in enumerate(kept) if b != a and len(o) == len(v)]
        near = sorted((s for s in scored if s[2] == label), key=order)[:5]
        far = sorted((s for s in scored if s[2] != label), key=order)
        for p, pid, _ in near:
            fit = [s for s in far if 30 * p <= 100 * s[0] <= 90 * p][:10]
            for rank, (s, j, _) in enumerate(fit, 1):
                out[i, pid, rank, j, p, s] += 1
    return out


@pytest.mark.parametrize("n,dim,scale,across", [(700, 8, 1.0, 1), (400, 3, 0.02, 1), (300, 8, 3e6, 1), (60, 4, 1e18, 1), (900, 6, 1.0, 7)])
def test_hard_negatives(spark, monkeypatch, n, dim, scale, across):
    if across > 1:  # many groups of anchors and of rows
        monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
        monkeypatch.setattr(hard_negatives, "ROWS", 140)
        monkeypatch.setattr(hard_negatives, "CELLS", 300)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x * scale)) for x in v], label) for i, v, label in odd_rows(n, dim, n + 1)]
    rows += [(200, [1.0, 2.0], 1), (2001, [1.0, 1.0], 1), (2002, [0.5, 0.25], 2), (300, [], 3), (2003, [], 3), (2004, [], 4)]
    got = hard_negatives.mine(relabelled(table(spark, rows)), F.col("vec_id") % 100 == 0)
    want = brute_negatives(rows)
    assert Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert want


def test_hard_negatives_of_an_empty_table(spark):
    for rows in ([], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert hard_negatives.mine(relabelled(table(spark, rows)), F.col("vec_id") % 100 == 0).collect() == []
