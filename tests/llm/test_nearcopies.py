"""Near copies against all pairs."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import common, simhash
from tessera.llm.common import components


def brute(texts, level=0.8):
    """The groups of indexes of texts that all pairs of similarity ``level`` connect."""
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= level * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def varied():
    rng = random.Random(9)
    def fresh(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    line, out = fresh(60), []
    for n in (30, 80, 200, 500):
        for _ in range(6):
            base = fresh(n)
            out.append(base)
            for k in range(1, 1 + n // 20):  # so many words replaced: from above 0.8 to below
                copy = list(base)
                for at in rng.sample(range(n), k):
                    copy[at] = f"x{rng.randrange(5000)}"
                out.append(copy)
    out += [line + fresh(20) for _ in range(30)] + [fresh(20) + line for _ in range(10)] + [fresh(3), fresh(3)]
    chain = fresh(100)
    for i in range(40):  # each near the next one, the ends far apart
        chain = chain[2:] + fresh(2)
        out.append(list(chain))
    return [" ".join(t) for t in out] + ["", None, " ".join(chain)]


@pytest.mark.parametrize("tile", [2048, 3])
def test_groups_equal_all_pairs(spark, tile):
    texts = varied()
    want = brute(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    rows = d.select(F.struct(F.lit(0).cast("long").alias("file"), F.col("k").alias("row")).alias("uid"), F.struct("k").alias("rank"), "text")
    got = {r.uid.row: r.first.row for r in simhash.similar_groups(rows, tile=tile).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:50], "other", *base[51:100], "words", *base[101:150], "here", *base[151:]])), (2, " ".join(rng.sample(base, 200)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, d, "").collect()) == [0, 2]


@pytest.mark.parametrize("tau", [1, 3])
def test_simhash_crowded_groups_for_any_tau(spark, tau):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = np.unique(np.concatenate([base, base ^ np.uint64(1), base[:6] ^ np.uint64(7 << 20)]))
    nodes = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    root = list(range(len(near)))
    for i in range(len(near)):
        for j in range(i):
            if int(near[i] ^ near[j]).bit_count() <= tau:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    want = sorted(sorted(int(near.view(np.int64)[i]) for i in range(len(near)) if root[i] == r) for r in set(root) if root.count(r) > 1)
    out = {}
    for r in components(simhash.links(nodes, tau, 1)).collect():
        out.setdefault(r.component, []).append(r.node)
    assert sorted(map(sorted, out.values())) == want


def test_stage_keeps_rows_whatever_their_doc_id(spark):
    import corpus_pipeline

    texts = varied()[:60]
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, i, i]), t) for i, t in enumerate(texts)]
    rows += [(None, "this stands alone and has no number"), (None, "so does this other one here"), (7, "same number as others but another text"), rows[0]]
    root = brute([t for _, t in rows])
    best = {}
    for (i, t), r in zip(rows, root):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.one_of_each(spark, d, "").collect()
    assert len(got) == len(best)
    index = {row: r for row, r in zip(rows, root)}
    kept = {index[(r.doc_id, r.text)]: (r.doc_id is None, r.doc_id or 0) for r in got}
    assert kept == best


def test_pigeonhole_brings_near_prints_together(spark, monkeypatch):
    rng = random.Random(11)

    def print_of(words):
        return simhash.majority([np.unique(simhash.shingle_hashes(" ".join(words).encode(), 5))])[0]

    texts = []
    for _ in range(6):  # a text and its copies with one other word whose prints differ in one or two bits, or in none
        base = [f"w{rng.randrange(5000)}" for _ in range(800)]
        mine, copies = print_of(base), []
        while len(copies) < 2:
            copy = list(base)
            copy[rng.randrange(800)] = f"x{rng.randrange(5000)}"
            if int(np.bitwise_count(print_of(copy) ^ mine)) <= 2:
                copies.append(copy)
        texts += [" ".join(t) for t in (base, *copies)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(10)]
    want = brute(texts)
    whole = simhash._hubs
    monkeypatch.setattr(simhash, "_hubs", lambda filed, level: whole(filed, level).where("false"))  # no band at all
    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    rows = d.select(F.col("k").alias("uid"), F.struct("k").alias("rank"), "text")
    got = {r.uid: r.first for r in simhash.similar_groups(rows).collect()}
    assert len(set(want)) == 16 and [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("held", [1 << 20, 4000])
def test_texts_under_the_level_do_not_cost_their_pairs(spark, monkeypatch, held):
    rng = random.Random(13)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    texts = [" ".join([*base[:89], *(f"x{i}y{k}" for k in range(11))]) for i in range(240)]  # each two: 85 of 107 shingles
    texts += [" ".join([*base[:91], *(f"z{i}y{k}" for k in range(9))]) for i in range(3)]  # these three: 87 of 105
    rows, cut = [], simhash.cut

    def counted(df, name="cut"):
        out = cut(df, name)
        rows.append((out.count(), name))
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(common, "cut", counted)
    monkeypatch.setattr(simhash, "HELD", held, raising=False)
    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    got = {r.uid: r.first for r in simhash.similar_groups(d.select(F.col("k").alias("uid"), F.struct("k").alias("rank"), "text")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts) == [*range(240), 240, 240, 240]
    assert max(rows)[0] <= simhash.BANDS * len(texts)  # all pairs are 29,403
