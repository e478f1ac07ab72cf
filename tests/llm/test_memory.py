"""What the Python workers hold: of one task, and between tasks."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from tessera.llm import bpe, common, language, scoring


class Captured:
    """Stands for a table: keeps the function that would run in its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_counting_common_grams_holds_little_more_than_a_slice():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 2000, dtype=np.uint8)).decode() for _ in range(40)] * 150  # 12 MB, 80,000 grams
    run = scoring.count_corpus(Captured(), 6, 64)
    batch = pa.RecordBatch.from_pydict({"file": [0] * 6000, "block": [0] * 6000, "held": [False] * 6000, "text": texts})
    tracemalloc.start()
    n = sum(int(np.frombuffer(c, dtype=np.int64).sum()) for b in run(iter([batch])) for c in b.column(6).to_pylist() if c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 * 2001
    assert peak < 150e6


def test_merging_and_looking_up_agree_with_the_plain_way():
    rng = np.random.default_rng(6)
    lists = [np.unique(rng.integers(0, 5000, s).astype(np.uint64), return_counts=True) for s in (900, 10, 400, 3000, 0, 50)]
    done: list = []
    for x in lists:
        scoring.stacked(done, x)
    codes, counts = scoring.merged(done)
    every = np.concatenate([np.repeat(c, n) for c, n in lists])
    want = np.unique(every, return_counts=True)
    assert (codes == want[0]).all() and (counts == want[1]).all()
    value = rng.random(len(codes)).astype(np.float32)
    table = dict(zip(codes.tolist(), value.tolist()))
    assert scoring.looked_up(every, codes, value).tolist() == [table[c] for c in every.tolist()]
    assert scoring.looked_up(every[:0], codes, value).tolist() == []
    for stranger in (codes.max() + np.uint64(1), np.setdiff1d(np.arange(5000, dtype=np.uint64), codes)[0]):
        try:
            scoring.looked_up(np.append(every, stranger), codes, value)
        except RuntimeError:
            continue
        raise AssertionError("a code that was not counted has a value")


def test_a_worker_keeps_the_table_of_one_operator():
    bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    first = language.pieces(public_tokenizers.path(language.VOCABULARY))
    assert list(common._tables.values()) == [first]
    assert list(common.tidy(lambda batches: batches, keep=True)(iter([1, 2]))) == [1, 2]
    assert language.pieces(public_tokenizers.path(language.VOCABULARY)) is first
    assert list(common.tidy(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not common._tables
