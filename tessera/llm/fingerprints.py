"""Document fingerprints: a homomorphic multiset hash of the paragraphs.

Each paragraph (a run of text between line ends) hashes to a wide vector of 16-bit lanes; a document's
fingerprint is the lane-wise sum of its paragraphs' vectors modulo 2**16. The sum does not depend on the
order of paragraphs, and a paragraph is inserted or deleted by adding or subtracting its vector
(``insert``, ``delete``). The first ``EXACT`` lanes are the paragraph's SHAKE-128 output, so that unequal
multisets of paragraphs have unequal sums but for chance; the other lanes are sums of signed counts, one
for each pair of neighbouring words of the paragraph, and so still add up, while the cosine of two
documents' lanes estimates the share of word pairs that they have in common. (Counts add up modulo 2**16 too: a pair
that stands more than 32,767 times in a text counts as if it stood 65,536 times less.)

Defined results: null text counts as empty (no paragraph: the zero vector); likeness of two zero vectors
is 1, of one zero vector and another 0; rows with the same doc_id count as separate documents, ordered by
their text's hash; a null doc_id comes last. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

EXACT, SOFT = 16, 128
LANES = EXACT + SOFT
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words_hash(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes above space."""
    solid = block > 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power = np.cumprod(np.full(len(block) + 1, np.uint64(0x100000001B3)), dtype=np.uint64)
    inverse = np.cumprod(np.full(len(block) + 1, np.uint64(pow(0x100000001B3, -1, 1 << 64))), dtype=np.uint64)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    h = (run[end] - run[start]) * inverse[start]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return start, end, h


def paragraph_vectors(texts: list[bytes]) -> np.ndarray:
    """Fingerprint vectors of whole texts, one row each: sums of their paragraphs' vectors, uint16."""
    out = np.zeros((len(texts), LANES), dtype=np.uint16)
    for i, text in enumerate(texts):
        digests = [hashlib.shake_128(p).digest(2 * EXACT) for p in text.split(b"\n") if p]
        if digests:
            out[i, :EXACT] = np.frombuffer(b"".join(digests), dtype="<u2").reshape(-1, EXACT).sum(0, dtype=np.uint16)
    block = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    start, end, h = _words_hash(block)
    if len(start):
        # a word and the one before it; the first of a paragraph stands alone
        breaks = np.cumsum(block == 10)
        line = breaks[start]
        first = np.concatenate(([True], line[1:] != line[:-1]))
        pair = h.copy()
        pair[1:] += np.where(first[1:], np.uint64(0), h[:-1] * np.uint64(0xD6E8FEB86659FD93))
        pair ^= pair >> np.uint64(31)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
        lane = (pair >> np.uint64(40)).astype(np.int64) % SOFT
        sign = np.where(pair & np.uint64(1 << 20), 1, -1)
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, start, side="right")
        sums = np.bincount(doc * SOFT + lane, weights=sign, minlength=len(texts) * SOFT)
        out[:, EXACT:] = (sums.astype(np.int64).reshape(len(texts), SOFT) & 0xFFFF).astype(np.uint16)
    return out


def insert(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    return fingerprint + paragraph_vectors([paragraph])[0]


def delete(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    return fingerprint - paragraph_vectors([paragraph])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the counting lanes, from 0 to 1, and 1 for equal vectors; row by row."""
    x, y = (v[:, EXACT:].astype(np.int16).astype(np.float64) for v in (a, b))
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cos = np.where((nx > 0) & (ny > 0), (x * y).sum(1) / (nx * ny), 0.0)
    return np.where((a == b).all(1), 1.0, np.clip(cos, 0.0, 1.0))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edit takes from the next document in descending doc_id, so that neighbours have to meet: splitters
    are taken from the quantiles of doc_id (as many as shuffle partitions), each range of ids goes to one
    partition once, sorted, and only the first document of each range goes to the range before as well.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    splits = keyed.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] if n > 1 else [0.5], 10_000)).first()[0]
    splits = np.array(sorted(set(splits or [])), dtype=np.int64)
    low = -(1 << 63)  # stands for null: last in descending order

    @F.pandas_udf("array<int>")
    def own_range(ids: pd.Series) -> pd.Series:
        part = len(splits) - np.searchsorted(splits, ids.to_numpy(), side="left")
        return pd.Series([[int(p)] for p in part])

    key = F.coalesce("doc_id", F.lit(low))
    heads = keyed.select(key.alias("k"), own_range(key)[0].alias("p")).groupBy("p").agg(F.max("k").alias("k")).orderBy("p").collect()  # a row for each range
    before = {h.k: heads[i - 1].p for i, h in enumerate(heads)}  # the first range's head goes to the last

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        part = len(splits) - np.searchsorted(splits, ids.to_numpy(), side="left")
        return pd.Series([[int(p), before[k]] if k in before else [int(p)] for p, k in zip(part, ids, strict=True)])

    # array position 1 is the copy of a head that only serves as a next document
    dealt = keyed.select("doc_id", "text", F.posexplode(ranges(key)).alias("ghost", "p")).select("p", (F.col("ghost") > 0).alias("ghost"), "doc_id", "text")
    dealt = dealt.repartitionById(len(splits) + 1, F.col("p"))
    ordered = dealt.sortWithinPartitions("p", "ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # documents whose next has not been seen yet, at most one range's last
        todo: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            own, edited, nxt = [], [], []
            ids, lengths, digests = [], [], []
            for (doc_id, text), (_, other) in todo:
                whole, k = text.decode(), 0
                k = len(whole) // 2
                # k code points of the next text: its first 4k bytes hold them
                new = (whole[: len(whole) - k] + other[: 4 * k].decode(errors="ignore")[:k]).encode()
                ids.append(doc_id), lengths.append(len(whole)), digests.append(hashlib.sha256(new).hexdigest())
                own.append(text), edited.append(new), nxt.append(other)
            a, b, c = paragraph_vectors(own), paragraph_vectors(edited), paragraph_vectors([nxt[-1]])
            following = np.concatenate((a[1:], c))  # the next document is the next row
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests), pa.array([v.astype(">u2").tobytes().hex() for v in a]), pa.array([v.astype(">u2").tobytes().hex() for v in b]), pa.array(likeness(a, b)), pa.array(likeness(a, following))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        seen = 0
        for batch in batches:
            ghosts = batch.column(1).to_pylist()
            for g, doc_id, text in zip(ghosts, batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if g and seen and not held:
                    continue  # another row with the id of the head
                if held:
                    todo.append((held.pop(), (doc_id, text)))
                    size += len(text)
                    if size >= 2 << 20:
                        yield flush()
                        todo.clear()
                        size = 0
                if not g:
                    held.append((doc_id, text))
                    seen += 1
        if todo:
            yield flush()

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
