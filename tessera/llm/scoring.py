"""Language-model scores by context-tree weighting over bytes.

A text, lower-cased in A-Z, is a string of bytes with one end mark. Each byte is eight binary decisions, and each
decision has a Krichevsky-Trofimov estimate in every context of 0 to ``DEPTH`` bytes before it. Each of the 255
decision nodes has a context tree of its own: the weighted probability of a tree node is half the estimate's and half
the product of its children's, a leaf's is its estimate's. A text's probability mixes the estimates of all depths along
its contexts by the posterior weights that follow from these; a path ends at the deepest context that training has
seen. The code length is -log2 of that; ``score`` is log10.

All counts come from all training texts and all contexts that occur are kept: nothing is pruned, and what is gathered
grows with the corpus. (Below a context that occurs once all estimates equal its own, so that nothing need be stored
there.) Contexts are written last byte first, so that a subtree is a range of codes:

1. Every task gives the distinct grams (``DEPTH`` bytes and the one after) of its blocks of documents, with their
   counts in training texts, in rows for buckets: a bucket holds the subtrees of some contexts of ``TOP`` bytes.
2. A task for each bucket adds the counts up, and weighs its subtrees from the leaves up. The sums of the roots' log
   probabilities are what the TOP shortest depths need; these are of fixed size (256 ** 2 contexts of 255 decisions
   at most, whatever the corpus) and the only part of the tree that goes to the driver and to every task.
3. A task for each bucket walks down to each of its grams and sends the log probabilities to the blocks of documents
   that hold them, where they meet the texts. A very common gram is one number for each block.

The word score beside it is the smoothed unigram of the contract. Words of at most ``LONG`` bytes whose count is high
enough that at most ``HEAD`` words can have it go to every task; counts of all others are joined by word.

Defined results: null counts as empty text: one token, the end. A null doc_id is a training row (its crc32
is null). With no training text, N and V are 0 and every word has probability 1, every decision one half. Rows with
the same doc_id are scored row by row; other columns are ignored. The end mark is a byte that UTF-8 never has, so that
NUL is a byte like any other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, cut, numbered, partitions, slices, tidy, whole_groups

DEPTH, TOP, HEAD, LONG = 6, 3, 200_000, 64
#: Documents of a block; codes that a task sorts at once, bytes of text that it takes together.
BLOCK, FLUSH, SLICE = 16_384, 1_500_000, 1 << 20
#: Stands for the end token; no word holds a line end.
END = "\n"
#: Byte of the end mark, and of what stands before a text.
MARK = b"\xff"
U = np.uint64


def held_out() -> Column:
    """Remainder 0 of crc32(doc_id as text) modulo 10."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each byte (lowest) and end mark of texts with the ``depth`` bytes before it (the last one highest),
    and the number of each text's codes."""
    pad = MARK * depth
    block = np.frombuffer(pad + b"".join(t + pad for t in texts), dtype=np.uint8)
    code = block[depth:].astype(U)
    for i in range(1, depth + 1):
        code |= block[depth - i : len(block) - i].astype(U) << U(8 * (depth + 1 - i))
    size = np.array([len(t) + 1 for t in texts])
    if depth > 1:  # what starts after a text's end mark belongs to no text
        keep = np.ones(len(code), dtype=bool)
        ends = np.cumsum(size + depth - 1)
        for i in range(1, depth):
            keep[ends - i] = False
        code = code[keep]
    return code, size


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 as differences, byte by byte: they compress well."""
    return np.diff(values, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, dtype=np.uint8).reshape(8, -1).T.copy().view(U).ravel(), dtype=U)


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, dtype=np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of several such lists, and their summed counts."""
    if len(parts) == 1:
        return parts[0]
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = _starts(codes)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


def stacked(done: list[tuple[np.ndarray, np.ndarray]], new: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds a list of codes and counts to others, which it is merged with while they are less than twice as long: a
    code is merged a logarithmic number of times, and the longest list is copied last."""
    done.append(new)
    while len(done) > 1 and len(done[-2][0]) < 2 * len(done[-1][0]):
        done[-2:] = [merged(done[-2:])]


def looked_up(codes: np.ndarray, table: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each code in a sorted table that holds them all. The codes are sorted too, so that the table is
    walked through in one direction."""
    order = np.argsort(codes)
    ranked = codes[order]
    at = _starts(ranked)
    unique = ranked[at]
    k = np.searchsorted(table, unique)
    if len(unique) and (k[-1] >= len(table) or (table[k] != unique).any()):
        raise RuntimeError("the texts are not those that were counted")
    out = np.empty(len(codes), dtype=value.dtype)
    out[order] = np.repeat(value[k], np.diff(np.concatenate((at, [len(ranked)]))))
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the estimate's probability of that many zeros and ones."""

    def lgamma(x: np.ndarray) -> np.ndarray:  # Stirling's series after a shift by 8
        shift = np.ones_like(x)
        for i in range(8):
            shift *= x + i
        y = x + 8
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(shift)

    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - math.log(math.pi)


#: Tree nodes of one depth and one of the eight decisions: codes (context, decisions so far), zeros, ones.
Nodes = dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def tree_nodes(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> Nodes:
    """The nodes of depths ``top`` to ``depth`` of sorted grams with positive counts."""
    out: Nodes = {}
    for d in range(top, depth + 1):
        own, n = codes, counts
        if d > top:  # a context that occurs once is a leaf
            at = _starts(codes >> U(8 * (depth + 2 - d)))
            keep = np.repeat(np.add.reduceat(counts, at) >= 2, np.diff(np.concatenate((at, [len(codes)])))) if len(at) else np.zeros(0, bool)
            own, n = codes[keep], counts[keep]
        code = ((own >> U(8 * (depth + 1 - d))) << U(8)) | (own & U(255))
        if d < depth:
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
        at = _starts(code)
        code, n = code[at], np.add.reduceat(n, at).astype(float) if len(at) else np.zeros(0)
        for level in range(7, -1, -1):
            bit, code = (code & U(1)).astype(bool), code >> U(1)
            at = _starts(code)
            ones, total = (np.add.reduceat(x, at) if len(at) else np.zeros(0) for x in (np.where(bit, n, 0.0), n))
            code, n = code[at], total
            out[d, level] = (code, total - ones, ones)
    return out


def _up(codes: np.ndarray, level: int) -> np.ndarray:
    """Codes of the parents: contexts without their earliest byte."""
    return ((codes >> U(level + 8)) << U(level)) | (codes & U((1 << level) - 1))


def weigh(nodes: Nodes, depth: int, top: int, level: int, below: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """From the leaves up: log weighted probabilities of the nodes of depth ``top``, and the share of each node's own
    estimate, by depth. ``below``: sums of the logs of children, and which nodes have any, for depth ``depth``."""
    share: dict[int, np.ndarray] = {}
    own = np.zeros(0)
    for d in range(depth, top - 1, -1):
        codes, zeros, ones = nodes[d, level]
        own = _log_kt(zeros, ones)
        share[d] = np.ones(len(codes))
        if below is not None:
            sums, has = below
            both = np.logaddexp(own, sums) - math.log(2)
            share[d] = np.where(has, np.exp(own - math.log(2) - both), 1.0)
            own = np.where(has, both, own)
        if d > top:
            parent = np.searchsorted(nodes[d - 1, level][0], _up(codes, level))
            n = len(nodes[d - 1, level][0])
            below = np.bincount(parent, weights=own, minlength=n), np.bincount(parent, minlength=n) > 0
    return own, share


class Trunk:
    """The depths below TOP: for each decision and depth the codes, what is mixed in so far, what is left to mix, and
    the estimates."""

    def __init__(self, nodes: Nodes, sums: dict[int, np.ndarray], top: int):
        """``nodes`` of depths 0 to top - 1; sums[level]: of the logs of the children of the deepest ones."""
        self.top, self.at = top, {}
        for level in range(8):
            last = nodes[top - 1, level][0]
            _, share = weigh(nodes, top - 1, 0, level, (sums[level], np.ones(len(last), bool)))
            left, mixed = np.ones(1), np.zeros(1)
            for d in range(top):
                codes, zeros, ones = nodes[d, level]
                estimate = (ones + 0.5) / (zeros + ones + 1)
                if d:
                    parent = np.searchsorted(nodes[d - 1, level][0], _up(codes, level))
                    left, mixed = left[parent], mixed[parent]
                else:
                    left, mixed = np.ones(len(codes)), np.zeros(len(codes))
                mixed, left = mixed + left * share[d] * estimate, left * (1 - share[d])
                self.at[d, level] = (codes, mixed, left, estimate)


def log_probabilities(queries: np.ndarray, nodes: Nodes, trunk: Trunk, depth: int) -> np.ndarray:
    """log10 of the probability of each code's byte after its context."""
    total = np.zeros(len(queries))
    byte = queries & U(255)
    for level in range(8):
        _, share = weigh(nodes, depth, trunk.top, level)
        before, bit = byte >> U(8 - level), (byte >> U(7 - level)) & U(1)
        mixed, left, last = np.zeros(len(queries)), np.ones(len(queries)), np.full(len(queries), 0.5)
        alive = np.arange(len(queries))
        for d in range(depth + 1):
            codes = nodes[d, level][0] if d >= trunk.top else trunk.at[d, level][0]
            if not len(codes) or not len(alive):
                break
            own = ((queries[alive] >> U(8 * (depth + 1 - d))) << U(level) if d else np.zeros(len(alive), U)) | before[alive]
            k = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hit = codes[k] == own
            alive, k = alive[hit], k[hit]
            if d < trunk.top:
                _, m, r, e = trunk.at[d, level]
                mixed[alive], left[alive], last[alive] = m[k], r[k], e[k]
            else:
                _, zeros, ones = nodes[d, level]
                last[alive] = (ones[k] + 0.5) / (zeros[k] + ones[k] + 1)
                mixed[alive] += left[alive] * share[d][k] * last[alive]
                left[alive] *= 1 - share[d][k]
        one = mixed + left * last
        total += np.log10(np.where(bit == 1, one, 1 - one))
    return total


def count_corpus(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Counts over documents (file, block, held, text): rows (word, n) of training texts, and rows (bucket, file,
    block, grams, counts) of all texts, the counts being those in training texts."""
    names = ["word", "n", "bucket", "file", "block", "grams", "counts"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def rows(**own: list) -> pa.RecordBatch:
        size = len(next(iter(own.values())))
        return pa.RecordBatch.from_arrays([pa.array(own.get(k, [None] * size), t) for k, t in zip(names, types)], names=names)

    def reduced(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every = np.sort(np.concatenate(codes))  # the lowest bit tells training texts
        code = every >> U(1)
        at = _starts(code)
        return code[at], np.add.reduceat((every & U(1)).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        here, codes, size, done = None, [], 0, []

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal codes, size, done
            if codes:
                stacked(done, reduced(codes))
            if done:
                code, n = merged(done)
                own = bucket_of(code, depth, buckets)
                order = np.argsort(own, kind="stable")
                code, n, own = code[order], n[order], own[order]
                cuts = [*_starts(own).tolist(), len(own)]
                for k in range(0, len(cuts) - 1, 256):
                    some = list(zip(cuts[k : k + 256], cuts[k + 1 : k + 257]))
                    yield rows(bucket=[int(own[a]) for a, _ in some], file=[here[0]] * len(some), block=[here[1]] * len(some), grams=[pack(code[a:b]) for a, b in some], counts=[n[a:b].tobytes() for a, b in some])
            codes, size, done = [], 0, []

        def tally() -> Iterator[pa.RecordBatch]:
            if words:
                yield rows(word=pa.array(list(words), pa.binary()).cast(pa.string()), n=list(words.values()))
                words.clear()

        for part, texts in slices(batches, "text", SLICE):
            low = [t.lower() for t in texts]
            file, block, held = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for t, h in zip(low, held):
                if not h:
                    words.update(t.split())
            words[END.encode()] += int((~held).sum())
            if len(words) > 300_000:
                yield from tally()
            cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(low)]
            for a, b in zip(cuts, cuts[1:]):
                if (file[a], block[a]) != here:
                    yield from blocks()
                    here = (file[a], block[a])
                code, n = grams(low[a:b], depth)
                codes.append((code << U(1)) | np.repeat(~held[a:b], n).astype(U))
                size += len(code)
                if size >= FLUSH:
                    stacked(done, reduced(codes))
                    codes, size = [], 0
        yield from blocks()
        yield from tally()

    return docs.select("file", "block", "held", "text").mapInArrow(tidy(run), "word string, n long, bucket int, file long, block long, grams binary, counts binary")


def bucket_of(codes: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """The bucket of each gram: that of the last TOP bytes of its context."""
    h = (codes >> U(8 * (depth + 1 - TOP))) * U(0x9E3779B97F4A7C15)
    return ((h >> U(40)) % U(buckets)).astype(np.int64)


def _gathered(counted: DataFrame, tasks: int) -> DataFrame:
    """A row for each bucket: its distinct grams, their counts, and for each block of documents which it holds."""
    schema = "bucket int, grams binary, counts binary, blocks array<struct<file:long,block:long,held:binary>>"
    held = pa.list_(pa.struct([("file", pa.int64()), ("block", pa.int64()), ("held", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["bucket"], 64):
            cuts = [*_starts(group).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                own = table.slice(a, b - a)
                parts: dict[tuple, list] = {}
                for f, k, g, n in zip(*(own.column(c).to_pylist() for c in ("file", "block", "grams", "counts"))):
                    parts.setdefault((f, k), []).append((unpack(g), np.frombuffer(n, dtype=np.int64)))
                parts = {k: merged(v) for k, v in parts.items()}
                code, n = merged(list(parts.values()))
                blocks = [{"file": f, "block": k, "held": pack(np.searchsorted(code, c).astype(U))} for (f, k), (c, _) in parts.items()]
                yield pa.RecordBatch.from_arrays([pa.array([int(own.column("bucket")[0].as_py())], pa.int32()), pa.array([pack(code)]), pa.array([n.tobytes()]), pa.array([blocks], held)], names=["bucket", "grams", "counts", "blocks"])

    own = counted.where("bucket IS NOT NULL").select("bucket", "file", "block", "grams", "counts")
    return own.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), schema)


def _subtrees(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, Nodes, list | None]]:
    """Of rows (grams, counts, blocks): the grams, the nodes of those that training has, and the blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            code, n = unpack(batch.column(0)[i].as_py()), np.frombuffer(batch.column(1)[i].as_py(), dtype=np.int64)
            yield code, tree_nodes(code[n > 0], n[n > 0], depth, TOP), batch.column(2)[i].as_py() if batch.num_columns > 2 else None


def build_trunk(gathered: DataFrame, depth: int) -> Trunk:
    """The short contexts' part of the tree; what comes to the driver is bounded by the alphabet: 256 ** (TOP - 1)
    contexts of 255 decisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, _ in _subtrees(batches, depth):
            for level in range(8):
                codes, zeros, ones = nodes[TOP, level]
                own, _ = weigh(nodes, depth, TOP, level)
                up = _up(codes, level)
                order = np.argsort(up, kind="stable")
                at = _starts(up[order])
                if len(at):
                    sums = [np.add.reduceat(x[order], at) for x in (own, zeros, ones)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(up[order][at].view(np.int64)), *map(pa.array, sums)], names=["level", "code", "own", "zeros", "ones"])

    found = gathered.select("grams", "counts").mapInArrow(tidy(run), "level int, code long, own double, zeros double, ones double")
    rows = found.groupBy("level", "code").agg(*[F.sum(c).alias(c) for c in ("own", "zeros", "ones")]).orderBy("level", "code").toPandas()
    nodes: Nodes = {}
    sums: dict[int, np.ndarray] = {}
    for level in range(8):
        own = rows[rows.level == level]
        code, zeros, ones = own.code.to_numpy().astype(U), own.zeros.to_numpy(float), own.ones.to_numpy(float)
        sums[level] = own.own.to_numpy(float)
        for d in range(TOP - 1, -1, -1):
            nodes[d, level] = (code, zeros, ones)
            up = _up(code, level)
            order = np.argsort(up, kind="stable")
            at = _starts(up[order])
            code, zeros, ones = (up[order][at], *(np.add.reduceat(x[order], at) if len(at) else x for x in (zeros, ones)))
    return Trunk(nodes, sums, TOP)


def gram_scores(gathered: DataFrame, trunk: Trunk, depth: int) -> DataFrame:
    """Rows (file, block, grams, scores): the log probabilities of the grams of each block of documents, a row for
    each bucket that it has grams of."""
    held = gathered.sparkSession.sparkContext.broadcast(trunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, nodes, blocks in _subtrees(batches, depth):
            value = log_probabilities(code, nodes, held.value, depth).astype(np.float32)
            for k in range(0, len(blocks), 64):
                some = [(b["file"], b["block"], unpack(b["held"]).astype(np.int64)) for b in blocks[k : k + 64]]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, *_ in some], pa.int64()), pa.array([b for _, b, _ in some], pa.int64()), pa.array([pack(code[i]) for *_, i in some], pa.binary()), pa.array([value[i].tobytes() for *_, i in some], pa.binary())], names=["file", "block", "grams", "scores"])

    return gathered.select("grams", "counts", "blocks").mapInArrow(tidy(run), "file long, block long, grams binary, scores binary")


def score(docs: DataFrame, depth: int = DEPTH, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)."""
    spark = docs.sparkSession
    n_docs = docs.count()
    buckets = 1 << max(6, (n_docs >> 10).bit_length())
    tasks = max(partitions(spark), buckets >> 5)
    place = [F.col(f"{KEY}.file").alias("file"), F.floor(F.col(f"{KEY}.row") / block).alias("block"), F.col(f"{KEY}.row").alias("row")]
    own = numbered(docs.select("doc_id", "text")).select(*place, held_out().alias("held"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = cut(count_corpus(own, depth, buckets), "counts")
    vocabulary = cut(counted.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    n_all, n_words = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    base = n_all + 0.1 * (n_words + 1)
    # the smallest count that at most ``head`` words reach: counts at or above n_all / head always qualify
    short = F.octet_length("word") <= LONG
    least = max(1, math.ceil(n_all / head))
    tally = vocabulary.where(short & (F.col("c") < least)).groupBy("c").count().orderBy(F.desc("c")).limit(5000).collect()
    taken = vocabulary.where(short & (F.col("c") >= least)).count()
    for r in tally:
        if taken + r["count"] > head:
            break
        taken, least = taken + r["count"], r.c
    common = short & (F.col("c") >= least)
    frequent = dict(vocabulary.where(common).collect())  # at most ``head`` words of ``LONG`` bytes
    ends = (vocabulary.where(F.col("word") == END).first() or (END, 0))[1]
    held = spark.sparkContext.broadcast(({w.encode(): math.log10((c + 0.1) / base) for w, c in frequent.items()}, (ends, math.log10((ends + 0.1) / base))))
    gathered = cut(_gathered(counted, tasks), "grams")
    sent = gram_scores(gathered, build_trunk(gathered, depth), depth)

    def scored(part: pa.RecordBatch, texts: list[bytes], table: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        known, (ends, end) = held.value
        get = known.get
        low = [t.lower() for t in texts]
        code, size = grams(low, depth)
        total = np.add.reduceat(looked_up(code, table, value).astype(float), np.cumsum(size) - size)
        n, sure, base_score, words, times, row = [], [], [], [], [], []
        for i, t in enumerate(low):
            found = t.split()
            logs = list(map(get, found))
            n.append(len(found) + 1)
            if None in logs:
                rare = Counter([w for w, x in zip(found, logs) if x is None])
                words += rare
                times += rare.values()
                row += [i] * len(rare)
                logs = [x for x in logs if x is not None]
            sure.append(len(logs) + (ends > 0))
            base_score.append(math.fsum(logs) + end)
        k, m = len(low), len(words)
        at = pa.array([*range(k), *row], pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(part.column(c).take(at) for c in (0, 2, 3)), pa.array([f"\n{i}" for i in part.column(2).to_pylist()] + [w.decode() for w in words], pa.string()), pa.array([1] * k + times, pa.int64()), pa.array([True] * k + [False] * m), pa.array(n + [0] * m, pa.int64()), pa.array(sure + [0] * m, pa.int64()), pa.array(base_score + [0.0] * m), pa.array(np.concatenate((total, np.zeros(m)))), pa.array(np.concatenate((size, np.zeros(m, np.int64))))],
            names=["file", "row", "doc_id", "word", "times", "own", "n_tokens", "sure", "total", "score", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pieces, table, value = None, [], None, None
        for part, texts in slices(batches, "text", SLICE):
            file, block = part.column(0).to_numpy(), part.column(1).to_numpy()
            sent = part.column(5).is_valid().to_numpy(zero_copy_only=False)
            new = (file[1:] != file[:-1]) | (block[1:] != block[:-1]) | (sent[1:] != sent[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(file)]
            for a, b in zip(cuts, cuts[1:]):
                if (file[a], block[a]) != here:
                    here, pieces, table = (file[a], block[a]), [], None
                if sent[a]:
                    pieces += [(unpack(part.column(5)[i].as_py()), np.frombuffer(part.column(6)[i].as_py(), dtype=np.float32)) for i in range(a, b)]
                    continue
                if table is None:
                    table, value = (np.concatenate(x) for x in zip(*pieces))
                    order = np.argsort(table, kind="stable")
                    table, value, pieces = table[order], value[order], []
                yield scored(part.slice(a, b - a), texts[a:b], table, value)

    met = own.select("file", "block", "row", "doc_id", "text").unionByName(sent.withColumnRenamed("grams", "g").withColumnRenamed("scores", "v"), allowMissingColumns=True)
    met = met.repartition(max(partitions(spark), n_docs // block + 1), "file", "block").sortWithinPartitions("file", "block", F.col("g").isNull())
    rows = met.mapInArrow(tidy(run), "file long, row long, doc_id long, word string, times long, own boolean, n_tokens long, sure long, total double, score double, size long")
    rare = vocabulary.where(~common).withColumnRenamed("c", "rare")
    joined = rows.join(rare, "word", "left")
    c = F.coalesce("rare", F.lit(0))
    log = F.when(F.col("own"), 0.0).otherwise(F.col("times") * F.log10((c + 0.1) / F.lit(float(base))))
    each = joined.groupBy("file", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), (F.sum("sure") + F.sum(F.when(~F.col("own") & (c > 0), F.col("times")).otherwise(0))).alias("n_known"), (F.sum("total") + F.sum(log)).alias("base_score"), F.sum("score").alias("score"), F.sum("size").alias("size"))
    return each.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / math.log10(2) / F.col("size")).alias("bits_per_byte"))
