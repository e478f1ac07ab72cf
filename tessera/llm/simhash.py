"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are cut into m groups so that correlated bits share a group, and group i gets a
threshold T_i with sum T_i = tau - m + 1: two fingerprints at distance tau or less are then at distance
T_i or less in at least one group i (a threshold of -1 leaves a group out). The thresholds, and m, come
from a dynamic programme over estimated candidate counts, which rest on how often each bit is set over all
fingerprints. Each fingerprint is filed under its own value of each group and probes all values within
T_i; what meets is verified on the whole fingerprint.

Only distinct fingerprints take part; copies are joined afterwards. Within a group of rows that meet,
a task compares blocks and gives a spanning forest, never all pairs. Groups above ``cap`` rows are not
brought together: each of their fingerprints is filed under all its values with tau bits blanked (all pairs
within tau then share a blanked value, at most 2 ** tau distinct fingerprints each; exact for any tau, at a cost
of 64 over tau rows a fingerprint).

Defined results: null or empty text has fingerprint 0, linked like any other; fewer than three words make
one shingle of the whole sequence; rows repeat as they are; component_id ignores null doc_ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, components, cut, numbered, partitions, slices, tidy, whole_groups

SHINGLE, SEED, CAP = 3, 42, 4096
#: For groups by similarity: words in a shingle, Jaccard similarity, bits that may differ, rows and bands of minima.
WIDTH, LEVEL, FAR, ROWS, BANDS = 5, 0.8, 22, 6, 40
#: Bits within which the pigeonhole brings all fingerprints together.
TAU = 2
#: Sets smaller than this are verified whatever their fingerprints; rows and shingles of a tile's block.
FEW, TILE, HELD = 32, 2048, 1 << 20
#: How far the estimate from the minima's last bytes may lie below the level: five standard deviations at 0.8.
SLACK = 0.13


def majority(parts: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (uint64) of lists of hashes: a bit is 1 where over half of them have it."""
    sizes = np.array([len(h) for h in parts], dtype=np.int64)
    out = np.zeros(len(parts), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of a lower-cased text; fewer words make one, none make none."""
    words = text.lower().split()
    if len(words) < width:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64)


def simhash(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of UTF-8 texts (uint64): a bit is 1 where over half of the shingles' XXH64 have it."""
    return majority([shingle_hashes(t, shingle) for t in texts])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) of every document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(simhash(texts, shingle).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j].astype(np.int64))], names=["cell", "n"])

    together = np.zeros(64 * 64)
    for r in nodes.select("fp").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        together[r.cell] = r.n
    return nodes.count(), together.reshape(64, 64)


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, equal in size but for one, each grown from a seed by the strongest correlation."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    cor = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, groups = list(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, groups))) // (m - g)
        own = [max(left, key=lambda b: (cor[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (cor[b, own].sum(), -b)))
            left.remove(own[-1])
        groups.append(sorted(own))
    return groups


def allocate(n: int, together: np.ndarray, groups: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Thresholds with sum tau - m + 1 that minimise probes plus estimated candidates, and that cost."""
    p = np.diag(together) / max(n, 1)
    cost = []
    for own in groups:
        dist = np.zeros(len(own) + 1)
        dist[0] = 1
        for b in own:  # how many bits of the group differ between two fingerprints
            q = 2 * p[b] * (1 - p[b])
            dist = dist * (1 - q) + np.concatenate(([0], dist[:-1])) * q
        ball = np.cumsum([float(np.prod([(len(own) - i) / (i + 1) for i in range(e)])) for e in range(tau + 1)])
        cost.append([0.0] + [n * ball[e] + n * n / 2 * dist[: e + 1].sum() for e in range(tau + 1)])
    m, need = len(groups), tau - len(groups) + 1
    best = {0: (0.0, [])}
    for i in range(m):
        best = {s: min(((best[s - t][0] + cost[i][t + 1], [*best[s - t][1], t]) for t in range(-1, tau + 1) if s - t in best), default=None) for s in range(-m, tau * m + 1)}
        best = {s: v for s, v in best.items() if v}
    return best[need]


def plan(n: int, together: np.ndarray, tau: int = 2) -> list[tuple[list[int], int]]:
    """The groups of bits and their thresholds, for the m from 1 to tau + 1 with the least cost."""
    found = []
    for m in range(1, tau + 2):
        groups = group_bits(n, together, m)
        cost, thresholds = allocate(n, together, groups, tau)
        found.append((cost, m, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _forest(keys: np.ndarray, fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among sorted rows: pairs with equal keys within tau bits."""
    lo, hi = [], []
    size = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)])))
    left = np.repeat(size, size) - np.concatenate([np.arange(s) for s in size]) - 1 if len(keys) else np.array([], int)
    at, step = np.flatnonzero(left >= 1), 1
    root = np.arange(len(keys))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while len(at):
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= tau
        for i in at[near]:
            a, b = find(i), find(i + step)
            if a != b:
                root[max(a, b)] = min(a, b)
                lo.append(fp[i]), hi.append(fp[i + step])
        step += 1
        at = at[left[at] >= step]
    return np.array(lo, dtype=np.uint64), np.array(hi, dtype=np.uint64)


def links(nodes: DataFrame, tau: int = 2, cap: int = CAP) -> DataFrame:
    """Edges (u, v) among distinct fingerprints ``nodes`` (fp) that connect all pairs within tau bits."""
    spark = nodes.sparkSession
    chosen = plan(*bit_statistics(nodes), tau)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for g, (bits, t) in enumerate(chosen):
                mask = np.uint64(sum(1 << b for b in bits))
                flips = [np.uint64(sum(1 << b for b in c)) for e in range(t + 1) for c in combinations(bits, e)]
                for flip in flips:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array(((fp & mask) ^ flip).view(np.int64)), batch.column(0)], names=["g", "value", "fp"])

    filed = nodes.select("fp").mapInArrow(file, "g int, value long, fp long")
    sizes = filed.groupBy("g", "value").count()
    crowded = cut(sizes.where(F.col("count") > cap).select("g", "value"), "crowded")
    some = bool(crowded.head(1))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in whole_groups(batches, ["g", "value"]):  # groups of at most cap rows
            u, v = _forest(key, table.column("fp").to_numpy().view(np.uint64), tau)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    calm = filed.join(crowded, ["g", "value"], "left_anti") if some else filed
    found = calm.repartition(partitions(spark), "g", "value").sortWithinPartitions("g", "value").mapInArrow(verify, "u long, v long")
    if not some:
        return found

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for g, bits in enumerate(combinations(range(64), tau)):
                mask = np.uint64(sum(1 << b for b in bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array((fp & ~mask).view(np.int64)), batch.column(0)], names=["g", "value", "fp"])

    hot = filed.join(crowded, ["g", "value"], "left_semi").select("fp").distinct().mapInArrow(blank, "g int, value long, fp long")
    stars = hot.groupBy("g", "value").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return found.union(stars.select("u", F.explode("all").alias("v")).where("u <> v"))


def near_duplicates(docs: DataFrame, tau: int = 2, shingle: int = SHINGLE, cap: int = CAP) -> DataFrame:
    """Rows (doc_id, fp, component_id): documents whose fingerprints link within tau bits share the
    smallest doc_id that is reachable."""
    prints = cut(fingerprints(docs, shingle), "simhash")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comp = components(links(nodes, tau, cap))
    named = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """ROWS * BANDS minima of each set, none of which is empty."""
    rng = np.random.default_rng(SEED)
    flip = rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)
    odd = rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), ROWS * BANDS), dtype=np.uint64)
    for i in range(ROWS * BANDS):
        out[:, i] = np.minimum.reduceat((every ^ flip[i]) * odd[i], starts)
    return out


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (uid, rank, node, fp, n, bands, sig) for rows (uid, rank, text): a digest of the set of shingles, its
    fingerprint, its size, a value of each band of minima and each minimum's last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 20):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list[list[int]] = [[] for _ in sets]
            sig = [bytes(ROWS * BANDS)] * len(sets)
            if full:
                low = minima([sets[i] for i in full])
                for i, row in zip(full, low):
                    b = row.reshape(BANDS, ROWS)
                    sig[i] = (row & np.uint64(255)).astype(np.uint8).tobytes()
                    bands[i] = [xxhash.xxh64_intdigest(b[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]
            node = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(majority(sets).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["uid", "rank", "node", "fp", "n", "bands", "sig"])

    own = docs.select("uid", "rank", "text")
    made = {"node": T.LongType(), "fp": T.LongType(), "n": T.IntegerType(), "bands": T.ArrayType(T.LongType()), "sig": T.BinaryType()}
    schema = T.StructType([*own.schema.fields[:2], *[T.StructField(k, t) for k, t in made.items()]])
    return own.mapInArrow(tidy(run), schema)


def _alike(fp: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, level: float) -> np.ndarray:
    """Which pairs of rows may reach ``level``, by their sets' sizes and fingerprints."""
    few, many = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (few >= level * many) & ((few < FEW) | (np.bitwise_count(fp[i] ^ fp[j]) <= FAR))


def _hubs(filed: DataFrame, level: float) -> DataFrame:
    """Rows (key, node, fp, n) of keys that several nodes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple | None = None  # the last key's first row, and whether it has gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, fp, n = (batch.column(i).to_numpy() for i in range(4))
            gone = np.zeros(len(key) + (hub is not None), dtype=bool)
            if hub is not None:
                key, node, fp, n = (np.concatenate(([x], y)) for x, y in zip(hub, (key, node, fp, n)))
                gone[0] = hub[4]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((start, [len(key)])))
            out = np.flatnonzero((np.repeat(size, size) > 1) & ~gone)
            if len(out):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in (key, node, fp)), pa.array(n[out].astype(np.int32))], names=["key", "node", "fp", "n"])
            k = start[-1]
            hub = (key[k], node[k], fp[k], n[k], bool(size[-1] > 1 or gone[k]))

    return filed.mapInArrow(tidy(run), "key long, node long, fp long, n int")


def _blocks(rows: DataFrame, tile: str, number: Column) -> DataFrame:
    """Adds ``blocks``: the ``number``, rounded up, of blocks into which the rows of a ``tile`` go."""
    several = cut(rows.groupBy(tile).agg(F.ceil(number).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    return rows.join(several, tile, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _dealt(rows: DataFrame, tile: str) -> DataFrame:
    """Rows (..., block, i, j) for rows with ``blocks``: each in a block of its ``tile``'s, laid out beside every block."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "blocks")
    return rows.repartition(partitions(rows.sparkSession), tile, "i", "j").sortWithinPartitions(tile, "i", "j")


def _spanning(start: int, end: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the rows from ``start`` to ``end``, which are fewer than the rows; ``linked`` gives
    those of the rows asked for that link with a row, and is not asked for rows which the forest connects already."""
    label, lo, hi = np.arange(start, end), [], []
    for a in range(start, end - 1):
        own = label[a - start]
        to = a + 1 + np.flatnonzero(label[a + 1 - start :] != own)
        to = linked(a, to) if len(to) else to
        if len(to):
            other, one = np.unique(label[to - start], return_index=True)
            lo.append(np.full(len(one), a)), hi.append(to[one])
            label[np.isin(label, other)] = own
    return (np.concatenate(lo), np.concatenate(hi)) if lo else (label[:0], label[:0])


def _loose(rows: DataFrame, level: float) -> DataFrame:
    """Edges (u, v) of a spanning forest of each tile of rows (key, i, j, block, node, fp, n, sig): pairs that may reach
    ``level``, by the last bytes of their minima too; pairs inside a block belong to its own tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["key", "i", "j"]):
            i, j, block, node, fp, n = (table.column(x).to_numpy() for x in ("i", "j", "block", "node", "fp", "n"))
            fp, inside = fp.view(np.uint64), i == j
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(len(group), -1)

            def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                ok = (inside[b] | (block[a] != block[b])) & _alike(fp, n, a, b, level)
                ok[ok] = (sig[a[ok]] == sig[b[ok]]).mean(axis=1) >= level - SLACK
                return ok

            size = np.bincount(group)
            start = np.cumsum(size) - size
            two = start[size == 2]
            two = two[possible(two, two + 1)]
            found = [(two, two + 1)]
            found += [_spanning(s, s + k, lambda a, b: b[possible(np.full(len(b), a), b)]) for s, k in zip(start[size > 2].tolist(), size[size > 2].tolist())]
            u, v = (node[np.concatenate(x)] for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.mapInArrow(tidy(run), "u long, v long")


def _linked(rows: DataFrame, level: float) -> DataFrame:
    """Edges (u, v) of a spanning forest of each tile of rows (component, i, j, block, node, fp, n, hashes): pairs whose
    sets have a similarity of ``level`` or more; pairs inside a block belong to its own tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["component", "i", "j"], 1 << 11):
            i, j, block, node, fp, n = (table.column(x).to_numpy() for x in ("i", "j", "block", "node", "fp", "n"))
            fp, inside, found = fp.view(np.uint64), i == j, []
            size = np.bincount(group)
            for s, k in zip((np.cumsum(size) - size).tolist(), size.tolist()):
                sets = [_unpacked(x) for x in table.column("hashes").slice(s, k).to_pylist()]
                many = np.array([len(x) for x in sets])
                at = np.cumsum(many) - many
                words, own = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(len(words), dtype=bool)

                def similar(a: int, b: np.ndarray) -> np.ndarray:
                    b = b[(inside[b] | (block[a] != block[b])) & _alike(fp, n, a, b, level)]
                    if len(b):
                        mine, x, y = own[at[a - s] : at[a - s] + many[a - s]], many[a - s], many[b - s]
                        mark[mine] = True
                        first = np.cumsum(y) - y
                        same = np.add.reduceat(mark[own[np.repeat(at[b - s] - first, y) + np.arange(y.sum())]], first, dtype=np.int64)
                        mark[mine] = False
                        b = b[same >= level * (x + y - same)]
                    return b

                found.append(_spanning(s, s + k, similar))
            u, v = (node[np.concatenate(x)] for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.mapInArrow(tidy(run), "u long, v long")


def _packed(hashes: np.ndarray) -> bytes:
    """A set of hashes, cut to 32 bits, as differences byte by byte, which compress well."""
    low = np.unique(hashes.astype(np.uint32))
    return np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Rows (component, blocks, node, fp, n, hashes): the shingle sets of the texts of ``members`` (uid, component, blocks,
    node, fp, n), as hashes of 32 bits (of 20,000 shingles one in twenty sets has two alike, which moves a similarity by
    0.00005)."""
    names = ["component", "blocks", "node", "fp", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([_packed(shingle_hashes(t, width)) for t in texts], pa.binary())], names=[*names, "hashes"])

    # texts go through the shuffle at any size: members grow with them, and their broadcast would pass the driver
    return docs.join(members.hint("merge"), "uid").select(*names, "text").mapInArrow(tidy(run), "component long, blocks int, node long, fp long, n int, hashes binary")


def _close_prints(nodes: DataFrame, tau: int) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) by their fingerprints: one node of each of two that the pigeonhole links within
    ``tau`` bits, and all nodes of a fingerprint beside its first."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    one, two = (prints.select(F.col("fp").alias(k), F.col("node").alias(f"node_{k}")) for k in "uv")
    apart = links(prints.select("fp"), tau).distinct().join(one, "u").join(two, "v").select("node_u", "node_v")
    alike = nodes.select("fp", F.col("node").alias("node_v")).join(one.withColumnRenamed("u", "fp"), "fp").where("node_u <> node_v").select("node_u", "node_v")
    return apart.union(alike).toDF("u", "v")


def similar_groups(docs: DataFrame, width: int = WIDTH, level: float = LEVEL, tile: int = TILE, tau: int = TAU) -> DataFrame:
    """Rows (uid, rank, first) for rows (uid, rank, text) with a unique uid: first is the uid with the least rank in
    the row's group. Groups are what links of similarity ``level`` connect: the Jaccard similarity of the sets of
    ``width`` words in a row, as it is on the whole sets.

    Equal sets are one node. Nodes come together that the pigeonhole groups link within ``tau`` bits, or that agree in a
    band of minima (a pair is missed with chance (1 - level ** ROWS) ** BANDS: 5e-6) and that fingerprints, sizes and
    minima leave possible. What such pairs connect holds every pair at the level, so its sets meet in one task, each
    sent once (where there are more than ``tile`` nodes or ``HELD`` shingles: once for each block of them), and are
    compared on the whole sets. Tasks give spanning forests, never all pairs. No words: an empty set, equal to any other
    such."""
    made = cut(sketches(docs, width), "sketches")
    nodes = cut(made.groupBy("node").agg(F.min("uid").alias("uid"), F.first("fp").alias("fp"), F.first("n").alias("n")), "nodes")
    filed = made.join(nodes.select("uid"), "uid", "left_semi").select(F.explode("bands").alias("key"), "node", "fp", "n")
    met = cut(_hubs(filed.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "node"), level), "met")

    signed = made.select("node", "sig").join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    near = _loose(_dealt(_blocks(met, "key", F.count("*") / tile).join(signed, "node"), "key"), level)
    coarse = cut(components(near.union(_close_prints(nodes, tau))), "coarse")
    members = _blocks(nodes.join(coarse, "node"), "component", F.greatest(F.count("*") / tile, F.sum("n") / HELD))
    edges = _linked(_dealt(_sets(docs.select("uid", "text"), cut(members, "members"), width), "component"), level)
    named = made.select("node", "uid", "rank").join(components(edges), "node", "left").select("uid", "rank", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min_by("uid", "rank").alias("first"))
    return named.join(first, "component").select("uid", "rank", "first")


def near_copies(keyed: DataFrame, width: int = WIDTH, level: float = LEVEL) -> DataFrame:
    """Rows (key, first) of documents with a key of their own (common.numbered): first is the key of the row that
    stays of each group, that with the smallest doc_id (null last; of equal ones by the text's hash, then the place
    in the table)."""
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64("text"), F.col(KEY))
    found = similar_groups(keyed.select(F.col(KEY).alias("uid"), rank.alias("rank"), "text"), width, level)
    return found.select(F.col("uid").alias(KEY), "first")


def one_of_each(docs: DataFrame, width: int = WIDTH, level: float = LEVEL) -> DataFrame:
    """The documents without all but one of each group of near copies. Every row counts by itself, whatever its
    doc_id: one that nothing resembles stays."""
    keyed = numbered(docs)
    gone = cut(near_copies(keyed, width, level).where(F.col("first") != F.col(KEY)).select(KEY), "copies")
    return keyed.join(gone, KEY, "left_anti").select(*docs.columns)
