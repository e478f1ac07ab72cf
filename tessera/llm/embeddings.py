"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction, and it holds the vectors whose cosine with it exceeds a threshold. The directions
are the products of random codes: a vector is cut into two blocks, each block has its own list of random
directions, and a filter is one of each. ``ROTATIONS`` independent sets of filters, each after a random rotation, keep one unlucky
cut from costing a whole cluster its filters. A vector finds all the filters that it exceeds (list decoding)
from its two short lists of block products, without trying every pair of codes, and its ``LEAST`` best
ones of each set in any case. The threshold is the largest at which a pair at the wanted cosine is expected to share ``SHARED`` filters. Vectors of one label
meet in their common filters and every pair that meets is verified in double precision; a pair is counted
only in the first filter that it shares: the filters of vectors with a link are decoded again where they meet, so that
only the vectors travel. Of pairs at cosine 0.93 to 0.94, 64 or 256 dimensions, 99.5 % or more are met whether a block
has 64, 256 or 1,024 codes; that number follows that of the vectors and changes the cost, not what is asked of a filter.

Equal vectors are taken once, with their number. A crowded filter is cut into blocks and its pairs of
blocks are dealt to tasks, which compare whole blocks and return counts and a spanning forest, not pairs.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and rows with a
null label or null vec_id, link with nothing (n_links 0, component_id their own vec_id); only vectors of
the same length are compared; rows with the same vec_id count as rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, components, cut, partitions

COSINE, SHARED, ROTATIONS, LEAST, CAP, SEED = 0.93, 16.0, 4, 4, 2048, 7
#: Vectors whose filters a task remembers.
KEPT = 50_000


def shared_share(z: float, rho: float) -> float:
    """How likely two unit vectors at cosine rho both exceed a random direction by z standard deviations."""
    x = np.linspace(z, z + 8, 2001)
    q = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in (z - rho * x) / math.sqrt(1 - rho * rho)])
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * q
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


@lru_cache(maxsize=64)
def codes(dim: int, per_block: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions of the two blocks of vectors with ``dim`` components, turned back by the rotation:
    the products with the vectors themselves are those of the rotated vectors' blocks."""
    rng = np.random.default_rng([SEED, dim, turn])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    out, at = [], 0
    for size in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((per_block, size))
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * math.sqrt(size / dim)
        out.append(c @ rotation[at : at + size])
        at += size
    return out[0], out[1]


def threshold(t: int, cosine: float, shared: float = SHARED) -> float:
    """Standard deviations that a filter asks for, so that pairs at ``cosine`` share ``shared`` of t filters."""
    low, high = 0.0, 6.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if t * shared_share(mid, cosine) >= shared else (low, mid)
    return low


def decode(unit: np.ndarray, per_block: int, z: float) -> list[np.ndarray]:
    """All filters that each unit vector exceeds, and the ``LEAST`` best of each set."""
    cutoff = z / math.sqrt(unit.shape[1])
    out: list[list[np.ndarray]] = [[] for _ in unit]
    for turn in range(ROTATIONS):
        first, second = codes(unit.shape[1], per_block, turn)
        for own, x, y in zip(out, unit @ first.T, unit @ second.T, strict=True):
            # the best LEAST pairs are among the best LEAST codes of either block
            p, q = np.sort(x)[-LEAST:], np.sort(y)[-LEAST:]
            limit = min(cutoff, np.sort((p[:, None] + q[None, :]).ravel())[-min(LEAST, p.size * q.size)])
            i = np.flatnonzero(x + q[-1] >= limit)
            j = np.flatnonzero(y + p[-1] >= limit)
            a, b = np.nonzero(x[i, None] + y[None, j] >= limit)
            own.append((turn * per_block + i[a]) * per_block + j[b])
    return [np.concatenate(own) for own in out]


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), dtype=kind).astype(np.float64).reshape(len(blobs), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow in squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cap: int = CAP, per_block: int | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of every vector of (vec_id, embedding, label). ``per_block``: codes of a
    block; if None, by the number of vectors."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(T.ArrayType(element if kind == "<f4" else T.DoubleType())).alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for i, label, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                x = None
                if i is not None and label is not None and v and None not in v:
                    x = np.array(v, dtype=kind)
                    x = x + np.zeros(1, dtype=kind)  # one zero
                    x = x.tobytes() if np.isfinite(x).all() and x.any() else None
                blobs.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], names=["vec_id", "label", "blob"])

    packed = cut(base.mapInArrow(pack, "vec_id long, label string, blob binary"), "vectors")
    distinct = packed.where("blob is not null").groupBy("label", "blob").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered as written: unlike vectors may share a vec_id
    n = nodes.count()
    per_block = per_block or (64 if n < 1_000_000 else 256 if n < 100_000_000 else 1024)
    z = threshold(ROTATIONS * per_block * per_block, cosine)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                blobs = b.column(b.schema.get_field_index("blob")).to_pylist()
                sizes = np.array([len(x) for x in blobs])
                filters: list = [None] * len(blobs)
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    for i, f in zip(own, decode(_unit([blobs[i] for i in own], kind), per_block, z)):
                        filters[i] = f
                at = np.repeat(np.arange(len(blobs)), [len(f) for f in filters])
                label, node, copies = (b.column(b.schema.get_field_index(c)).take(pa.array(at)) for c in ("label", "node", "copies"))
                dims = pa.array(sizes[at].astype(np.int32))
                yield pa.RecordBatch.from_arrays([label, dims, pa.array(np.concatenate(filters).astype(np.int32)), node, copies, pa.array(blobs, pa.binary()).take(pa.array(at))], names=["label", "dim", "f", "node", "copies", "blob"])

    filed = nodes.mapInArrow(file, "label string, dim int, f int, node long, copies long, blob binary")
    crowded = cut(filed.groupBy("label", "dim", "f").count().where(F.col("count") > cap).select("label", "dim", "f", F.ceil(F.col("count") / (cap // 2)).cast("int").alias("blocks")), "crowded")
    blocked = filed.join(crowded, ["label", "dim", "f"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiled = blocked.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("label", "dim", "f", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "blob")
    key = ["label", "dim", "f", "i", "j"]

    def compare(rows: dict[str, list], f: int, i: int, j: int, known: dict[int, np.ndarray]) -> Iterator[tuple]:
        unit = _unit(rows["blob"], kind)
        near = unit @ unit.T >= cosine
        node, copies, block = (np.array(rows[c]) for c in ("node", "copies", "block"))
        near &= node[:, None] != node[None, :]
        if i != j:  # pairs inside a block belong to its own tile
            near &= block[:, None] != block[None, :]
        at = np.flatnonzero(near.any(1))
        if not len(at):
            return
        near = near[np.ix_(at, at)]
        node, copies = node[at], copies[at]
        # which of them share an earlier filter
        new = [k for k in range(len(at)) if int(node[k]) not in known]
        if new:
            if len(known) > KEPT:
                known.clear()
                new = list(range(len(at)))
            known.update(zip(node[new].tolist(), decode(unit[at[new]], per_block, z)))
        before = [own[own < f].tolist() for own in (known[k] for k in node.tolist())]
        number = {x: k for k, x in enumerate(sorted(set().union(*before)))}
        if number:
            member = np.zeros((len(at), len(number)), dtype=np.float32)
            for k, own in enumerate(before):
                member[k, [number[x] for x in own]] = 1
            fresh = near & (member @ member.T == 0)
        else:
            fresh = near
        for r, w in zip(node.tolist(), (fresh * copies[None, :]).sum(1).tolist()):
            if w:
                yield r, None, w
        seen = np.zeros(len(at), dtype=bool)
        for s in range(len(at)):  # a breadth-first forest
            if seen[s]:
                continue
            seen[s], front = True, [s]
            while front:
                k = front.pop()
                new = np.flatnonzero(fresh[k] & ~seen)
                seen[new] = True
                front += new.tolist()
                for x in new:
                    yield int(node[k]), int(node[x]), None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        known: dict[int, np.ndarray] = {}
        now, found = None, []
        names = ["block", "node", "copies", "blob"]

        def flush() -> pa.RecordBatch:
            u, v, w = zip(*found) if found else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.int64())], names=["u", "v", "w"])

        for b in batches:
            columns = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in key + names}
            for k in range(b.num_rows):
                here = tuple(columns[c][k] for c in key)
                if here != now:
                    if now and len(held["node"]) > 1:
                        found.extend(compare(held, *now[2:], known))
                    now, held = here, {c: [] for c in names}
                for c in names:
                    held[c].append(columns[c][k])
            if len(found) > 10_000:
                yield flush()
        if now and len(held["node"]) > 1:
            found.extend(compare(held, *now[2:], known))
        yield flush()

    links = cut(tiled.repartition(partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(meet, "u long, v long, w long"), "links")
    counted = links.where("w is not null").groupBy("u").agg(F.sum("w").alias("w"))
    comp = components(links.where("v is not null").select("u", "v")).withColumnRenamed("node", "member")
    # a component is called by the smallest vec_id of all its nodes
    first = comp.join(nodes.select(F.col("node").alias("member"), "rep"), "member").groupBy("component").agg(F.min("rep").alias("c"))
    called = comp.join(bounded(first), "component").select("member", "c")
    named = nodes.join(counted, nodes.node == counted.u, "left").join(called, nodes.node == called.member, "left")
    named = named.select("label", "blob", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("c", "rep").alias("c"))
    joined = packed.join(named, ["label", "blob"], "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
