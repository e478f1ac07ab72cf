"""Vectors compressed to codes: product quantisation by ball k-means, in whole numbers.

A vector is cut into equal consecutive parts; each part position has a codebook, fitted by a few rounds of k-means over all
vectors. The first assignment compares a part with all entries. Every later one starts from the part's entry before: the
parts that an entry holds form a ball around it, and its radius says which other entries can be nearest to any of them (those
within twice the radius). Parts nearer to the entry than half the way to its nearest neighbour are in the stable core and are not compared
with anything. The rest lie in rings: a part at distance d can only go to neighbours within 2 d, so it is compared exactly
with the first few neighbours by distance and no others. Balls are those of a batch of rows, whose radii are smaller than
those over all rows, so that nothing but codebooks (``entries`` times the dimension) passes through the driver. All
comparisons are of whole numbers and include ties, which go to the lower index: the result is that of plain k-means.

Defined results: rows whose vector is null or holds null or non-finite components are left out; vectors shorter than the
longest are followed by zeros, up to a multiple of the number of parts; with fewer rows than entries a codebook has
as many entries as there are rows; a null vec_id comes after all others, rows of equal vec_id by their vector; repeated rows count
each; an empty table gives an empty result. Components beyond a long are taken as its ends. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut
from .vectors import exact, floored, largest, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Copies of a label's sum, so that the rows of one label meet it in several tasks.
SALTS = 16
_LONG = (1 << 63) - 1


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c, exact."""
    kind = exact(x.shape[1] * (largest(x) + largest(c)) ** 2)
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def _paired(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of c, one to one, exact."""
    kind = exact(x.shape[1] * (largest(x) + largest(c)) ** 2)
    gap = x.astype(kind) - c.astype(kind)
    return (gap * gap).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each part, by comparison with all."""
    return np.argmin(_distances(x, book), axis=1)


def reassigned(x: np.ndarray, book: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The nearest entry of each part that had the entry ``held`` before, by balls."""
    out = held.copy()
    own = _paired(x, book[held])
    between = _distances(book, book)
    order = np.argsort(held, kind="stable")
    ends = np.flatnonzero(np.diff(held[order])) + 1
    for rows in np.split(order, ends) if len(order) else ():
        i = int(held[rows[0]])
        reach = 4 * own[rows]  # of distances doubled and squared
        neighbours = np.flatnonzero(between[i] <= reach.max())
        neighbours = neighbours[neighbours != i]
        if not len(neighbours):
            continue
        neighbours = neighbours[np.argsort(between[i][neighbours], kind="stable")]
        rings = np.searchsorted(between[i][neighbours], reach, side="right")
        low = 0
        while low < len(neighbours):  # rings of one rank, two, four ...; rank 0 is the stable core
            high = min(2 * low or 1, len(neighbours))
            at = rows[(rings > low) & (rings <= high)]
            if len(at):
                among = np.append(neighbours[:high], i)
                d = _distances(x[at], book[among])
                out[at] = np.where(d == d.min(1, keepdims=True), among[None, :], len(book)).min(1)
            low = high
    return out


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), parts).astype(np.int64)


def _assigned(rows: DataFrame, books: np.ndarray, first: bool, error: bool = False) -> DataFrame:
    """The rows with their codes by ``books`` (part, entry, position); with their squared distances, if asked for."""
    parts, _, width = books.shape
    label = rows.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), parts * width)
            before = None if first else _codes(b.column("code"), parts)
            found = np.empty((len(x), parts), dtype=np.int64)
            errors = np.zeros(len(x), dtype=object)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                found[:, p] = nearest(part, books[p]) if first else reassigned(part, books[p], before[:, p])
                if error:
                    errors += [int(e) for e in _paired(part, books[p][found[:, p]])]
            codes = [row.tobytes() for row in found.astype(np.uint8)]
            arrays = [b.column("vec_id"), b.column("label"), pa.array([min(e, _LONG) for e in errors], pa.int64()) if error else b.column("v"), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "error" if error else "v", "code"])

    return rows.mapInArrow(assign, f"vec_id long, label {label}, {'error long' if error else 'v array<bigint>'}, code binary")


def _refitted(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the floor of its parts' mean: a task sums its rows first."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=object)
        for b in batches:
            x, codes = matrix(b.column("v"), parts * width), _codes(b.column("code"), parts)
            x = x.astype(exact(largest(x) * (len(x) + 1)))
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                if not len(order):
                    continue
                starts = np.flatnonzero(np.r_[True, np.diff(codes[order, p]) != 0])
                used = codes[order[starts], p]
                n[p, used] += np.diff(np.r_[starts, len(order)])
                sums = np.add.reduceat(x[order, p * width : (p + 1) * width], starts, axis=0)
                total[p, used] += np.array([[int(s) for s in row] for row in sums], dtype=object).reshape(sums.shape)
        p, e = np.nonzero(n)
        at = np.repeat(np.arange(len(p)), width)
        sums = pa.array([int(s) for s in total[p, e].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(p[at]), pa.array(e[at]), pa.array(np.tile(np.arange(width), len(p))), pa.array(n[p, e][at]), sums], names=["p", "e", "k", "n", "s"])

    sums = rows.mapInArrow(add, "p long, e long, k long, n long, s decimal(38,0)").groupBy("p", "e", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for p, e, k, n, s in sums.collect():  # as many as a codebook has numbers
        out[p, e, k] = int(s) // n
    return out


def codebooks_of(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, position) of the parts of the first rows by vec_id."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    seeds = np.array([r.v for r in seeds], dtype=np.int64)
    return seeds.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2).copy()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, error, code) of the vectors (vec_id, embedding, label), with the code as one byte for each part, and the
    codebooks (part, entry, position). At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    rows = floored(vectors)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(1, -(-dim // parts)) * parts
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    books = codebooks_of(rows, dim, parts, entries)
    for turn in range(rounds):
        if books.shape[1]:
            rows = cut(_assigned(rows, books, first=turn == 0), "codes")
            books = _refitted(rows, books)
    return _assigned(rows, books, first=rounds == 0 or not books.shape[1], error=True), books


def codes(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256) of every whole vector: the code in hexadecimal, its squared
    distance, that of its label, and the digest of all entries' components."""
    found, books = compress(vectors)
    found = cut(found, "coded")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    salted = bounded(totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "of"))
    rows = found.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, rows.label.eqNullSafe(salted.of) & (rows.own == salted.salt))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: The same in SQL, for vectors of one length.
SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS nr
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS (
  SELECT nr, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS w FROM kept, (SELECT unnest(range(16)) AS p)
), b0 AS (SELECT p, nr AS e, w FROM pieces WHERE nr < 64
), a1 AS (
  SELECT x.nr, x.p, x.w, min([list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e])[2] AS e
  FROM pieces x JOIN b0 b USING (p) GROUP BY ALL
), n1 AS (
  SELECT p, e, list(m ORDER BY k) AS w FROM (SELECT p, e, k, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT p, e, unnest(w) AS c, unnest(range(len(w))) AS k FROM a1) GROUP BY ALL) GROUP BY ALL
), b1 AS (SELECT p, e, coalesce(n1.w, b0.w) AS w FROM b0 LEFT JOIN n1 USING (p, e)
), a2 AS (
  SELECT x.nr, x.p, x.w, min([list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e])[2] AS e
  FROM pieces x JOIN b1 b USING (p) GROUP BY ALL
), n2 AS (
  SELECT p, e, list(m ORDER BY k) AS w FROM (SELECT p, e, k, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m
    FROM (SELECT p, e, unnest(w) AS c, unnest(range(len(w))) AS k FROM a2) GROUP BY ALL) GROUP BY ALL
), b2 AS (SELECT p, e, coalesce(n2.w, b1.w) AS w FROM b1 LEFT JOIN n2 USING (p, e)
), a3 AS (
  SELECT x.nr, x.p, min([list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e]) AS best
  FROM pieces x JOIN b2 b USING (p) GROUP BY ALL
), coded AS (
  SELECT nr, string_agg(format('{:02x}', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a3 GROUP BY nr
), book AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (nr), book
"""
