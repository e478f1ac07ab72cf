"""Hard negatives for anchors, by secondary sort.

Every anchor is compared with every row, in blocks: anchors are dealt to groups that fit a task's memory, rows to as many groups as
there are tasks, and where two groups meet the anchors are held and the rows stream past. A first pass, in which anchors meet only
rows of their own label, leaves the best rows of each meeting, and of these an anchor's positives; a second leaves the best rows of other
labels in each positive's window. Positives and what the second pass leaves are packed into keys (anchor, descending
score, kind, id); the secondary-sort shuffle (a repartition by the anchor and a sort inside partitions) brings an anchor's keys in
the order of their scores to an iterator that opens a window for each positive and gives out negatives until the window is
full. It holds an anchor's open windows and nothing else. A meeting leaves at most ``positives`` rows of an anchor in the
first pass, ``positives`` times ``negatives`` in the second, so no row that belongs to the result is lost.

Defined results: rows whose label is null, or whose vector is null or holds null or non-finite components, take no part; vectors are
compared with those of their own length only; a positive is another row than the anchor, also where it is equal to it or has its id; rows
with the same vec_id count as rows, as anchors too; a row with null vec_id is no anchor, and comes last in ties;
scores beyond a long are given as its ends. Empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, numbered, partitions
from .vectors import exact, floored, largest, matrix

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's: at least and at most.
LOWEST, HIGHEST = 30, 90
#: Anchors held by a task, rows of a group, and cells of a block of scores.
ANCHORS, ROWS, CELLS = 16_384, 65_536, 1 << 22
_LAST = (1 << 63) - 1
_FOUND = "kf long, kr long, anchor_id long, score long, id long"


def _best(anchor: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each anchor by descending score, then id."""
    order = np.lexsort((row, ident, -score, anchor))
    a = anchor[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.array([], dtype=np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    return order[rank < most]


class _Meeting:
    """A group of anchors, and the best rows for each of their windows [low, high] among those that streamed past."""

    def __init__(self, anchors: pa.RecordBatch, dim: int, same: bool, most: int):
        self.same, self.most, self.n = same, most, len(anchors)
        self.v = matrix(anchors.column("v"), dim)
        self.size = largest(self.v)
        self.key = [anchors.column(k).to_numpy(zero_copy_only=False) for k in ("kf", "kr", "id", "label")]
        windows = anchors.column("windows").to_pylist()
        self.windows = max(1, max((len(w) for w in windows if w), default=0))
        self.low = np.full((self.windows, self.n), -_LAST - 1, dtype=np.int64)
        self.high = np.full((self.windows, self.n), _LAST, dtype=np.int64)
        if not same:
            self.low[:], self.high[:] = 1, 0  # of what has no positives, nothing
            for a, own in enumerate(windows):
                for w, p in enumerate(own or ()):
                    self.low[w, a], self.high[w, a] = -(-LOWEST * p // 100), HIGHEST * p // 100
        self.held = [tuple(np.array([], dtype=np.int64) for _ in range(4)) for _ in range(self.windows)]
        self.seen = 0

    def add(self, rows: pa.RecordBatch, dim: int) -> None:
        x = matrix(rows.column("v"), dim)
        kind = exact(dim * self.size * largest(x) + 1)
        x = x.astype(kind)
        kf, kr, ident, label = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("kf", "kr", "id", "label"))
        step = max(1, CELLS // max(1, len(x)))
        for at in range(0, self.n, step):
            end = min(self.n, at + step)
            score = self.v[at:end].astype(kind) @ x.T
            if kind is object:
                score = np.clip(score, -_LAST - 1, _LAST)
            score = score.astype(np.int64)
            if self.same:
                open_ = ~((self.key[0][at:end, None] == kf) & (self.key[1][at:end, None] == kr))
            else:
                open_ = self.key[3][at:end, None] != label
            for w in range(self.windows):
                fit = open_ & (score >= self.low[w, at:end, None]) & (score <= self.high[w, at:end, None])
                if not fit.any():
                    continue
                a, r = np.nonzero(fit)
                own = (a + at, score[a, r], ident[r], r + self.seen)
                own = tuple(np.concatenate(pair) for pair in zip(self.held[w], own))
                keep = _best(*own, self.most)
                self.held[w] = own = tuple(c[keep] for c in own)
                # what is below a full window's last row is not looked at again
                full = np.flatnonzero(np.bincount(own[0], minlength=self.n) == self.most)
                last = np.full(self.n, -_LAST - 1, dtype=np.int64)
                last[own[0]] = own[1]  # ordered by descending score, so the last one stays
                self.low[w, full] = np.maximum(self.low[w, full], last[full])
        self.seen += len(x)

    def found(self) -> pa.RecordBatch:
        a, score, ident, row = (np.concatenate(c) for c in zip(*self.held))
        once = np.unique(np.stack([a, row]), axis=1, return_index=True)[1] if len(a) else a  # a row may be in several windows
        a, score, ident = a[once], score[once], ident[once]
        columns = [self.key[0][a], self.key[1][a], self.key[2][a], score, ident]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kf", "kr", "anchor_id", "score", "id"])


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, same: bool, most: int) -> DataFrame:
    """The best rows of every meeting of a group of anchors (with their ``windows``) and a group of rows. All rows of one vector length, and of
    one label where ``same``, meet."""
    spread = partitions(rows.sparkSession)
    down, across = -(-n_anchors // ANCHORS) or 1, max(-(-n_rows // ROWS), min(spread, -(-n_rows // 2048))) or 1
    own = F.pmod(F.xxhash64("kf", "kr"), F.lit(down)).cast("int")
    other = F.pmod(F.xxhash64("kr", "kf"), F.lit(across)).cast("int")
    columns = ["dim", "meet", "a", "r", "kind", "kf", "kr", "id", "label", "windows", "v"]
    meet = F.col("label") if same else F.lit(0).cast("long")
    left = anchors.withColumn("a", own).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("kind", F.lit(0))
    right = rows.withColumn("r", other).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("kind", F.lit(1)).withColumn("windows", F.lit(None).cast("array<bigint>"))
    both = left.withColumn("meet", meet).select(columns).unionByName(right.withColumn("meet", meet).select(columns))
    key = ["dim", "meet", "a", "r"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, meeting = None, [], None
        for whole in batches:
            marks = np.stack([whole.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in [*key, "kind"]], axis=1)
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)]) if len(marks) else []
            for s, e in zip(starts, [*starts[1:], len(marks)], strict=True):
                here, kind = tuple(marks[s, :4].tolist()), marks[s, 4]
                b = whole.slice(s, e - s)
                if here != now:
                    if meeting:
                        yield meeting.found()
                    now, waiting, meeting = here, [], None
                if kind == 0:
                    waiting.append(b)
                elif waiting or meeting:
                    if meeting is None:
                        meeting = _Meeting(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], here[0], same, most)
                        waiting = []
                    for k in range(0, len(b), 4096):
                        meeting.add(b.slice(k, 4096), here[0])
        if meeting:
            yield meeting.found()

    return both.repartition(spread, *key).sortWithinPartitions(*key, "kind").mapInArrow(sweep, _FOUND)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys of positives (kind 0) and negatives (kind 1) in; (anchor_id, positive, negative, rank, scores) out."""
    now, open_ = None, []
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = zip(*out) if out else ((),) * 6
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
        out.clear()
        return batch

    for b in batches:
        for kf, kr, anchor, score, kind, ident in zip(*(b.column(c).to_pylist() for c in ("kf", "kr", "anchor_id", "score", "kind", "id")), strict=True):
            if (kf, kr) != now:
                now, open_ = (kf, kr), []
            ident = None if ident == _LAST else ident
            if kind == 0:
                open_.append([ident, score, -(-LOWEST * score // 100), HIGHEST * score // 100, 0])
                continue
            for window in open_:
                if window[4] < NEGATIVES and window[2] <= score <= window[3]:
                    window[4] += 1
                    out.append((anchor, window[0], window[4], ident, window[1], score))
        if len(out) > 10_000:
            yield flush()
    yield flush()


def mine(vectors: DataFrame, anchor: Column) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the vectors (vec_id, embedding, label):
    for each row that fulfils ``anchor`` and each of its first ``POSITIVES`` rows of the same label by integer inner product,
    the first ``NEGATIVES`` rows of other labels with ``LOWEST`` to ``HIGHEST`` hundredths of the positive's score."""
    integral = isinstance(vectors.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if integral else F.xxhash64("label")
    whole = numbered(floored(vectors.where(F.col("label").isNotNull())), "key")
    whole = whole.select(F.col("key.file").alias("kf"), F.col("key.row").alias("kr"), "vec_id", label.alias("label"), F.size("v").cast("long").alias("dim"), "v")
    rows = cut(whole, "rows").withColumn("id", F.coalesce("vec_id", F.lit(_LAST)))
    anchors = rows.where(anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    none = F.lit(None).cast("array<bigint>")
    near = _met(rows, anchors.withColumn("windows", none), n_rows, n_anchors, True, POSITIVES)
    first = near.repartition("kf", "kr").sortWithinPartitions("kf", "kr", F.desc("score"), "id").mapInArrow(_leading, _FOUND)
    positives = cut(first, "positives")
    scores = positives.groupBy("kf", "kr").agg(F.sort_array(F.collect_list("score")).alias("windows"))  # at most POSITIVES
    far = _met(rows, anchors.join(scores, ["kf", "kr"]), n_rows, n_anchors, False, NEGATIVES)
    keys = positives.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
    keys = keys.repartition("kf", "kr").sortWithinPartitions("kf", "kr", F.desc("score"), "kind", "id")
    return keys.mapInArrow(_windows, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ``POSITIVES`` keys of each anchor, of sorted ones."""
    now, rank = None, 0
    for b in batches:
        keep = []
        for key in zip(b.column("kf").to_pylist(), b.column("kr").to_pylist(), strict=True):
            now, rank = (now, rank + 1) if key == now else (key, 1)
            keep.append(rank <= POSITIVES)
        yield b.filter(pa.array(keep, pa.bool_()))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Every seventh vec_id with the next of ten labels."""
    moved = F.col("vec_id").isNotNull() & (F.col("vec_id") % 7 == 0)
    return vectors.withColumn("label", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS nr, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.nr AS anr, a.vec_id AS anchor_id, r.nr AS rnr, r.vec_id AS id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept r ON a.nr <> r.nr AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anr ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anr = n.anr AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anr, p.rnr ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""
