"""Removal of repeated byte strings by a partitioned suffix array.

A string of ``length`` bytes (200) that starts at two places has the same anchor at both: the leftmost
smallest hash among the grams of ``GRAM`` bytes inside it. So only the suffixes that start at anchors are
sorted (about one in eighty; a whole suffix array would ship some 200 bytes for each byte of text), and still every
repeat is found:

1. Each text gives its anchors, each with the run of string starts that it stands for, the leading ``GRAM`` bytes of
   the suffix and a hash of the bytes that those strings span (the region).
2. Sampled splitters range-partition the suffixes by leading bytes and region into buckets of about ``ROWS`` rows. Each
   bucket sorts by multikey quicksort, one column of eight bytes after another within ties, and compares neighbours.
   Equal regions: all strings of these runs are repeated. Equal leading bytes with unequal regions: the ends
   of a repeated passage, one run of each region is compared string by string in step 3. Equal regions share a bucket;
   leading bytes may go on across a boundary, so those at either end of a bucket count as having other regions beside
   them. A task sends a region that it holds more than once twice at most, so that very common passages stay small.
3. The few runs at ends of passages fetch their texts again. Of every string that starts in them a hash, with that of
   its anchor and the distance from it, goes to a bucket of the anchor's gram, or where ``HOT`` regions or more share that,
   of its own hash, so that no passage, however common, is one group; a task settles what it holds twice and sends one
   of it. Hashes that meet mark their strings.
4. Marked strings are merged into spans per text and cut out.

Defined results: null counts as empty; texts shorter than ``length`` stay whole; matches never cross
documents; strings are judged on the input; copies of a text count as other places. Rows with null or
repeated doc_id are kept apart by their text. Other columns are passed over. Beyond the leading bytes, strings are equal
if hashes of 64 bits are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, slices, whole_groups

LENGTH, GRAM, ROWS, HOT = 200, 32, 200_000, 1000
#: Regions that a task remembers having sent.
SENT = 1_000_000
_LEAD = ["w0", "w1", "w2", "w3"]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _grams(block: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each position (k a power of two), by doubling."""
    h, n = block.astype(np.uint64) + np.uint64(1), 1
    while n < k:
        factor = np.uint64(pow(int(_BASE), n, 1 << 64))
        h = h[:-n] * factor + h[n:]
        n *= 2
    return _mix(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in h[s : s + width], for each s."""
    at, value, n = np.arange(len(h), dtype=np.int32), h, 1
    steps = []
    while 2 * n <= width:
        steps.append(n)
        n *= 2
    if n < width:
        steps.append(width - n)
    for step in steps:
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, value[step:], value[:-step])
    return at


def anchors(block: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts inside ``block``: text number, anchor, first and last string start (all within the text),
    the leading bytes in four numbers that sort as they do, and the region hash of each run."""
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(block) < length:
        return empty
    h = _grams(block, GRAM)
    least = _least(h, length - GRAM + 1)
    first = np.repeat(starts, np.maximum(lengths - length + 1, 0))
    if not len(first):
        return empty
    count = np.maximum(lengths - length + 1, 0)
    s = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    text = np.repeat(np.arange(len(starts)), count)
    p = least[s]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (text[1:] != text[:-1]))))
    a, b = s[new], s[np.concatenate((new[1:] - 1, [len(s) - 1]))]
    p, text = p[new].astype(np.int64), text[new]
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(block), _BASE))), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(block), np.uint64(pow(int(_BASE), -1, 1 << 64))))), dtype=np.uint64)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    region = _mix((run[b + length] - run[a]) * inverse[a])
    region = _mix(region ^ ((p - a).astype(np.uint64) << np.uint64(32)) ^ (b - a).astype(np.uint64))
    lead = []
    for word in range(GRAM // 8):
        w = np.zeros(len(p), dtype=np.uint64)
        for i in range(8):
            w = (w << np.uint64(8)) | block[p + 8 * word + i]
        lead.append((w ^ np.uint64(1 << 63)).view(np.int64))
    base = starts[text]
    return text, (p - base).astype(np.int32), (a - base).astype(np.int32), (b - base).astype(np.int32), *lead, region.view(np.int64)


def multikey_order(*columns: np.ndarray) -> np.ndarray:
    """Order of rows by several columns: quicksort on the first, then on the next within ties only."""
    order = np.argsort(columns[0], kind="quicksort")
    for k in range(1, len(columns)):
        tied = np.ones(len(order) - 1, dtype=bool) if len(order) else np.zeros(0, dtype=bool)
        for c in columns[:k]:
            tied &= c[order][1:] == c[order][:-1]
        group = np.cumsum(np.concatenate(([False], ~tied))) if len(order) else np.zeros(0, int)
        member = np.concatenate((tied, [False])) | np.concatenate(([False], tied)) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(member)
        if not len(at):
            break
        order[at] = order[at[np.lexsort((columns[k][order[at]], group[at]))]]
    return order


def _runs(texts: DataFrame, length: int) -> DataFrame:
    names = ["k", "p", "a", "b", *_LEAD, "region", "n"]

    def rows(part: pa.RecordBatch, text: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), *map(pa.array, columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        sent = np.zeros(0, dtype=np.int64)  # regions that have gone out as repeated, sorted
        for part, blobs in slices(batches, "text"):
            # two copies of a text tell as much as more: each of its strings is repeated
            at = []
            for i, k in enumerate(part.column(0).to_pylist()):
                seen[k] += 1
                if seen[k] <= 2:
                    at.append(i)
            if len(seen) > SENT:
                seen.clear()
            found, begin = [], 0
            while begin < len(at):  # blocks that stay in the processor's cache
                stop, size = begin, 0
                while stop < len(at) and size < 256 << 10:
                    size += len(blobs[at[stop]])
                    stop += 1
                sizes = np.array([len(blobs[i]) for i in at[begin:stop]], dtype=np.int64)
                text, *columns = anchors(np.frombuffer(b"".join(blobs[i] for i in at[begin:stop]), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes, length)
                found.append((np.array(at[begin:stop], dtype=np.int64)[text], *columns))
                begin = stop
            if not found or not sum(len(f[0]) for f in found):
                continue
            text, p, a, b, *lead, region = map(np.concatenate, zip(*found))
            # a region that is held twice is settled here: its runs go on as such, merged where one
            # follows another, and one row stands for them in the comparison
            unique, first, inverse, count = np.unique(region, return_index=True, return_inverse=True, return_counts=True)
            known = np.isin(unique, sent, assume_unique=True)
            whole = (count >= 2)[inverse] | known[inverse]
            w = np.flatnonzero(whole)
            if len(w):
                new = np.concatenate(([True], (text[w][1:] != text[w][:-1]) | (a[w][1:] != b[w][:-1] + 1)))
                head, tail = w[new], w[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(w) - 1]))]
                spread = _mix(head.astype(np.uint64) + region[head].view(np.uint64)).view(np.int64)
                yield rows(part, text[head], p[head], a[head], b[tail], *[spread] * 5, np.full(len(head), 9, np.int8))
            new = first[~known]
            yield rows(part, text[new], p[new], a[new], b[new], *[x[new] for x in lead], region[new], np.minimum(count[~known], 2).astype(np.int8))
            twice = unique[(count >= 2) & ~known]
            sent = np.union1d(sent, twice) if len(sent) + len(twice) <= SENT else twice

    return texts.select("k", "text").mapInArrow(run, f"k binary, p int, a int, b int, {', '.join(w + ' long' for w in _LEAD)}, region long, n byte")


def _compare(bucket: DataFrame) -> DataFrame:
    """Step 2: rows (k, p, a, b, whole, hot): whole for runs whose strings are all repeated, else a run whose leading
    bytes occur with unequal regions; hot if those are many, or may be as they stand at the bucket's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [b for b in batches if b.num_rows]
        if not every:
            return
        t = pa.Table.from_batches(every).combine_chunks()
        settled = t.column("n").to_numpy() == 9
        yield from rows(t.filter(pa.array(settled)), True)
        t = t.filter(pa.array(~settled)).combine_chunks()
        if not len(t):
            return
        *lead, region, n = (t.column(c).to_numpy() for c in (*_LEAD, "region", "n"))
        order = multikey_order(*lead, region)
        new_lead = np.ones(len(order), dtype=bool)
        new_lead[1:] = np.any([c[order][1:] != c[order][:-1] for c in lead], axis=0)
        new_region = new_lead.copy()
        new_region[1:] |= region[order][1:] != region[order][:-1]
        at = np.flatnonzero(new_region)
        whole_run = np.repeat(np.add.reduceat(n[order].astype(np.int64), at) >= 2, np.diff(np.concatenate((at, [len(order)]))))
        # one run of each region where the leading bytes have several; those at the bucket's ends may
        first = np.flatnonzero(new_lead)
        regions = np.add.reduceat(new_region.astype(np.int64), first)
        regions[[0, -1]] = HOT
        regions = np.repeat(regions, np.diff(np.concatenate((first, [len(order)]))))
        yield from rows(t.take(pa.array(order[whole_run])), True)
        for hot in (False, True):
            yield from rows(t.take(pa.array(order[new_region & (regions >= 2) & ((regions >= HOT) == hot)])), False, hot)

    def rows(found: pa.Table, flag: bool, hot: bool = False) -> Iterator[pa.RecordBatch]:
        for b in found.combine_chunks().to_batches(max_chunksize=20_000):
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("k", "p", "a", "b")] + [pa.array([x] * b.num_rows, pa.bool_()) for x in (flag, hot)], names=["k", "p", "a", "b", "whole", "hot"])

    return bucket.mapInArrow(run, "k binary, p int, a int, b int, whole boolean, hot boolean")


def _string_hashes(block: np.ndarray, base: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of texts that start at ``base`` in ``block``: run number and start (in the text) of each string, a
    hash of the string, its anchor's place in it and the anchor's gram, and one of the gram."""
    count = (b - a + 1).astype(np.int64)
    row = np.repeat(np.arange(len(a)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    s = base[row] + a[row] + offset
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(block), _BASE))), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(block), np.uint64(pow(int(_BASE), -1, 1 << 64))))), dtype=np.uint64)
    acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    h = _mix((acc[s + length] - acc[s]) * inverse[s])
    gram = _grams(block, GRAM)[base + p][row]
    return row, a[row] + offset, gram, _mix(h ^ (gram >> np.uint64(1)) ^ ((p[row] - a[row] - offset).astype(np.uint64) << np.uint64(48)))


def _spans_of(k: list[bytes], text: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Rows (k, a, b) of strings that start one after another in a text (by its number in ``k``)."""
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)))) if len(text) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:] - 1, [len(text) - 1])) if len(text) else new
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()).take(pa.array(text[new])), pa.array(start[new].astype(np.int32)), pa.array(start[last].astype(np.int32))], names=["k", "a", "b"])


def _strings(ends: DataFrame, length: int, buckets: int) -> DataFrame:
    """Step 3: of texts with runs (k, doc_id, text, runs), the string starts (k, a, b) whose string is in another run
    too."""
    schema = "bucket int, k binary, a int, b int, ks array<binary>, hashes binary, texts binary, starts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in slices(batches, "text", 1 << 20):
            seen, ks, runs, texts = set(), [], [], []
            for k, t, rs in zip(part.column(0).to_pylist(), blobs, part.column(3).to_pylist(), strict=True):
                if rs and k not in seen:
                    seen.add(k)
                    runs += [(len(ks), r["p"], r["a"], r["b"], r["hot"]) for r in rs]
                    ks.append(k)
                    texts.append(t)
            if not runs:
                continue
            number, p, a, b, hot = np.array(runs, dtype=np.int64).T
            sizes = np.array([len(t) for t in texts])
            row, start, gram, h = _string_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), (np.cumsum(sizes) - sizes)[number], p, a, b, length)
            text = number[row]
            unique, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            twice = np.flatnonzero((count >= 2)[inverse])
            here = _spans_of(ks, text[twice], start[twice])
            empty = [pa.nulls(here.num_rows, t) for t in (pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(here.num_rows, dtype=np.int32) % buckets, pa.int32()), *here.columns, *empty], names=names)
            own = (np.where(hot[row[first]] > 0, unique, gram[first]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
            out = []
            for x, y in zip(cuts, [*cuts[1:], len(order)]):
                one = order[x:y]
                which, local = np.unique(text[first[one]], return_inverse=True)
                out.append((int(own[one[0]]), [ks[i] for i in which], unique[one].tobytes(), local.astype(np.int32).tobytes(), start[first[one]].astype(np.int32).tobytes()))
            bucket, kk, hashes, local, starts = zip(*out)
            none = pa.nulls(len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.nulls(len(out), pa.binary()), none, none, pa.array(kk, pa.list_(pa.binary())), pa.array(hashes, pa.binary()), pa.array(local, pa.binary()), pa.array(starts, pa.binary())], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["bucket"], 2048):
            cuts = np.searchsorted(group, np.arange(int(group[-1]) + 2))
            for x, y in zip(cuts, cuts[1:]):
                own = table.slice(int(x), int(y - x))
                done = own.filter(own.column("k").is_valid())  # settled where they were found
                for b in done.select(["k", "a", "b"]).combine_chunks().to_batches():
                    yield b
                own = own.filter(own.column("k").is_null())
                if not len(own):
                    continue
                ks, texts = [], []
                for k, t in zip(own.column("ks").to_pylist(), own.column("texts").to_pylist()):
                    texts.append(np.frombuffer(t, dtype=np.int32).astype(np.int64) + len(ks))
                    ks += k
                h, start = (np.concatenate([np.frombuffer(x, dtype=d) for x in own.column(c).to_pylist()]) for c, d in (("hashes", np.uint64), ("starts", np.int32)))
                text = np.concatenate(texts)
                order = np.argsort(h)
                same = h[order][1:] == h[order][:-1]
                # two rows for one text and start are copies of the text, which count as two places
                marked = np.zeros(len(h), dtype=bool)
                marked[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
                yield _spans_of(ks, text[marked], start[marked])

    sent = ends.mapInArrow(fetch, schema)
    return sent.repartition(partitions(ends.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "k binary, a int, b int")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (k, at array<struct<a, b>>): runs of string starts that are repeated, for each distinct text,
    k being its MD5."""
    n = partitions(keyed.sparkSession)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = 2 * size // (length - GRAM)  # anchors, as expected
    bucket = _runs(keyed, length).repartitionByRange(max(n, rows // ROWS), *_LEAD, "region")
    found = cut(_compare(bucket), "repeats")
    ends = found.where("not whole")
    n_ends = ends.count()
    ends = ends.groupBy("k").agg(F.collect_set(F.struct("p", "a", "b", "hot")).alias("runs"))
    # the same left side as in remove_repeats, so that both joins read one shuffle of the texts
    held = keyed.join(ends, "k", "left").select("k", "doc_id", "text", "runs")
    marked = _strings(held, length, max(n, n_ends * (length - GRAM) // 2 // (10 * ROWS) + 1))
    every = found.where("whole").select("k", "a", "b").union(marked)
    return every.groupBy("k").agg(F.collect_set(F.struct("a", "b")).alias("at"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document."""
    keyed = _keyed(docs)
    joined = keyed.join(spans(keyed, length), "k", "left").select("doc_id", "text", "at")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            rows = []
            for t, at in zip(texts, part.column(2).to_pylist(), strict=True):
                kept, gone, n, end = [], 0, 0, 0
                lo, hi = -1, -1
                merged = []
                for a, b in sorted((x["a"], x["b"] + length) for x in at or ()):
                    if a > hi:
                        if hi > lo:
                            merged.append((lo, hi))
                        lo, hi = a, b
                    else:
                        hi = max(hi, b)
                if hi > lo:
                    merged.append((lo, hi))
                for lo, hi in merged:
                    kept.append(t[end:lo])
                    gone, n, end = gone + hi - lo, n + 1, hi
                kept = b"".join([*kept, t[end:]])
                rows.append((len(t), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string()), *([pa.array([r[4] for r in rows], pa.binary())] if keep_text else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    return joined.mapInArrow(run, schema)
