"""Fingerprint lanes, components of fingerprints and the map of slots, each against a plain account of its definition."""

import hashlib
import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints, sharding, simhash

M = (1 << 64) - 1


def lanes(text):
    """The 16 exact and 128 counting lanes of a text, in whole numbers."""
    out = [0] * fingerprints.LANES
    for paragraph in text.encode().split(b"\n"):
        if paragraph:
            digest = hashlib.shake_128(paragraph).digest(2 * fingerprints.EXACT)
            for k in range(fingerprints.EXACT):
                out[k] += digest[2 * k] + 256 * digest[2 * k + 1]
        before = 0
        for word in re.findall(rb"[^\x00-\x20]+", paragraph):
            h = sum((b + 1) * pow(0x100000001B3, j, 1 << 64) for j, b in enumerate(word)) & M
            h ^= h >> 29
            h = h * 0x9E3779B97F4A7C15 & M
            h ^= h >> 32
            pair = (h + before * 0xD6E8FEB86659FD93) & M
            before = h
            pair ^= pair >> 31
            pair = pair * 0xBF58476D1CE4E5B9 & M
            out[fingerprints.EXACT + (pair >> 40) % fingerprints.SOFT] += 1 if pair & (1 << 20) else -1
    return [x % 65536 for x in out]


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([v - 65536 * (v > 32767) for v in l[fingerprints.EXACT :]] for l in (a, b))
    norm = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / norm)) if norm else 0.0


def texts(rng, n):
    words = ["the", "onré", "thing", "of", "é", "日本", "a\x01b", "X", "x"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))).replace("of", rng.choice(["of", "\n", "\n\n", "\t"])) for _ in range(n)]
    return out + [out[0], out[1] + " end", "", "\n\n", "word"]


def test_fingerprint_lanes_and_likeness(spark):
    own = dict(enumerate(texts(random.Random(1), 60)))
    own[900] = None
    got = fingerprints.fingerprint_edits(spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(3)).collect()
    ids = sorted(own, reverse=True)
    for r in got:
        text, nxt = (own[i] or "" for i in (r.doc_id, ids[(ids.index(r.doc_id) + 1) % len(ids)]))
        k = len(text) // 2
        a, b, c = lanes(text), lanes(text[: len(text) - k] + nxt[:k]), lanes(nxt)
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:04x}" for x in v) for v in (a, b))
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, c)) < 1e-12


def test_components_of_documents(spark):
    """component_id of near_duplicates by all pairs of fingerprints."""
    rng = random.Random(2)
    base = [" ".join(rng.choice(["ab", "cd", "EF", "gh", "é"]) + str(rng.randint(0, 9)) for _ in range(300)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):  # copies with a word or two changed: some of their fingerprints lie within two bits
        for k in range(4):
            words = t.split()
            words[rng.randrange(len(words))] = "new"
            rows.append((100 + 10 * i + k, " ".join(words)))
    rows += [(7, "other with a known id"), (None, base[0]), (None, "alone"), (50, None), (51, ""), (52, "   ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    prints = [fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    smallest = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    want = sorted(((i, p, smallest[g]) for (i, _), p, g in zip(rows, prints, group)), key=repr)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == want
    assert 1 < len({g for g in group}) < len(rows) - 20


def test_slots_go_to_the_lightest_shard(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(300)] + [(i % 5, "copy " * 40) for i in range(400)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed = sharding.place(sharding.sized(df), 4).select("vslot", "size").collect()
    load, to, size = [0] * 4, {}, {}
    for r in placed:
        size[r.vslot] = size.get(r.vslot, 0) + r.size
    for vslot in sorted(size, key=lambda v: (-size[v], v)):
        to[vslot] = load.index(min(load))
        load[to[vslot]] += size[vslot]
    got = sharding.shard(df, shards=4).collect()
    assert all(r.shard == to[r.vslot] for r in got)
    sums = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    assert sums == load and max(sums) - min(sums) <= max(size.values())
    spread = {r.vslot for r in got if r["size"] == 201}
    assert len(spread) > 1  # copies above half a shard do not stay in one slot
    assert sum(r["size"] for r in got) == sum(len(t or "") + 1 for _, t in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_equal_texts_share_a_shard_where_they_fit(spark):
    rows = [(i, f"text {i % 40} " * 5) for i in range(200)]
    by = {}
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=3).select("text_crc32", F.col("shard")).collect():
        by.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(by) == 40 and all(len(s) == 1 for s in by.values())
