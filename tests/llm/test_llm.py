"""The training-data operators against brute force, round trips and held-out rows, on small tables with nulls,
empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, embeddings, fingerprints, language, mixing, pii, repeats, scoring, sharding, simhash
from tessera.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, rep long, part string, label int"


def texts():
    rng = random.Random(5)
    words = ["the", "onré", "thing", "of", "é", "wordish", "Über", "and", "x1"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) + "\n" + " ".join(rng.choice(words) for _ in range(30)) for _ in range(60)]
    passage = "".join(rng.choice("abcdefg hij") for _ in range(450))
    out += [out[3], out[3], out[4][:200] + passage + "tail one", passage + " other tail", "a" * 700, "", None, "   ", "solo", "ab" * 3000]
    out += [out[10] + " mail me a.b@c.de or +1 (171) 555-2028 at 10.0.0.1 card 4111 1111 1111 1111"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4], 0, "k", 1, "p", 2) for i, t in enumerate(texts())]
    rows += [rows[5], (None, "no id here at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_bpe(docs, plain):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in plain:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert bag(bpe.round_trip(docs)) == want
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("a  b\n\n c", "x<|endoftext|> y", "don't 's 12ab", "  z　 q", "\x00 \x1c", "日本語 テキスト", "y" * 500):
        assert enc.encode(t.encode()) == tok.encode(t, add_special_tokens=False).ids
    back = bpe.decode(bpe.encode(docs.where("text IS NOT NULL")))
    assert bag(back) == bag(docs.where("text IS NOT NULL").select("doc_id", "text"))


def test_fingerprints(docs, plain):
    got = fingerprints.fingerprint_edits(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    own = dict((i, t or "") for i, t in plain if i is not None)
    ids = sorted(own, reverse=True)
    assert len(got) == len(ids)
    for r in got:
        nxt = own[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        t, k = own[r.doc_id], len(own[r.doc_id]) // 2
        new = t[: len(t) - k] + nxt[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.fingerprint_edits(docs).count() == docs.count()
    a, b = fingerprints.paragraph_vectors([b"x y\nz", b"z\nx y"])
    assert (a == b).all() and (fingerprints.delete(fingerprints.insert(a, b"new one"), b"new one") == a).all()


def test_simhash(spark, docs, plain):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((i, fp(t)) for i, t in plain)
    # planted near fingerprints: the usual path and that for crowded groups, against all pairs
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = np.concatenate([base, base[:90] ^ np.uint64(5), base[:40] ^ np.uint64(1 << 40), base[:30] ^ np.uint64(1 << 62 | 1 << 3)])
    near = np.unique(near)
    nodes = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    parent = list(range(len(near)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(near)):
        for j in range(i):
            if int(near[i] ^ near[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = sorted(sorted(int(near.view(np.int64)[j]) for j in range(len(near)) if find(j) == i) for i in range(len(near)) if find(i) == i)
    groups = [g for g in groups if len(g) > 1]
    for cap in (4096, 1):
        out = {}
        for r in components(simhash.links(nodes, 2, cap)).collect():
            out.setdefault(r.component, []).append(r.node)
        assert sorted(map(sorted, out.values())) == groups


def test_scoring(docs, plain):
    got = scoring.score(docs, head=3).collect()
    train = [t or "" for i, t in plain if i is None or zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*(t or "").encode().lower().split(), None])) for i, t in plain)
    have = sorted((r.doc_id is None, r.doc_id, r.base_score) for r in got)
    assert [x[:2] for x in want] == [x[:2] for x in have] and all(abs(a[2] - b[2]) < 1e-6 * max(1, abs(a[2])) for a, b in zip(want, have))
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def brute_ctw(train, text, depth):
    """log10 of a text's probability by the definition, a tree for each decision node."""
    counts = {}

    def steps(t):
        b = [255] * depth + list(t.lower()) + [255]
        for i in range(depth, len(b)):
            for level in range(8):
                yield (level, b[i] >> (8 - level)), tuple(reversed(b[i - depth : i])), b[i] >> (7 - level) & 1

    for t in train:
        for node, context, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((node, context[:d]), [0, 0])[bit] += 1
    children = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[:-1]), []).append((node, context))

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted, own_share = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[1])):
        e = log_kt(*counts[key])
        if key not in children:
            weighted[key], own_share[key] = e, 1.0
        else:
            below = sum(weighted[c] for c in children[key])
            weighted[key] = np.logaddexp(e, below) - math.log(2)
            own_share[key] = math.exp(e - math.log(2) - weighted[key])
    total = 0.0
    for node, context, bit in steps(text):
        one, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            key = (node, context[:d])
            if key not in counts:
                break
            last = (counts[key][1] + 0.5) / (sum(counts[key]) + 1)
            one, left = one + left * own_share[key] * last, left * (1 - own_share[key])
        one += left * last
        total += math.log10(one if bit else 1 - one)
    return total


@pytest.mark.parametrize("block", [16_384, 7])
def test_context_tree(docs, plain, block):
    train = [(t or "").encode() for i, t in plain if i is None or zlib.crc32(str(i).encode()) % 10]
    some = [(i, t) for i, t in plain if len(t or "") < 1000]
    want = sorted((i is None, i, brute_ctw(train, (t or "").encode(), 4)) for i, t in some)
    have = sorted((r.doc_id is None, r.doc_id, r.score) for r in scoring.score(docs, depth=4, block=block).collect() if r.doc_id in {i for i, _ in some})
    assert [x[:2] for x in want] == [x[:2] for x in have] and all(abs(a[2] - b[2]) < 2e-6 * max(1, abs(a[2])) for a, b in zip(want, have))


def test_context_tree_to_nine_digits():
    rng = random.Random(6)
    train = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    code, n = np.unique(np.concatenate([scoring.grams([t], 5)[0] for t in train]), return_counts=True)
    nodes = scoring.tree_nodes(code, n, 5, 0)
    sums = {}
    for level in range(8):
        own, _ = scoring.weigh(nodes, 5, scoring.TOP, level)
        parent = np.searchsorted(nodes[scoring.TOP - 1, level][0], scoring._up(nodes[scoring.TOP, level][0], level))
        sums[level] = np.bincount(parent, weights=own, minlength=len(nodes[scoring.TOP - 1, level][0]))
    trunk = scoring.Trunk(nodes, sums, scoring.TOP)
    for t in [*train, b"abacab", b"new \x00 bytes", b""]:
        got = scoring.log_probabilities(scoring.grams([t], 5)[0], nodes, trunk, 5).sum()
        assert abs(got - brute_ctw(train, t, 5)) < 1e-9 * max(1, abs(got))


def brute_repeats(plain):
    count = Counter(b[i : i + 200] for _, t in plain for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = Counter()
    for i, t in plain:
        b = (t or "").encode()
        m = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                m[s : s + 200] = b"\1" * 200
        want[i, len(b), sum(m), len(re.findall(rb"\x01+", bytes(m))), hashlib.sha256(bytes(x for x, k in zip(b, m) if not k)).hexdigest()] += 1
    return want


def test_repeats(docs, plain):
    assert bag(repeats.remove_repeats(docs)) == brute_repeats(plain)


@pytest.mark.parametrize("rows", [200_000, 7])
def test_repeats_of_common_passages(spark, monkeypatch, rows):
    """A line in every text with other words around it, passages just over and under 200 bytes, copies, over buckets
    so small that leading bytes go on across their ends."""
    monkeypatch.setattr(repeats, "ROWS", rows)
    monkeypatch.setattr(repeats, "HOT", 1000 if rows > 7 else 3)
    rng = random.Random(rows)

    def fresh(n):
        return "".join(rng.choice("abcdefghij klmno") for _ in range(n))

    line, over, under = fresh(60), fresh(230), fresh(199)
    texts = [fresh(rng.randint(0, 150)) + rng.choice([line, over, under, over + line, ""]) + fresh(rng.randint(0, 250)) for _ in range(120)]
    texts += [texts[1], texts[2] + "x", "q" + texts[2], line * 9, over + over, ""]
    made = [(i % 100, t) for i, t in enumerate(texts)] + [(None, over)]
    assert bag(repeats.remove_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(5))) == brute_repeats(made)


def test_language(spark):
    rng = random.Random(2)
    parts = {"aa": ["thing", "er", "ou"], "bb": ["ción", "ll", "ado"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(20)), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "12 ½ !", "bb"), (502, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(d).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:200]) and all(got[i].lang_pred == "und" for i in (500, 501, 502))
    assert language.identify(d.where("lang = 'zz'")).count() == 0
    # the forward sum against all segmentations
    table = language.Pieces(public_tokenizers.path(language.VOCABULARY))
    assert table.longest > 8
    prob = np.random.default_rng(0).random((len(table), 2)) / 50
    known = dict(zip(table.names, prob))

    @lru_cache(maxsize=None)
    def total(w):
        return np.ones(2) if not w else sum((known[w[:n]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in known), np.zeros(2))

    words = [b" thing", " ción".encode(), b" a", b" wordswords", b" internationalization", " привет".encode(), b" " + b"abcde" * 30, b" " + b"thing" * 60]
    got = language.word_scores(words, table, prob)
    assert all(np.allclose(got[i], np.log(total(w))) for i, w in enumerate(words[:-1]))
    # expected uses: by bumping each piece's probability (the derivative of the log)
    small = words[:4] + [b" " + b"ab" * 150]
    p = prob[:, 0].copy()
    count = language.expected_counts(small, np.array([1.0, 2.0, 1.0, 3.0, 1.0]), table, p)
    base = language.word_scores(small, table, p[:, None])[:, 0]
    for piece in (table.names.index(b" t"), table.names.index(b"s"), table.names.index(b"ab")):
        q = p.copy()
        q[piece] *= 1.0001
        slope = (language.word_scores(small, table, q[:, None])[:, 0] - base) @ np.array([1.0, 2.0, 1.0, 3.0, 1.0]) / math.log(1.0001)
        assert abs(slope - count[piece]) < 1e-2 * max(1, count[piece])


def test_language_odd_rows(spark):
    words = {"aa": "thing er ou", "bb": "ción ll ado"}
    rows = [(i, f"{words[k]} {words[k]}", k, "x", i) for i in range(40) for k in [("aa", "bb")[i % 2]]]
    rows += [(3, rows[3][1], "bb", "x", 1), (None, rows[0][1], "aa", "x", 1), (77, "thing ción", None, "x", 1), (78, "q" * 70_000, None, "x", 2), (79, "thing er ou " * 90_000, None, "x", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score long")
    got = language.identify(d).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (3, 5)} == {"bb"}
    assert [r.lang_pred for r in got if r.doc_id == 79] == ["aa"] and [r.lang_pred for r in got if r.doc_id is None] == ["aa"]
    assert all(0 <= r.score <= 1 for r in got)
    none = language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(rows)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + (i // 40) * 0.12 * rng.standard_normal(16)], i % 2) for i in range(200)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 1), (904, rows[0][1], None), (905, rows[0][1], 0), (906, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = {i: (np.array(v, dtype=np.float32).astype(float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    n, comp = Counter(), {i: i for i, *_ in rows}
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] >= 0.93 * np.linalg.norm(ok[a][0]) * np.linalg.norm(ok[b][0]):
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    for cap in (2048, 4):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, cap=cap).collect()}
        assert all((got[i].n_links, got[i].component_id) == (n[i], comp[i]) for i, *_ in rows)


def test_embeddings_with_one_id_for_unlike_vectors(spark):
    """Rows are told apart by what they are, not by their vec_id."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == Counter({(1, 1, 1, True): 1, (1, 0, 1, True): 1, (2, 1, 1, False): 1})
    rng = np.random.default_rng(8)
    base = rng.standard_normal((30, 12))
    rows = [(int(rng.integers(0, 60)), [float(x) for x in base[i % 30] + 0.15 * (i // 30) * rng.standard_normal(12)], i % 2) for i in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array([k for *_, k in rows])[:, None] == np.array([k for *_, k in rows])[None, :])
    component = np.arange(180)
    for _ in range(180):
        component = np.where(near, component[None, :], 999).min(1)
    smallest = [min(rows[j][0] for j in range(180) if component[j] == component[i]) for i in range(180)]
    want = Counter((rows[i][0], int(near[i].sum()) - 1, smallest[i]) for i in range(180))
    for cap in (2048, 4):
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, cap=cap).collect()) == want


@pytest.mark.parametrize("per_block,dim", [(64, 64), (256, 64), (1024, 64), (64, 256)])
def test_embeddings_recall_at_the_level(spark, per_block, dim):
    rng = np.random.default_rng(per_block)
    n = 1000
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal((n, dim))
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.95, (n, 1))
    every = np.concatenate((a, c * a + np.sqrt(1 - c * c) * r))
    cosine = every @ every.T
    want = int((cosine >= 0.93).sum()) - 2 * n
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = embeddings.near_duplicates(df, per_block=per_block).collect()
    links = sum(r.n_links for r in got)
    assert 0.99 * want <= links <= want


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0, 5), (1, [1.0, 0.0], 0, 6), (None, [1.0, 0.0], 0, 7), (2, [1.0, 0.0, 0.0], 0, 8), (3, [1.0, 0.01], 0, 9), (4, [1.0, 0.0], 1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep long")
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()))
    assert got == [(False, 1, 2, 1, True), (False, 1, 2, 1, True), (False, 2, 0, 2, True), (False, 3, 2, 1, False), (False, 4, 0, 4, True), (True, 0, 0, None, False)]


def test_sharding(docs, plain):
    got = sharding.shard(docs, shards=4).collect()
    assert Counter(r.size for r in got) == Counter(len((t or "").encode()) + 1 for _, t in plain)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    first = sharding.assign(sharding.slot_bytes(sharding.place(sharding.sized(docs), 4)), 4)
    sums = sharding.slot_bytes(sharding.place(sharding.sized(docs), 4))
    old = {r.vslot: r.shard for r in first.collect()}
    new = {r.vslot: r.shard for r in sharding.rebalance(first, sums, 5).collect()}
    assert old.keys() == new.keys() and all(new[k] in (old[k], 4) for k in old) and 4 in new.values()


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    seen = spark.range(37).select(mixing.permuted(F.col("id"), F.lit(37), F.lit("s")).alias("p")).collect()
    assert sorted(r.p for r in seen) == list(range(37))
    made = mixing.mixture(docs)
    assert made.columns == docs.columns and sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in made.collect()) == sum(r.taken for r in got)
    t = spark.createDataFrame([("a", 10), ("b", 1000), (None, 10)], "source string, source_size long")
    assert {r.source: round(r.target, 6) for r in mixing.targets(t).collect()} == {"a": 30.0, "b": 960.0, None: 30.0}


def test_pii(spark, docs):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    last = max(i for i in got if i is not None)
    assert (got[last].n_email, got[last].n_ip, got[last].n_card, got[last].n_phone) == (1, 1, 1, 1)
    t = docs.where(F.col("doc_id") == last).first().text
    want = [f"{k}:{t.index(s)}:{t.index(s) + len(s)}" for k, s in (("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (171) 555-2028"))]
    assert got[last].spans == ",".join(want) and got[last].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where(F.col("doc_id") == last).first().text.endswith("mail me [EMAIL] or [PHONE] at [IP] card [CARD]")
    odd = spark.createDataFrame([(1, "a@b.c_d@e.f 300.1.1.1 001.2.3.4 1.2.3.4.5.6.7.8 4111111111111111 5")], "doc_id long, text string")
    assert pii.find(odd).first().spans == "email:0:5,email:5:11,ip:22:31,ip:32:39,ip:40:47"


def planted():
    """Texts with base spans (to learn from), hidden ones (to find) and numbers that are nothing."""
    rng = random.Random(12)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        for last in "0123456789":
            number = body + last
            if sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(number)))) % 10 == 0:
                return number

    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = {"email": lambda: f"{name()}.{name()}@{name()}.com", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": card, "phone": lambda: f"+1 {digits(3)} 555 {digits(4)}"}
    say = {"email": "write to", "ip": "host", "card": "visa card", "phone": "call"}
    hide = {"email": lambda s: s.replace("@", " (at) "), "ip": lambda s: s.replace(".", " . "), "card": lambda s: "/".join(s[i : i + 4] for i in range(0, 16, 4)), "phone": lambda s: s[3:]}
    rows, hidden = [], {}
    for i in range(1600):
        kind = list(base)[i % 4]
        s = base[kind]()
        head = f"some words here and {say[kind]} "
        if i % 5 == 0:
            shown = hide[kind](s)
            hidden[i] = f"{kind}:{len(head)}:{len(head) + len(shown)}"
        else:
            shown = s
        rows.append((i, f"{head}{shown} and more of it"))
    rows += [(5000 + i, f"the order number {digits(16 if i % 2 else 17)} of {digits(3)} items was filed") for i in range(400)]
    return rows, hidden


def test_pii_hidden_spans(spark):
    """Precision and recall on planted spans that no rule finds, learned from rewritten base spans alone."""
    rows, hidden = planted()
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    added = {r.doc_id: r for r in got if r.n_added}
    right = sum(i in added and hidden[i] in added[i].spans.split(",") for i in hidden)
    assert right >= 0.8 * len(hidden) and right >= 0.97 * len(added)
    assert {hidden[i].split(":")[0] for i in added if i in hidden} == {"email", "ip", "card", "phone"}
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = {i: hidden[i].split(":")[0].upper() for i in hidden}
    assert sum(f"[{kinds[i]}]" in clean[i] for i in hidden) >= 0.8 * len(hidden)


def python_base(text):
    """The contract's patterns as they are written, one by one."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans_on_random_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        parts = [rng.choice([lambda: rng.choice("ab.@-+ ()é"), lambda: str(rng.randint(0, 999)), lambda: "4111 1111-1111 1111", lambda: "a.b@c-d.e", lambda: "1.2.3.4", lambda: "+49 (0) 171.5"])() for _ in range(rng.randint(1, 25))]
        rows.append((i, "".join(parts)))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    for i, t in rows:
        want = python_base(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS], t
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t


def test_mixing_by_walking_the_blocks(spark):
    """Taken words of each document from the slots' blocks, walked in Python; shards are full and their counts drawn."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "c"])) for i in range(150)] + [(None, "no id", None), (7, "again", "a"), (7, "again", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    from tessera.llm.common import numbered

    placed, goal, blocks = mixing._parts(numbered(d))
    times = {(r["source"], r["index"]): len(r["epochs"]) for r in blocks.collect()}
    size = {r.source: r.source_size for r in goal.collect()}
    want = Counter()
    for r in placed.collect():
        n = -(-size[r.source] // mixing.BLOCK) if size[r.source] else 0
        bounds = [i * (size[r.source] // n) + min(i, size[r.source] % n) for i in range(n + 1)] if n else []
        taken = sum(max(0, min(r.start + r.size, bounds[i + 1]) - max(r.start, bounds[i])) * times.get((r.source, i), 0) for i in range(n))
        want[r.doc_id, r.size, taken] += 1
    assert Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(d).collect()) == want
    found = mixing.layout(goal, 16).collect()
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r.source)
    full = [v for k, v in shards.items() if k < max(shards)]
    assert all(len(v) == 16 for v in full) and len({tuple(sorted(Counter(map(str, v)).items())) for v in full}) > 1
    assert len({(r.shard, r.place) for r in found}) == len(found)


def test_sharding_law(docs, plain):
    got = sharding.shard(docs).collect()
    sizes = Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
    texts_ = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in plain)
    assert Counter((r.size, r.text_crc32) for r in got) == texts_


def test_sharding_versions_and_a_hot_group_without_ids(spark, tmp_path):
    rows = [(None, "the same text again and again", i) for i in range(600)] + [(i, f"text {i} " * (i % 7 + 1), i) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = sharding.shard(d).collect()
    bytes_ = Counter()
    for r in got:
        bytes_[r.shard] += r.size
    assert len(got) == len(rows) and max(bytes_.values()) < 1.1 * min(bytes_.values())
    same = {(r.text_crc32, r.size): set() for r in got}
    for r in got:
        same[r.text_crc32, r.size].add(r.shard)
    assert sorted(map(len, same.values()))[-2] == 1  # only the large group is spread
    sums = sharding.slot_bytes(sharding.place(sharding.sized(d))).cache()
    kept = sharding.store(sharding.assign(sums), str(tmp_path / "map"))
    both = sharding.store(sharding.rebalance(kept, sums, 17), str(tmp_path / "map"))
    new = {r.vslot: r.shard for r in sharding.latest(both).collect()}
    old = {r.vslot: r.shard for r in both.where("version = 1").collect()}
    assert {r.version for r in both.collect()} == {1, 2} and new.keys() == old.keys()
    assert all(new[k] in (old[k], 16) for k in old) and 16 in new.values()


def test_fingerprint_is_a_multiset_hash(spark):
    """Equal texts have equal fingerprints, near_next of a copy is 1, of another text below."""
    rows = [(3, "a b c d e f\n" * 20 + "z"), (2, "a b c d e f\n" * 20 + "z"), (1, "p q r s t\n" * 30), (0, None)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].fingerprint == got[2].fingerprint != got[1].fingerprint and got[3].near_next == 1.0 > got[2].near_next


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (bpe.round_trip, fingerprints.fingerprint_edits, simhash.near_duplicates, scoring.score, repeats.remove_repeats, language.identify, sharding.shard, mixing.mix, mixing.mixture, pii.find, pii.redact):
        assert f(none).count() == 0, f
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage again in Python: languages, groups of near copies by all pairs, spans by the patterns, blocks by
    walking the streams, tokens by the tokenizers library."""
    import corpus_pipeline
    from tessera.llm.common import numbered

    rng = random.Random(21)

    def fresh(n):
        return [f"{rng.choice(['thing', 'wort', 'mot'])}{rng.randrange(900)}" for _ in range(n)]

    rows = []
    for i in range(40):
        base = fresh(rng.randint(5, 300))
        rows.append((rng.choice([i, i, None]), " ".join(base), rng.choice(["s1", "s2", None])))
        if i % 4 == 0 and len(base) > 100:
            rows.append((1000 + i, " ".join([*base[:50], "other", *base[51:]]), "s1"))
    rows += [(2000, "write to a.b@c.de or +1 171 555 2028 now", "s2"), (2000, "the same number but another text 10.0.0.1", "s2"), (None, None, "s1"), (2001, "12 34 !", "s1"), (2002, "", None), rows[0], rows[3]]
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "encoding"]
    got = bag(corpus_pipeline.run(spark, str(tmp_path)))

    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r[1].split() for r in left)]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    best = {}
    for r, row in zip(root, left):
        if r not in best or (row[0] is None, row[0] or 0) < (best[r][0] is None, best[r][0] or 0):
            best[r] = row
    clean = []
    for i, text, source in best.values():
        for kind, x, y in sorted(python_base(text), key=lambda s: -s[1]):
            text = text[:x] + f"[{kind.upper()}]" + text[y:]
        clean.append((i, text, source))
    keyed = numbered(spark.createDataFrame(clean, "doc_id long, text string, source string").repartition(2))
    placed, goal, blocks = mixing._parts(keyed)
    place = {(r.doc_id, r.source, r.size, r.text_hash): r for r in placed.collect()}
    hashes = {r.text: r.h for r in keyed.select("text", F.xxhash64("text").alias("h")).collect()}
    epochs = {(r["source"], r["index"]): r["epochs"] for r in blocks.collect()}
    size = {r.source: r.source_size for r in goal.collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, source in clean:
        words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        start = place[i, source, len(words), hashes[text]].start
        n = -(-size[source] // mixing.BLOCK)
        bounds = [k * (size[source] // n) + min(k, size[source] % n) for k in range(n + 1)]
        for epoch in range(3):
            at = [(max(bounds[k], start) - start, min(bounds[k + 1], start + len(words)) - start) for k in range(n) if epoch in epochs.get((source, k), ()) and bounds[k + 1] > start and bounds[k] < start + len(words)]
            if at:
                part = text if sum(y - x for x, y in at) == len(words) else "\n".join("".join(words[x:y]).rstrip(" ") for x, y in at)
                ids = tok.encode(part, add_special_tokens=False).ids
                want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want

    d.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    """A text and a word of over a million bytes, with columns that the operators use themselves."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(1000)) for _ in range(130_000))
    assert len(long) > 1_000_000
    rows = [(1, long, "en", "s", 1, "b", "w", 3), (2, "z" * 1_200_000, "en", "s", 1, "b", "w", 3), (3, "short one", "en", None, 1, "b", "w", 3), (3, "short one", "en", None, 1, "b", "w", 3), (None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, block string, word string, row int").repartition(2)
    for f in (bpe.round_trip, fingerprints.fingerprint_edits, simhash.near_duplicates, scoring.score, repeats.remove_repeats, language.identify, sharding.shard, mixing.mix, pii.find):
        assert f(d).count() == len(rows), f
    for f in (pii.redact, mixing.mixture, simhash.one_of_each):
        assert f(d).columns == d.columns
    assert {r.doc_id: r.text for r in pii.redact(d).collect()}[1] == long
    assert simhash.one_of_each(d).count() == 4


def test_language_fit_ships_no_vocabulary(spark, monkeypatch):
    """A task of the fit takes its worker's table of pieces; the table does not travel with it."""
    rows = [(i, "the house is on the hill" if i % 2 else "das haus steht auf dem berg", "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def refuse(self):
        raise RuntimeError("the table travels")

    monkeypatch.setattr(language.Pieces, "__reduce__", refuse)
    langs, prob = language.fit(docs, public_tokenizers.path(language.VOCABULARY))
    assert langs == ["de", "en"] and abs(prob.sum() - 2) < 1e-6
