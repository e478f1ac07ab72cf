"""Personal data in long texts: spans, surroundings, overlaps and redaction against brute force, and time that grows with the text."""

import random
import re
import time

from pyspark.sql import functions as F

from tessera.llm import pii
from tests.llm.test_llm import planted, python_base


def random_text(rng, n):
    say = [
        lambda: str(rng.randint(10**6, 10**9)), lambda: "+49 (0) 171 555 %04d" % rng.randint(0, 9999), lambda: "4111 1111 1111 1111", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)), lambda: "%d . %d . %d . %d" % tuple(rng.randint(0, 255) for _ in range(4)),
        lambda: "a.b@c-d.e", lambda: "ab (at) cd.ef", lambda: "x at y dot z", lambda: "é😀", lambda: "12.34.56.78 90 12 34", lambda: "/".join(str(rng.randint(1000, 9999)) for _ in range(4)),
    ]
    return "".join(rng.choice(say)() + rng.choice([" ", "  ", "; ", "\n", "", " word "]) for _ in range(n))


def brute_proposals(text):
    base = [(a, b) for _, a, b in python_base(text)]
    out = []
    for name, pattern in pii.GENERATORS.items():
        for m in re.finditer(pattern, text):
            a, b = m.span()
            if all(y <= a or b <= x for x, y in base):
                for kind in {"number": ("phone", "card"), "written": ("email",), "loose": ("ip",)}[name]:
                    out.append((kind, a, b, text[a:b], text[max(0, a - 24) : a], text[b : b + 2]))
    return sorted(out)


def test_proposals_with_their_surroundings(spark, monkeypatch):
    rng = random.Random(4)
    texts = [random_text(rng, rng.randint(0, 40)) for _ in range(150)] + [random_text(rng, 1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(4)
    for chunk in (64, 3):
        monkeypatch.setattr(pii, "CHUNK", chunk)
        for r in pii.scan(df, "t").select("id", "__proposed", *[f"__{k}" for k in pii.KINDS]).collect():
            assert sorted(tuple(x) for x in r["__proposed"]) == brute_proposals(texts[r.id]), texts[r.id][:300]
            found = sorted((k, x.start, x.end) for k in pii.KINDS for x in r[f"__{k}"])
            assert found == sorted(python_base(texts[r.id]))


def test_redaction_is_of_the_spans(spark):
    rng = random.Random(5)
    rows, _ = planted()
    rows = [(i, t) for i, t in rows[:900]] + [(5000 + i, random_text(rng, n)) for i, n in enumerate([1, 3, 10, 200, 900, 900])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, t in rows:
        out, at = [], 0
        for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[i].split(",") if s)):
            if a >= at:
                out += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert clean[i] == "".join(out) + t[at:], t[:300]


def test_time_grows_with_the_text(spark):
    rng = random.Random(6)
    text = " ".join(str(rng.randint(10**6, 10**7)) + rng.choice([" x", "; ", " +1 (171) 555-2028 z"]) for _ in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, t string").repartition(1)
    began = time.monotonic()
    row = pii.scan(df, "t").select(F.size("__proposed").alias("n"), F.size("__phone").alias("phones")).first()
    assert row.n > 100_000 and row.phones > 20_000
    assert time.monotonic() - began < 90  # about 15 on an idle machine; it was hours


def test_overlapping_choices_are_settled_by_likelihood(spark):
    """Long chains of overlapping proposals give what a greedy choice over all gives."""
    rng = random.Random(7)
    rows, _ = planted()
    fitted = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = []
    for _ in range(600):
        a = rng.randint(0, 3000)
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(7, 16)))
        spans.append(("phone" if rng.random() < 0.5 else "card", a, a + len(digits), digits, "call ", " x"))
    df = spark.createDataFrame([(spans,)], "__proposed array<struct<kind:string,start:int,end:int,s:string,before:string,after:string>>")
    fed = df.select(F.explode("__proposed").alias("x")).select("x.*")
    model, thresholds = fitted[0], {"phone": 1e-6, "card": 1e-6}
    rated = fed.select("kind", "start", "end", (-pii.probability(model, F.array(*pii.features(*map(F.col, ("kind", "s", "before", "after")))))).alias("p")).collect()
    taken = []
    for p, a, b, kind in sorted((r.p, r.start, r.end, r.kind) for r in rated if r.kind in thresholds and -r.p >= thresholds[r.kind]):
        if all(y <= a or b <= x for _, x, y in taken):
            taken.append((kind, a, b))
    assert taken
    assert sorted(tuple(x) for x in pii.with_added(df, (model, thresholds)).first()["__added"]) == sorted(taken)


def test_fit_reads_all_documents(spark):
    """The rows that the trees and thresholds come from are those of every document."""
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to user"), F.col("id"), F.lit("@example.org today")).alias("text"))
    assert pii.labelled(docs).where("label = 1").count() == 25_000
