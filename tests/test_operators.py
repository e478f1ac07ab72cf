"""Operators on the micro-tables whose results are known by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.operators import backtest as B
from tessera.operators import concentration as C
from tessera.operators import panel as P
from tessera.operators import timeseries as T


def months(n, year=2025):
    return [dt.date(year + (m + 1) // 12, (m + 1) % 12 + 1, 1) - dt.timedelta(1) for m in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_class_over_fund(spark):
    d = months(1)[0]
    df = spark.createDataFrame([("A", d, "Fundo", 10.0), ("A", d, "Classe", 12.0), ("B", d, "Fundo", 5.0)], "cnpj string, dt date, tp string, pl double")
    assert rows(P.class_over_fund(df)) == [("A", d, "Classe", 12.0), ("B", d, "Fundo", 5.0)]


def test_covered_fund_goes_once(spark):
    d = months(1)[0]
    df = spark.createDataFrame([("F", d, "Fundo", 100.0), ("C1", d, "Classe", 60.0), ("C2", d, "Classe", 40.0)], "cnpj string, dt date, tp string, pl double")
    m = spark.createDataFrame([("C1", "F"), ("C2", "F")], "classe string, fundo string")
    assert P.canonical(df, m).agg(F.sum("pl"), F.count("*")).first()[:] == (100.0, 2)


def test_outlier_needs_both_neighbours(spark):
    m = months(3)
    df = spark.createDataFrame([("X", m[0], 25e6), ("X", m[1], 1.016e11), ("X", m[2], 30e6), ("Y", m[1], 5e9), ("Y", m[2], 1e6)], "cnpj string, dt date, pl double")
    assert [r.cnpj for r in P.outliers(df, 1e9).collect()] == ["X"]
    assert P.sane(df, 1e9).count() == 4


def test_keep_last_and_log(spark):
    df = spark.createDataFrame([("k", 1, 1), ("k", 1, 2), ("k", 2, 3)], "id string, file int, row int")
    assert rows(P.keep_last(df, ["id"], [F.col("file"), F.col("row")])) == [("k", 2, 3)]
    assert rows(P.dedup_log(df, ["id"])) == [(3, 1, 2)]


def test_names_and_ids(spark):
    df = spark.createDataFrame([("1.2",), ("123.456.789-01",), ("123456789012",), ("12.345.678/0001-99",), (None,)], "x string")
    assert [r[0] for r in df.select(N.document_id(F.col("x"))).collect()] == [None, "12345678901", "00123456789012", "12345678000199", None]
    names = spark.createDataFrame([("Subclasse Subordinada Mezanino",), ("Sênior 1",), ("Subclasse Subordinada",), ("Única",), (None,), ("XPTO",)], "x string")
    assert [r[0] for r in names.select(N.tranche(F.col("x"))).collect()] == ["mezanino", "senior", "subordinada", "classe_unica", "nao_informado", "outra"]


def test_absent_is_not_zero(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 0.0), (1.0, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(N.ratio(F.col("n"), F.col("d"))).collect()] == [None, None, 0.5]
    assert df.select(N.number(F.lit("abc"))).first()[0] is None


def test_gaps_stagnation_streak(spark):
    m = months(5)
    df = spark.createDataFrame([("A", m[i], float(i)) for i in (0, 1, 3, 4)], "cnpj string, dt date, pl double")
    grid = T.densify(df, spark.createDataFrame([(x,) for x in m], "dt date"))
    assert [r.gaps for r in T.interior_gaps(grid).orderBy("dt").collect()] == [0, 0, 1, 1, 1]
    flat = spark.createDataFrame([("A", m[i], v) for i, v in enumerate((5.0, 5.0, 5.0, 5.0, 6.0))], "cnpj string, dt date, pl double")
    assert [r.same for r in T.stagnation(flat, "pl").orderBy("dt").collect()] == [0, 1, 2, 3, 0]
    hits = spark.createDataFrame([("A", x, f) for x, f in zip(m, (True, False, True, True, True))], "cnpj string, dt date, fired boolean")
    assert T.trailing_streak(hits, ["cnpj"]).first().streak == 3


@pytest.mark.parametrize(("present", "expected"), [(9, None), (10, 12.0), (12, 12.0)])
def test_rolling(spark, present, expected):
    m = months(12)
    df = spark.createDataFrame([("A", x, 1.0 if i < present else None) for i, x in enumerate(m)], "cnpj string, dt date, v double")
    assert df.withColumn("r", T.rolling(F.col("v"))).orderBy(F.desc("dt")).first().r == expected


def test_debtors(spark):
    d = months(1)[0]
    deb = spark.createDataFrame([("A", d, 1, 50.0), ("A", d, 2, 30.0), ("A", d, 3, 10.0), ("B", d, 1, 110.0), ("Z", d, 1, 1.0)], "cnpj string, dt date, seq int, val double")
    dc = spark.createDataFrame([("A", d, 100.0), ("B", d, 100.0), ("Z", d, 0.0), ("N", d, None), ("L", d, 100.0)], "cnpj string, dt date, dc double")
    got = {r.cnpj: r for r in C.partial_ranks(deb, dc).collect()}
    assert (got["A"].top1, round(got["A"].hhi_floor, 6)) == (0.5, 0.35) and got["B"].inconsistent and got["Z"].top1 is None and got["N"].top1 is None
    triple = C.coverage_triple(C.partial_ranks(deb.where("cnpj = 'A' AND seq = 2"), dc.where("cnpj IN ('A', 'L')"))).first()
    assert (triple.cov_vehicles, triple.cov_amount, triple.cov_explained) == (0.5, 0.5, 0.15)


def test_drift_and_fisher(spark):
    h = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "period int, columns array<string>")
    assert rows(P.header_changes(h)) == [(2, ["c"], ["a"])]
    t = spark.createDataFrame([("s", 16, 42, 34, 176)], "signal string, a long, b long, c long, d long")
    assert B.fisher_tail(t).first().p == 0.0407


def test_log_factorial(spark):
    for n, got in spark.range(0, 3000, 7).select("id", B.log_factorial(F.col("id"))).collect():
        assert abs(got - math.lgamma(n + 1)) <= 1e-9 * max(1.0, math.lgamma(n + 1))


def test_known_events(spark):
    d, e = months(4), "case string, day date, kind string, mark string"
    events = spark.createDataFrame([("A", dt.date(2025, 4, 2), "admin", "bank"), ("N", dt.date(2025, 3, 31), "name", "MULTI"), ("0", dt.date(2025, 1, 1), "name", "X")], e)
    panel = spark.createDataFrame([(c, m, "Fundo", 10.0 + i) for i, c in enumerate("pqrstu") for m in d if (c, m) != ("q", d[2])], "cnpj string, dt date, tp string, pl double")
    registry = spark.createDataFrame([("p", "bank", "one"), ("q", "bank", "two"), ("r", "other", "a Multi fund"), ("s", None, None)], "cnpj string, admin string, name string")
    known = B.linked(events, panel, registry)
    assert rows(known) == sorted([("A", "p", d[3], d[2]), ("N", "r", d[2], d[1])])  # q did not report before the event, no month is before 2025
    own, free = B.of_cases(known, panel)
    assert {r.cnpj for r in free.collect()} == set("qstu") and free.where("case = 'A' AND cnpj = 'q'").isEmpty()
    met = B.matched_without_reuse(own, free)
    assert met.groupBy("case").count().orderBy("case").collect() == [("A", 3), ("N", 3)]
    B.check_contamination(known, met)
    with pytest.raises(ValueError):
        B.check_contamination(known, met.withColumn("control", F.lit("p")))


def test_rates_by_case(spark):
    detail = spark.createDataFrame([("K", "positive", "a", 2, True, None), ("K", "positive", "a", 1, False, None), ("K", "positive", "b", 0, None, None), ("K", "control", "c", 3, False, True)], "case string, grp string, cnpj string, ahead int, s1 boolean, s2 boolean")
    rates = B.case_rates(detail, ["s1", "s2"])
    assert rows(rates) == sorted([("K", "s1", "positive", 1, 1, 1, 1.0, 0.5, 2.0), ("K", "s1", "control", 1, 0, 0, 0.0, 1.0, None), ("K", "s2", "control", 1, 1, 0, 1.0, 1.0, 3.0)], key=repr)
    assert rows(B.case_contrast(rates)) == [("K", "s1", None, 0.5)]


def test_layouts_and_numbers(spark):
    old = spark.createDataFrame([("12.345", "1.5")], "CNPJ_FUNDO string, VL string")
    assert N.legacy_keys(old).first().asDict() == {"CNPJ_FUNDO_CLASSE": "12.345", "VL": "1.5", "TP_FUNDO_CLASSE": "Fundo", "CNPJ": "12345"}
    new = spark.createDataFrame([("12.345", "Classe", "x")], "CNPJ_FUNDO_CLASSE string, TP_FUNDO_CLASSE string, VL string")
    got = N.numeric(N.legacy_keys(new), ["VL", "OTHER"]).first()
    assert (got.TP_FUNDO_CLASSE, got.VL, got.OTHER) == ("Classe", None, None)


def test_controls_without_reuse(spark):
    """What serving the positives one after another gives."""
    import hashlib
    import random

    rng = random.Random(4)
    pos = [(1, f"p{i:02d}", rng.choice("AB"), rng.uniform(10, 60)) for i in range(12)]
    cand = [(f"c{i:02d}", rng.choice("AB"), rng.uniform(5, 90)) for i in range(25)] + [("c90", "A", 0.0), ("c91", "B", None)]
    used, want = set(), []
    for case, p, tp, pl in sorted(pos, key=lambda x: x[1]):
        order = sorted((hashlib.md5(f"{c}{case}".encode()).hexdigest(), c) for c, t, v in cand if t == tp and v is not None and 0.5 * pl <= v <= 2 * pl)
        take = [c for _, c in order if c not in used][:3]
        used |= set(take)
        want += [(case, p, c, k + 1) for k, c in enumerate(take)]
    positives = spark.createDataFrame(pos, "case int, cnpj string, tp string, pl double")
    candidates = spark.createDataFrame(cand, "cnpj string, tp string, pl double")
    assert rows(B.matched_without_reuse(positives, candidates)) == sorted(want, key=repr)
    reuse = rows(B.matched_controls(positives, candidates))
    assert len(reuse) >= len(want) and {r[:2] for r in reuse} >= {r[:2] for r in want}


def test_controls_of_crowded_types(spark):
    """Every positive wants the same controls: no round for each of them, and the same rows in blocks of positives; no pair is laid out that cannot be chosen."""
    import hashlib
    import random
    import time

    rng = random.Random(5)
    pos = [(1, f"p{i:04d}", "A", rng.choice((0.0, 16.0, 31.9, rng.uniform(10, 60)))) for i in range(400)]
    cand = [(f"c{i:04d}", "A", rng.choice((0.0, 8.0, 32.0, 64.0, rng.uniform(4, 130)))) for i in range(1500)] + [p[1:] for p in pos[:200]]
    order = sorted((hashlib.md5(f"{c}1".encode()).hexdigest(), c, v) for c, _, v in cand)
    used, want, reuse = set(), [], []
    for _, p, _, pl in pos:
        fit = [c for _, c, v in order if 0.5 * pl <= v <= 2 * pl and c != p]
        take = [c for c in fit if c not in used][:3]
        used |= set(take)
        want += [(1, p, c, k + 1) for k, c in enumerate(take)]
        reuse += [(1, p, c, k + 1) for k, c in enumerate(fit[:3])]
    positives = spark.createDataFrame(pos, "case int, cnpj string, tp string, pl double")
    candidates = spark.createDataFrame(cand, "cnpj string, tp string, pl double")
    began = time.time()
    assert rows(B.matched_without_reuse(positives, candidates)) == sorted(want, key=repr)
    assert time.time() - began < 60  # a round for each positive took minutes
    assert rows(B.matched_without_reuse(positives, candidates, block=150)) == sorted(want, key=repr)
    assert rows(B.matched_controls(positives, candidates)) == sorted(reuse, key=repr)


def test_debtor_quantiles_hold_the_values_once(spark):
    from tessera.plans.market import debtor_summary_quantiles
    from tessera.sources.analogue import Reports

    df = debtor_summary_quantiles(Reports(spark, "/root/testdata/sf0.001"))
    aggregate = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "percentile" in x)
    assert aggregate.count("percentile(") == 1
    rows = {r.measure: r for r in df.collect()}
    assert len(rows) == 6 and all(r.p25 <= r.med <= r.p75 <= r.p90 <= r.most for r in rows.values())
