"""Streaks and the score on rows small enough to work out by hand."""

import re
from datetime import date

from pyspark.sql import functions as F

from tessera.operators import signals as S
from tessera.plans import signals as plans
from tessera.sources.analogue import BEFORE, CUTOFF, Reports

MONTHS = [date(2001, 4, 30), date(2001, 5, 31), date(2001, 6, 30)]
ROWS = "cnpj string, id string, dt date, fired boolean, evaluable boolean"


def _signal(id: str, weight: int, months: int) -> S.Signal:
    return S.Signal(id, "x", "TRUE", "TRUE", "fixo", 1.0, True, weight, months, True)


def test_streak_counts_back_from_the_cutoff(spark):
    fired = {"all": [True] * 3, "last": [True, False, True], "none": [True, True, False]}
    rows = [("v", k, d, f, True) for k, fs in fired.items() for d, f in zip(MONTHS, fs)]
    got = {r.id: (r.fired, r.streak) for r in S.settled(spark.createDataFrame(rows, ROWS), "2001-06-30").collect()}
    assert got == {"all": (True, 3), "last": (True, 1), "none": (False, 0)}


def test_score_weighs_persistent_among_evaluable(spark):
    signals = [_signal("a", 10, 1), _signal("b", 6, 2), _signal("c", 3, 3), _signal("d", 1, 1)]
    now = {"a": ([False] * 3, True), "b": ([False, True, True], True), "c": ([False, True, True], True), "d": ([False] * 3, False)}
    rows = [("v", k, d, f, can) for k, (fs, can) in now.items() for d, f in zip(MONTHS, fs)]
    row = S.score(S.settled(spark.createDataFrame(rows, ROWS), "2001-06-30"), signals).first()
    assert (row.score, row.coverage, row.n_fired) == (31.58, 75.0, 1)


def test_every_signal_is_specified_once():
    assert len({s.id for s in S.SIGNALS}) == len(S.SIGNALS) == 46


#: Rows of the wide panel on which a signal that the given tables never fire does, each beside one where it does not.
RARE = {
    "QA-04": ({"dc": 5e5, "pr_max": 60.0, "base": 5e5, "inad": 0.0}, {"inad": 1.0}),
    "ES-04": ({"pl": -1.0}, {"pl": 1.0}),
    "CN-03": ({"pl": 2e5, "n_hold": 1.0}, {"n_hold": 3.0}),
    "CN-04": ({"dc": 3e5, "sg_sum": 1e5, "sg_max": 1e5}, {"sg_max": 5e4}),
    "DI-03": ({"dc": 3e5, "pr_max": None}, {"pr_max": 10.0}),
    "PO-07": ({"form": "ABERTO", "pl": 5e4, "liq0": 0.0, "liq30": None}, {"liq0": 5e4}),
}
TEXTS = {"form", "interest", "exclusive", "name"}


def _panel(spark, rows):
    """Wide rows at the cutoff with NULL in every column that is not given."""
    words = {w for s in S.SIGNALS for e in (s.value, s.group, s.material, s.evaluable) for w in re.findall(r"\b[a-z][a-z0-9_]*\b", re.sub(r"'[^']*'", "", e))}
    columns = sorted(words - {"nullif", "coalesce", "abs", "greatest", "least", "ln", "cast", "double", "obs"})
    schema = "cnpj string, dt date, obs boolean, " + ", ".join(f"`{c}` {'string' if c in TEXTS else 'double'}" for c in columns)
    return spark.createDataFrame([(k, MONTHS[-1], True, *[row.get(c) for c in columns]) for k, row in rows.items()], schema)


def test_signals_that_the_tables_never_fire(spark):
    rows = {f"{k}{i}": row if i == 0 else {**row, **change} for k, (row, change) in RARE.items() for i in (0, 1)}
    wide = _panel(spark, rows)
    own = [s for s in S.SIGNALS if s.id in RARE]
    assert len(own) == len(RARE) and all(s.kind != "pct" for s in own)
    found = S.fired(S.long_form(wide, own), S.thresholds(wide, own, "2001-06-30"), own)
    got = {r.cnpj: r.fired for r in found.where("startswith(cnpj, id)").collect()}
    assert got == {k: k.endswith("0") for k in rows}


def test_stakes_of_what_fires(spark):
    assert set(S.STAKES) == {s.id for s in S.SIGNALS}
    wide = _panel(spark, {"a": {"pl": -5.0, "dc": 7.0, "inad": None}, "b": {"pl": 3.0}})
    for c in set(re.findall(r"\b[a-z][a-z0-9_]*\b", " ".join(S.STAKES.values()))) - set(wide.columns) - {"coalesce", "abs", "greatest"}:
        wide = wide.withColumn(c, F.lit(None).cast("double"))
    fired = spark.createDataFrame([("a", "ES-04", True, 1), ("a", "QA-04", True, 1), ("a", "QA-01", True, 1), ("a", "GV-01", False, 0), ("b", "ES-04", False, 0)], "cnpj string, id string, fired boolean, streak int")
    got = {r.cnpj: (r.stake_max, r.stake_sum, r.current) for r in S.stakes(wide, fired, "2001-06-30").collect()}
    assert got == {"a": (7.0, 12.0, MONTHS[-1]), "b": (None, 0.0, None)}


def test_state_is_settled_of_the_long_form(spark):
    wide = _panel(spark, {"a": {"pl": -5.0, "dc": 7.0}, "b": {"pl": 3.0, "name": "x", "measure": 1.0}})
    wide = wide.union(wide.where("cnpj = 'a'").withColumn("dt", F.lit(MONTHS[1]))).union(wide.where("cnpj = 'b'").withColumn("dt", F.lit(MONTHS[1])).withColumn("measure", F.lit(0.0)))
    wide = wide.union(wide.where("cnpj = 'a'").limit(1).withColumn("cnpj", F.lit("gone")).withColumn("dt", F.lit(MONTHS[0])))
    limits = S.thresholds(wide, S.SIGNALS, "2001-06-30")
    long = S.settled(S.fired(S.long_form(wide, S.SIGNALS), limits, S.SIGNALS), "2001-06-30")
    now = S.state(wide, limits, S.SIGNALS, "2001-06-30")
    columns = ["cnpj", "id", "fired", "evaluable", "streak"]
    assert sorted(map(tuple, now.select(columns).collect()), key=str) == sorted(map(tuple, long.select(columns).collect()), key=str)
    assert {(r.cnpj, r.streak) for r in now.where("fired").collect() if r.id in ("ES-04", "GV-04")} == {("a", 2), ("b", 1)}


def test_an_earlier_edition_is_part_of_the_latest(spark):
    """One table of months serves both; the gaps before a vehicle's last report then are not those of now."""
    folder = "/root/testdata/sf0.001"
    r, own = Reports(spark, folder), Reports(spark, folder)
    plans.keep_editions(r, BEFORE, CUTOFF)
    for month in (BEFORE, CUTOFF):
        a, b = plans.kept_wide(r, month), plans.kept_wide(own, month)
        assert a.count() == b.count() > 0
        assert a.select(sorted(b.columns)).exceptAll(b.select(sorted(b.columns))).count() == 0


def test_assignors_take_one_window(spark):
    plan = Reports(spark, "/root/testdata/sf0.001").assignors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
