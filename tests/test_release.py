"""Releases, their gates and manifest; snapshots; the gate's comparison."""

import uuid
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators import release as L
from tessera.operators import snapshots as V
from tessera.operators.lineage import shared_folder
from tessera.plans.verifiers import gated


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def numbers(spark, n=5):
    return spark.range(n).select("id", (F.col("id") / 2).alias("half"), F.lit(None).cast("string").alias("none"))


def chain(spark, gate="n_rows = 5 AND total = 10"):
    return [
        L.Stage("last", lambda t: t["double"].union(t["double"]), ("double",)),
        L.Stage("base", lambda t: numbers(spark), checks={"total": "sum(id)"}, gate=gate),
        L.Stage("double", lambda t: t["base"].select((2 * F.col("id")).alias("id")), ("base",)),
    ]


def test_stages_run_in_order_of_need(spark, folder):
    done = L.release(spark, chain(spark), folder, "r1")
    assert done.released
    got = [(r.position, r.stage, r.gate, r.status, r.n_rows, r.checks) for r in done.manifest(spark).orderBy("position").collect()]
    assert got == [(1, "base", True, "OK", 5, '{"total": 10}'), (2, "double", False, "OK", 5, None), (3, "last", False, "OK", 10, None)]
    assert sorted(r.id for r in done.tables["last"].collect()) == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]
    assert spark.read.parquet(f"{folder}/r1/double").count() == 5


@pytest.mark.parametrize("gate", ["n_rows = 4", "total > NULL", "total IS NULL"])
def test_failed_gate_stops_what_comes_after(spark, folder, gate):
    done = L.release(spark, chain(spark, gate), folder, "r1")
    assert not done.released
    assert [(e.stage, e.status, e.n_rows) for e in done.entries] == [("base", "FAILED", 5), ("double", "SKIPPED", None), ("last", "SKIPPED", None)]
    assert spark.read.parquet(f"{folder}/manifest").count() == 3


def test_error_in_a_stage_stops_too(spark, folder):
    stages = [L.Stage("base", lambda t: numbers(spark)), L.Stage("wrong", lambda t: t["base"].select(F.raise_error(F.lit("no such thing")).alias("x")), ("base",)), L.Stage("after", lambda t: numbers(spark))]
    done = L.release(spark, stages, folder, "r1")
    assert [e.status for e in done.entries] == ["OK", "FAILED", "SKIPPED"]
    assert "no such thing" in done.entries[1].error


def test_chains_that_make_no_sense(spark):
    with pytest.raises(ValueError, match="circle"):
        L.ordered([L.Stage("a", None, ("b",)), L.Stage("b", None, ("a",))])
    with pytest.raises(ValueError, match="no stage builds"):
        L.ordered([L.Stage("a", None, ("c",))])
    with pytest.raises(ValueError, match="one name"):
        L.ordered([L.Stage("a", None), L.Stage("a", None)])


def test_content_hash_is_of_the_bag_of_rows(spark):
    def of(df):
        return df.agg(L.content_hash(df)).first()[0]

    df = spark.createDataFrame([(1, "a", 0.1 + 0.2, None), (2, None, float("nan"), [1, 2]), (2, None, 1e300, [])], "k int, s string, x double, l array<int>")
    assert of(df) == of(df.orderBy(F.desc("k")).repartition(3).select("x", "l", "s", "k"))
    assert of(df) == of(df.withColumn("x", F.when(F.col("k") == 1, 0.3).otherwise(F.col("x"))))
    assert len({of(df), of(df.where("k = 1")), of(df.union(df)), of(df.withColumn("s", F.coalesce("s", F.lit("")))), of(df.withColumn("k", F.col("k") + 1))}) == 5
    two = spark.createDataFrame([("a", "bc"), (None, "x")], "p string, q string")
    assert of(two) != of(spark.createDataFrame([("ab", "c"), (None, "x")], "p string, q string"))
    assert of(two) != of(spark.createDataFrame([("a", "bc"), ("x", None)], "p string, q string"))
    assert of(df.limit(0)) == "0"


def test_changes_between_two_releases(spark, folder):
    L.release(spark, [L.Stage("a", lambda t: numbers(spark)), L.Stage("b", lambda t: numbers(spark)), L.Stage("old", lambda t: numbers(spark))], folder, "r1")
    L.release(spark, [L.Stage("a", lambda t: numbers(spark).repartition(2)), L.Stage("b", lambda t: numbers(spark, 6)), L.Stage("new", lambda t: numbers(spark))], folder, "r2")
    assert {(r.stage, r.state) for r in L.changed(spark, folder).collect()} == {("a", "same"), ("b", "changed"), ("old", "gone"), ("new", "new")}


SCHEMA = "id string, cnpj string, streak long"


def test_snapshots_only_grow(spark, folder):
    assert V.runs(spark, folder) == []
    for run, rows in {"2001-03": [("Q", "1", 1)], "2001-05": [("S", "1", 2), ("S", None, 1), ("T", "2", 3)], "2001-04": []}.items():
        V.append(spark.createDataFrame(rows, SCHEMA), folder, run)
    assert V.runs(spark, folder) == ["2001-03", "2001-04", "2001-05"]
    before, now = V.latest_two(spark, folder, SCHEMA)
    assert before.count() == 0 and now.count() == 3
    with pytest.raises(AnalysisException):
        V.append(spark.createDataFrame([("Z", "9", 1)], SCHEMA), folder, "2001-05")
    V.append(spark.createDataFrame([("S", "1", 3), ("S", None, 2), ("U", "2", 1)], SCHEMA), folder, "2001-06")
    before, now = V.latest_two(spark, folder, SCHEMA)
    got = {tuple(r) for r in V.compared(before, now, ["id", "cnpj"]).collect()}
    assert got == {("S", "1", "persisting", 2, 3), ("S", None, "persisting", 1, 2), ("T", "2", "closed", 3, None), ("U", "2", "new", None, 1)}


def test_one_run_is_not_compared(spark, folder):
    V.append(spark.createDataFrame([("S", "1", 2)], SCHEMA), folder, "r")
    with pytest.raises(AnalysisException, match="holds 1 runs"):
        V.latest_two(spark, folder, SCHEMA)


def test_gate_fails_without_a_second_figure(spark):
    published = spark.createDataFrame([("null", None), ("near", 100.0), ("far", 100.0), ("gone", 1.0), ("one", None), ("zero", 0.0)], "indicator string, value double")
    again = spark.createDataFrame([("null", None), ("near", 100.05), ("far", 100.2), ("one", 1.0), ("zero", 0.0)], "indicator string, again double")
    assert {r.indicator: r.status for r in gated(published, again).collect()} == {"null": "OK", "near": "OK", "far": "FAIL", "gone": "FAIL", "one": "FAIL", "zero": "OK"}
