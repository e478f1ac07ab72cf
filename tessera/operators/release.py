"""A release: stages that build tables one from another, gates that stop it, and the manifest of what was done.

A stage gives a DataFrame, which is written to the release's folder and read again by the stages after it, so that nothing is
computed twice and a lost executor costs a task. While it is written, the same pass measures it: its rows, a
content hash that does not depend on the order of rows or files, and the stage's own checks. A gate is a condition
on these measures. The first stage that fails, by its gate or by an error, ends the release: what comes after it is skipped.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import shared_folder

OK, FAILED, SKIPPED = "OK", "FAILED", "SKIPPED"


@dataclass(frozen=True)
class Stage:
    """``build`` takes the tables of the stages named in ``after``, by name. ``checks`` are aggregate expressions
    over the table; ``gate`` is a condition over ``n_rows`` and the checks."""

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    gate: str | None = None


@dataclass(frozen=True)
class Entry:
    """What the manifest says of a stage."""

    run: str
    position: int
    stage: str
    gate: bool
    status: str
    n_rows: int | None
    content_hash: str | None
    checks: str | None
    seconds: float | None
    error: str | None
    path: str | None


MANIFEST = "run string, position int, stage string, gate boolean, status string, n_rows long, content_hash string, checks string, seconds double, error string, path string"


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value as text: fractions with six decimals, bytes in hexadecimal, anything nested as JSON; null as a mark of its own."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        fixed = F.round(c, 6).try_cast("decimal(38,6)").cast("string")
        c = F.when(F.isnan(c) | (F.abs(c) >= 1e31), c.cast("string")).otherwise(fixed)
    elif isinstance(kind, T.BinaryType):
        c = F.hex(c)
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        c = F.to_json(c)
    elif isinstance(kind, T.MapType):
        c = F.to_json(F.array_sort(F.map_entries(c)))
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def content_hash(df: DataFrame) -> Column:
    """An aggregate: the sum of the rows' hashes (60 bits of MD5 over all columns by name). Equal for equal bags of rows."""
    columns = sorted(df.schema.fields, key=lambda f: f.name)
    text = F.concat(*[canonical(F.col(f"`{f.name}`"), f.dataType) for f in columns])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string")


def ordered(stages: list[Stage]) -> list[Stage]:
    """The stages so that each comes after those it needs, else as given."""
    names = [s.name for s in stages]
    if len(set(names)) < len(names):
        raise ValueError("two stages have one name")
    for s in stages:
        if unknown := set(s.after) - set(names):
            raise ValueError(f"{s.name} needs {sorted(unknown)}, which no stage builds")
    out: list[Stage] = []
    while len(out) < len(stages):
        done = {s.name for s in out}
        ready = [s for s in stages if s.name not in done and done.issuperset(s.after)]
        if not ready:
            raise ValueError("stages need each other in a circle")
        out.append(ready[0])
    return out


@dataclass
class Release:
    run: str
    folder: str
    entries: list[Entry]
    tables: dict[str, DataFrame]

    @property
    def released(self) -> bool:
        return all(e.status == OK for e in self.entries)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """A row for each stage."""
        return spark.createDataFrame([tuple(vars(e).values()) for e in self.entries], MANIFEST)


def _built(stage: Stage, tables: dict[str, DataFrame], path: str) -> tuple[DataFrame, dict]:
    """The stage's table, written and measured in one pass."""
    df = stage.build({n: tables[n] for n in stage.after})
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("n_rows"), content_hash(df).alias("content_hash"), *[F.expr(e).alias(n) for n, e in stage.checks.items()]]
    df.observe(seen, *measures).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _holds(spark: SparkSession, gate: str, found: dict) -> bool:
    """Whether the gate's condition is true of what was measured; null is not."""
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in found.items()])
    return bool(row.select(F.coalesce(F.expr(gate), F.lit(False)).alias("x")).first()["x"])


def release(spark: SparkSession, stages: list[Stage], folder: str | None = None, run: str | None = None) -> Release:
    """Runs the stages in order and appends the manifest to ``<folder>/manifest``. The folder is by default one in that of
    spark.checkpoint.dir; ``run`` names the release (default: its time and a random end) and its folder, which must be new."""
    run = run or f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    folder = folder or f"{shared_folder(spark)}/releases"
    done = Release(run, folder, [], {})
    stopped = False
    for position, stage in enumerate(ordered(stages), 1):
        path = f"{folder}/{run}/{stage.name}"
        gate = stage.gate is not None
        if stopped:
            done.entries.append(Entry(run, position, stage.name, gate, SKIPPED, None, None, None, None, None, None))
            continue
        began, found, error = time.monotonic(), {}, None
        try:
            table, found = _built(stage, done.tables, path)
            passed = stage.gate is None or _holds(spark, stage.gate, found)
            done.tables[stage.name] = table
        except PySparkException as e:  # what Spark reports of a stage; an error in the stage's own code is raised
            passed, error = False, str(e)[:2000]
        stopped = not passed
        checks = json.dumps({n: found[n] for n in stage.checks if n in found}, default=str, sort_keys=True) if stage.checks else None
        done.entries.append(Entry(run, position, stage.name, gate, OK if passed else FAILED, found.get("n_rows"), found.get("content_hash"), checks, round(time.monotonic() - began, 3), error, path if stage.name in done.tables else None))
    done.manifest(spark).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return done


def changed(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of the latest two runs of a folder's manifest: (stage, before, now, state), state being same, changed, new or gone
    by their content."""
    entries = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(F.col("status") == OK)
    runs = entries.select("run").distinct().orderBy(F.desc("run")).limit(2).collect()  # two names
    now, before = ([r.run for r in runs] + [None, None])[:2]
    a = entries.where(F.col("run") == F.lit(before)).select("stage", F.col("content_hash").alias("before"))
    b = entries.where(F.col("run") == F.lit(now)).select("stage", F.col("content_hash").alias("now"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("before") == F.col("now"), "same").otherwise("changed")
    return a.join(b, "stage", "full").select("stage", "before", "now", state.alias("state"))
