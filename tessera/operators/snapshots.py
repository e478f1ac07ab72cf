"""Versioned snapshots of what a run publishes, and what changed between the latest two.

Snapshots only grow: a run's rows go to a partition of its own, named by the run, and are never written again. Names of runs sort in their order
(dates, times or numbers of one width)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW, KEPT, CLOSED = "new", "persisting", "closed"


def append(rows: DataFrame, folder: str, run: str) -> None:
    """Adds a run's rows; a run that is already there is an error, and stays as it is. A run without rows is kept as one."""
    rows.write.mode("error").parquet(f"{folder}/run={run}")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, run string").parquet(folder)


def runs(spark: SparkSession, folder: str) -> list[str]:
    """The runs of a folder, oldest first: by their partitions' names, no rows are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
    return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))


def latest_two(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the run before the latest and of the latest. Fewer than two runs are an error."""
    found = runs(spark, folder)
    if len(found) < 2:
        raise AnalysisException(f"{folder} holds {len(found)} runs; two are compared")
    every = _read(spark, folder, schema)
    before, now = (every.where(F.col("run") == F.lit(r)).drop("run") for r in found[-2:])
    return before, now


def compared(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, state, and every other column as <name>_before and <name>_now): new, persisting or closed. Keys are
    unique in each; null keys equal each other."""
    own = [c for c in now.columns if c not in keys]

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{k}{suffix}") for k in keys], *[F.col(c).alias(f"{c}{suffix}") for c in own], F.lit(True).alias(f"__in{suffix}"))

    a, b = side(before, "_before"), side(now, "_now")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{k}_before").eqNullSafe(F.col(f"{k}_now"))
    state = F.when(F.col("__in_before").isNull(), NEW).when(F.col("__in_now").isNull(), CLOSED).otherwise(KEPT)
    joined = a.join(b, on, "full")
    return joined.select(*[F.coalesce(f"{k}_now", f"{k}_before").alias(k) for k in keys], state.alias("state"), *[x for c in own for x in (f"{c}_before", f"{c}_now")])
