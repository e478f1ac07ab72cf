"""Claims with two figures each, and tables compiled for readers: chosen columns, few rows, declared units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key of a column's unit in its metadata.
UNIT = "unit"


@dataclass(frozen=True)
class Claim:
    """Something said in print: ``key`` names the figure that it rests on; None for what is said from a source without figures."""

    id: str
    subject: str
    unit: str
    period: str
    confidence: str
    key: str | None


def book(spark: SparkSession, claims: list[Claim], published: DataFrame, again: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Each claim with its published figure (key, value), the one found anew (key, again), their relative divergence and a status: OK up to
    ``tolerance``, DIVERGES beyond it, MISSING where one of the two is, CURATED for claims without figures."""
    rows = spark.createDataFrame([(c.id, c.subject, c.unit, c.period, c.confidence, c.key) for c in claims], "claim string, subject string, unit string, period string, confidence string, key string")
    j = rows.join(published, "key", "left").join(again, "key", "left")
    gap = F.abs(F.col("value") - F.col("again"))
    divergence = F.when(gap == 0, 0.0).otherwise(gap / F.nullif(F.greatest(F.abs("value"), F.abs("again")), F.lit(0.0)))
    status = F.when(F.col("key").isNull(), "CURATED").when(F.col("value").isNull() | F.col("again").isNull(), "MISSING").when(divergence <= tolerance, "OK").otherwise("DIVERGES")
    return j.select("claim", "subject", "unit", "period", "confidence", "value", "again", divergence.alias("divergence"), status.alias("status"))


def check_book(found: DataFrame) -> None:
    """Stops the run if a claim diverges or lacks a figure."""
    wrong = [r.claim for r in found.where("status IN ('DIVERGES', 'MISSING')").select("claim").orderBy("claim").limit(20).collect()]
    if wrong:
        raise ValueError(f"claims that do not hold: {', '.join(wrong)}")


def figures(df: DataFrame, found: dict[str, str], value: str) -> DataFrame:
    """(key, value) rows from aggregate expressions over ``df``, in one aggregation."""
    row = df.agg(*[F.expr(e).cast("double").alias(k) for k, e in found.items()])
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias(value)) for k in found])
    return row.select(F.explode(each).alias("x")).select("x.*")


def document(c: Column) -> Column:
    """An identifier as text of 14 digits: never a number, no decimal part, zeros in front."""
    return F.lpad(F.regexp_replace(c.cast("string"), r"\.0$", ""), 14, "0")


def compiled(df: DataFrame, columns: dict[str, str], order: list[Column], limit: int = 25) -> DataFrame:
    """The columns that there are, in the order of ``columns`` (name: unit), of the first ``limit`` rows. A column's unit travels in its metadata,
    through selections and limits; columns with the unit ``id`` become identifiers. ``order`` must be total."""
    top = df.orderBy(*order).limit(limit)
    there = [c for c in columns if c in df.columns]
    return top.select(*[(document(F.col(c)) if columns[c] == "id" else F.col(c)).alias(c, metadata={UNIT: columns[c]}) for c in there])


def units(df: DataFrame) -> dict[str, str]:
    """The units of a table's columns; ``auto`` where none is declared."""
    return {f.name: f.metadata.get(UNIT, "auto") for f in df.schema.fields}


def described(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, unit) of compiled tables, by their schemas."""
    rows = [(t, i, c, u) for t, df in tables.items() for i, (c, u) in enumerate(units(df).items())]
    return spark.createDataFrame(rows, "`table` string, position int, `column` string, unit string")
