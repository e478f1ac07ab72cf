"""Calendar-aligned series over a dense grid of entities and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(df: DataFrame, months: DataFrame) -> DataFrame:
    """A row for each entity and month; ``obs`` tells which were reported. The months are few."""
    grid = df.select("cnpj").distinct().crossJoin(F.broadcast(months.select("dt")))
    return grid.join(df.withColumn("obs", F.lit(True)), ["cnpj", "dt"], "left").withColumn("obs", F.coalesce("obs", F.lit(False)))


def by_month() -> Window:
    return Window.partitionBy("cnpj").orderBy("dt")


def rolling(c: Column, least: int = 10, width: int = 12) -> Column:
    """Sum over the window, scaled up to its full width; NULL with fewer than ``least`` values."""
    w = by_month().rowsBetween(1 - width, 0)
    return F.when(F.count(c).over(w) >= least, F.sum(c).over(w) / F.count(c).over(w) * width)


def rolling_mean(c: Column, least: int = 10, width: int = 12) -> Column:
    w = by_month().rowsBetween(1 - width, 0)
    return F.when(F.count(c).over(w) >= least, F.avg(c).over(w))


def interior_gaps(grid: DataFrame, until: str | None = None) -> DataFrame:
    """Adds gaps: months missed so far between the first and the last report; with ``until`` as they were told then, for the
    months up to it."""
    w = Window.partitionBy("cnpj")
    told = F.col("obs") if until is None else F.col("obs") & (F.col("dt") <= F.lit(until).cast("date"))
    first, last = (f(F.when(told, F.col("dt"))).over(w) for f in (F.min, F.max))
    flagged = grid.withColumn("gap", F.when(~F.col("obs") & (F.col("dt") > first) & (F.col("dt") < last), 1).otherwise(0))
    return flagged.withColumn("gaps", F.sum("gap").over(by_month().rowsBetween(Window.unboundedPreceding, 0)))


def stagnation(grid: DataFrame, value: str) -> DataFrame:
    """Adds same: how many months in a row the value has equalled the month before."""
    w = by_month()
    equal = F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False))
    marked = grid.withColumns({"__eq": equal, "__at": F.row_number().over(w).cast("long")})
    # months since the last that did not equal the one before; the first never does
    last = F.max(F.when(~F.col("__eq"), F.col("__at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("same", F.col("__at") - last).drop("__eq", "__at")


def trailing_streak(fired: DataFrame, keys: list[str]) -> DataFrame:
    """Months in a row up to the last one in which ``fired`` holds: those after the last that does not."""
    w = Window.partitionBy(*keys)
    stop = F.max(F.when(~F.coalesce("fired", F.lit(False)), F.col("dt"))).over(w)
    counted = fired.withColumn("__stop", stop)
    return counted.groupBy(*keys).agg(F.count_if(F.col("__stop").isNull() | (F.col("dt") > F.col("__stop"))).alias("streak"))


def price_index(rates: DataFrame) -> DataFrame:
    """Cumulative product of 1 + rate / 100 over months (few rows)."""
    w = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return rates.withColumn("idx", F.exp(F.sum(F.log1p(F.col("rate") / 100)).over(w)))
