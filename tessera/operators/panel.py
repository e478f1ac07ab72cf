"""The canonical panel: one row for each vehicle and month, from reports that repeat and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order``; make the order total, or ties fall at random."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_log(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows read, rows kept and rows removed by keep_last."""
    sizes = df.groupBy(*keys).count()
    return sizes.agg(F.sum("count").alias("rows_read"), F.count("*").alias("rows_kept"), (F.sum("count") - F.count("*")).alias("rows_removed"))


def class_over_fund(pl: DataFrame) -> DataFrame:
    """Where one id reports as fund and as class in a month, the class row stands."""
    w = Window.partitionBy("cnpj", "dt").orderBy(F.when(F.col("tp") == "Classe", 0).otherwise(1))
    return pl.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def drop_covered_funds(panel: DataFrame, class_map: DataFrame) -> DataFrame:
    """Funds of which a class reports in the month go. The map has one fund for each class; classes meet their fund
    in a window, so that nothing fans out and the panel is computed once."""
    fund = class_map.select(F.col("classe").alias("cnpj"), F.col("fundo").alias("__fund"))
    is_class = F.col("tp") == "Classe"
    met = panel.join(fund, "cnpj", "left").withColumn("__of", F.when(is_class & F.col("__fund").isNotNull(), F.col("__fund")).otherwise(F.col("cnpj")))
    covered = F.max(is_class & F.col("__fund").isNotNull()).over(Window.partitionBy("__of", "dt"))
    return met.withColumn("__covered", covered).where((F.col("tp") != "Fundo") | ~F.col("__covered")).drop("__fund", "__of", "__covered")


def canonical(pl: DataFrame, class_map: DataFrame) -> DataFrame:
    return drop_covered_funds(class_over_fund(pl), class_map)


def near(panel: DataFrame) -> DataFrame:
    """Adds prev and next, the values of the reports before and after."""
    w = Window.partitionBy("cnpj").orderBy("dt")
    return panel.withColumn("prev", F.lag("pl").over(w)).withColumn("next", F.lead("pl").over(w))


def is_outlier(floor: float, times: float = 20.0) -> Column:
    """Above ``floor`` and above ``times`` both neighbours, both present."""
    return F.coalesce((F.col("pl") > floor) & F.col("prev").isNotNull() & F.col("next").isNotNull() & (F.col("pl") > times * F.greatest("prev", "next")), F.lit(False))


def outliers(panel: DataFrame, floor: float, times: float = 20.0) -> DataFrame:
    return near(panel).where(is_outlier(floor, times))


def sane(panel: DataFrame, floor: float, times: float = 20.0) -> DataFrame:
    return near(panel).where(~is_outlier(floor, times)).drop("prev", "next")


def unpivot_pairs(df: DataFrame, keys: list[str], ids: str, shares: str, n: int) -> DataFrame:
    """Numbered pairs of columns (ids_1, shares_1) .. to rows (keys, pos, id, share); missing pairs are left out."""
    pairs = [F.struct(F.lit(i).alias("pos"), F.col(f"{ids}_{i}").alias("id"), F.col(f"{shares}_{i}").alias("share")) for i in range(1, n + 1) if f"{ids}_{i}" in df.columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("x")).select(*keys, "x.*").where("id IS NOT NULL OR share IS NOT NULL")


def field_coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """Share of rows with a value, for each column, in one pass."""
    counts = df.agg(F.count("*").alias("__all"), *[F.count(c).alias(c) for c in names])
    flat = counts.unpivot(["__all"], names, "field", "filled")
    return flat.select("field", "filled", F.col("__all").alias("total"), F.round(F.col("filled") / F.expr("nullif(__all, 0)"), 6).alias("coverage"))


def header_changes(headers: DataFrame) -> DataFrame:
    """From rows (period, columns array): the columns added and removed since the period before."""
    w = Window.orderBy("period")
    prev = F.lag("columns").over(w)
    return headers.select("period", F.array_except("columns", prev).alias("added"), F.array_except(prev, F.col("columns")).alias("removed"), prev.isNotNull().alias("seen")).where("seen").drop("seen")
