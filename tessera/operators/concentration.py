"""Concentration and coverage measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hhi(df: DataFrame, by: list[str], value: str, clip: bool = False) -> DataFrame:
    """Sum of squared shares, top shares and counts by group. Values of zero or less are left out and
    counted, or with ``clip`` raised to zero."""
    v = F.greatest(F.col(value), F.lit(0.0)) if clip else F.col(value)
    own = df.withColumn("__v", v)
    kept = own if clip else own.where("__v > 0")
    w = Window.partitionBy(*by)
    shared = kept.withColumn("__share", F.col("__v") / F.nullif(F.sum("__v").over(w), F.lit(0.0))).withColumn("__rank", F.row_number().over(w.orderBy(F.desc("__v"), *[c for c in df.columns if c not in by and c != value])))
    measures = shared.groupBy(*by).agg(F.sum(F.col("__share") * F.col("__share")).alias("hhi"), F.max("__share").alias("top1"), F.sum(F.when(F.col("__rank") <= 5, F.col("__share"))).alias("top5"), F.count("*").alias("n"))
    dropped = own.groupBy(*by).agg(F.count_if(F.col("__v") <= 0).alias("n_excluded"))
    return dropped.join(measures, by, "left") if by else dropped.crossJoin(measures)


def partial_ranks(debtors: DataFrame, dc: DataFrame) -> DataFrame:
    """From the largest debtors (cnpj, dt, seq, val) and the full amount (cnpj, dt, dc): shares of the top 1, 5, 10 and
    25 and of the whole list and the floor of the HHI; NULL where the amount is NULL or not positive; lists
    above the amount by 5% are marked, not mended."""
    tops = {k: F.sum(F.when(F.col("seq") <= k, F.col("val"))).alias(f"v{k}") for k in (1, 5, 10, 25)}
    lists = debtors.groupBy("cnpj", "dt").agg(*tops.values(), F.sum("val").alias("list_val"), F.sum(F.col("val") * F.col("val")).alias("sq"))
    j = dc.join(lists, ["cnpj", "dt"], "left")
    ok = F.col("dc") > 0
    return j.select("cnpj", "dt", "dc", "list_val", *[F.when(ok, F.col(f"v{k}") / F.col("dc")).alias(f"top{k}") for k in tops], F.when(ok, F.col("list_val") / F.col("dc")).alias("listed"), F.when(ok, F.col("sq") / (F.col("dc") * F.col("dc"))).alias("hhi_floor"), F.when(ok, F.col("list_val") / F.col("dc") > 1.05).alias("inconsistent"))


def coverage_triple(measured: DataFrame) -> DataFrame:
    """By month: share of vehicles with a list, of the amount of those vehicles, and of the amount that the
    lists explain. LEAST skips NULLs, so vehicles without a list are filtered out first."""
    has = F.col("list_val").isNotNull()
    total = F.nullif(F.sum("dc"), F.lit(0.0))
    return measured.where("dc > 0").groupBy("dt").agg(
        F.round(F.count_if(has) / F.count("*"), 6).alias("cov_vehicles"),
        F.round(F.sum(F.when(has, F.col("dc"))) / total, 6).alias("cov_amount"),
        F.round(F.sum(F.when(has, F.least("list_val", "dc"))) / total, 6).alias("cov_explained"),
    )
