"""Red flags over the panel, each with its own limits, and what they add up to.

RF1 hardly anything overdue beside one large assignor, RF2 rolled amounts against the mean portfolio, RF3 few holders of
a single interest with little subordination, RF4 a fall by half, RF5 growth on one assignor, RF6 a name. Limits fit
the derived tables' amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeseries as T
from ..sources.analogue import CUTOFF, M12, Reports
from .panel import MANAGERS_SQL, managers
from .register import plan

#: The twelve months up to the cutoff.
_YEAR = f"dt>'{M12}' AND dt<='{CUTOFF}'"


def _at(df: DataFrame, month: str = CUTOFF) -> DataFrame:
    return df.where(F.col("dt") == F.lit(month).cast("date"))


def _year(df: DataFrame) -> DataFrame:
    return df.where((F.col("dt") > F.lit(M12).cast("date")) & (F.col("dt") <= F.lit(CUTOFF).cast("date")))


_RF = f"""@rf1 AS (SELECT v.cnpj FROM (SELECT cnpj, inad FROM overdue WHERE dt='{CUTOFF}') v FULL JOIN (SELECT cnpj, max(pr) AS pr FROM assignors WHERE dt='{CUTOFF}' GROUP BY 1) c ON v.cnpj=c.cnpj WHERE coalesce(inad<1,true) AND coalesce(pr>=50,false) AND v.cnpj IS NOT NULL),
neg AS (SELECT cnpj, sum(coalesce(v_roll,0)) AS roll_12m, avg(coalesce(dc_risk,0)+coalesce(dc_norisk,0)) AS dc_mean FROM assets WHERE {_YEAR} GROUP BY 1),
rf2 AS (SELECT s.cnpj, pl, roll_12m, dc_mean, roll_12m/nullif(dc_mean,0) AS ratio FROM sane s JOIN neg USING (cnpj) WHERE s.dt='{CUTOFF}' AND dc_mean>5e4 AND roll_12m/nullif(dc_mean,0)>0.15),
hold AS (SELECT cnpj, count(*) AS n_hold FROM debtors WHERE dt='{CUTOFF}' GROUP BY 1),
rf3 AS (SELECT s.cnpj, pl, n_hold, interest, (coalesce(v_sub,0)+coalesce(v_mez,0))/nullif(v_tot,0) AS subord FROM sane s JOIN registry USING (cnpj) JOIN hold USING (cnpj) LEFT JOIN assets a ON a.cnpj=s.cnpj AND a.dt=s.dt WHERE s.dt='{CUTOFF}' AND pl>1e4 AND n_hold<=2 AND interest='S' AND coalesce((coalesce(v_sub,0)+coalesce(v_mez,0))/nullif(v_tot,0),0)<0.05),
rf4 AS (SELECT cnpj, dt, prev, pl, pl/prev-1 AS fall FROM (SELECT *, lag(pl) OVER (PARTITION BY cnpj ORDER BY dt) AS prev FROM sane) WHERE {_YEAR} AND prev>5e4 AND pl/prev-1<-0.5),
rf5 AS (SELECT p.cnpj, h.pl AS pl_12m, p.pl, p.pl/h.pl-1 AS growth, pr_max FROM sane p JOIN sane h ON h.cnpj=p.cnpj AND h.dt='{M12}' JOIN (SELECT cnpj, max(pr) AS pr_max FROM assignors WHERE dt='{CUTOFF}' AND pr BETWEEN 0 AND 100 GROUP BY 1) t ON t.cnpj=p.cnpj WHERE p.dt='{CUTOFF}' AND p.pl>5e4 AND h.pl>1e4 AND p.pl/h.pl-1>0.5 AND pr_max>=20),
flagged AS (SELECT DISTINCT rf, cnpj FROM (SELECT 'RF1' AS rf, cnpj FROM rf1 UNION ALL SELECT 'RF2', cnpj FROM rf2 UNION ALL SELECT 'RF3', cnpj FROM rf3 UNION ALL SELECT 'RF4', cnpj FROM rf4 UNION ALL SELECT 'RF5', cnpj FROM rf5))"""


def _rf2(r: Reports) -> DataFrame:
    z = F.lit(0.0)
    neg = _year(r.assets).groupBy("cnpj").agg(F.sum(F.coalesce("v_roll", z)).alias("roll_12m"), F.avg(F.coalesce("dc_risk", z) + F.coalesce("dc_norisk", z)).alias("dc_mean"))
    j = _at(r.sane).join(neg, "cnpj").withColumn("ratio", F.col("roll_12m") / F.nullif("dc_mean", z))
    return j.where("dc_mean > 5e4 AND ratio > 0.15").select("cnpj", "pl", "roll_12m", "dc_mean", "ratio")


def _rf3(r: Reports) -> DataFrame:
    z = F.lit(0.0)
    hold = _at(r.debtors).groupBy("cnpj").agg(F.count("*").alias("n_hold"))
    j = _at(r.sane).join(r.registry, "cnpj").join(hold, "cnpj").join(_at(r.assets).drop("dt"), "cnpj", "left")
    j = j.withColumn("subord", (F.coalesce("v_sub", z) + F.coalesce("v_mez", z)) / F.nullif("v_tot", z))
    return j.where("pl > 1e4 AND n_hold <= 2 AND interest = 'S' AND coalesce(subord, 0) < 0.05").select("cnpj", "pl", "n_hold", "interest", "subord")


def _rf4(r: Reports) -> DataFrame:
    x = r.sane.withColumn("prev", F.lag("pl").over(T.by_month())).withColumn("fall", F.col("pl") / F.col("prev") - 1)
    return _year(x).where("prev > 5e4 AND fall < -0.5").select("cnpj", "dt", "prev", "pl", "fall")


def _rf5(r: Reports) -> DataFrame:
    top = _at(r.assignors).where("pr BETWEEN 0 AND 100").groupBy("cnpj").agg(F.max("pr").alias("pr_max"))
    before = _at(r.sane, M12).select("cnpj", F.col("pl").alias("pl_12m"))
    j = _at(r.sane).join(before, "cnpj").join(top, "cnpj").withColumn("growth", F.col("pl") / F.col("pl_12m") - 1)
    return j.where("pl > 5e4 AND pl_12m > 1e4 AND growth > 0.5 AND pr_max >= 20").select("cnpj", "pl_12m", "pl", "growth", "pr_max")


def _rf1(r: Reports) -> DataFrame:
    v = _at(r.overdue).select("cnpj", "inad")
    c = _at(r.assignors).groupBy("cnpj").agg(F.max("pr").alias("pr"))
    return v.join(c, "cnpj").where("coalesce(inad < 1, true) AND pr >= 50").select("cnpj")


def _flagged(r: Reports) -> DataFrame:
    """(rf, cnpj), each once."""
    r.keep("sane", "assignors")
    found = {"RF1": _rf1, "RF2": _rf2, "RF3": _rf3, "RF4": _rf4, "RF5": _rf5}
    every = [f(r).select(F.lit(k).alias("rf"), "cnpj") for k, f in found.items()]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out.distinct()


@plan(_RF + " SELECT cnpj, pl, round(roll_12m,2) AS roll_12m, round(dc_mean,4) AS dc_mean, round(ratio,6) AS ratio FROM rf2")
def rf2_rollover(r: Reports) -> DataFrame:
    return _rf2(r).select("cnpj", "pl", *[F.round(c, n).alias(c) for c, n in (("roll_12m", 2), ("dc_mean", 4), ("ratio", 6))])


@plan(_RF + " SELECT cnpj, pl, n_hold, interest, round(subord,6) AS subord FROM rf3")
def rf3_single_interest(r: Reports) -> DataFrame:
    return _rf3(r).withColumn("subord", F.round("subord", 6))


@plan(_RF + " SELECT cnpj, dt, prev, pl, round(fall,6) AS fall FROM rf4")
def rf4_fall_year(r: Reports) -> DataFrame:
    return _rf4(r).withColumn("fall", F.round("fall", 6))


@plan(_RF + " SELECT cnpj, pl_12m, pl, round(growth,6) AS growth, pr_max FROM rf5")
def rf5_growth_on_one_assignor(r: Reports) -> DataFrame:
    return _rf5(r).withColumn("growth", F.round("growth", 6))


@plan(_RF + " SELECT rf, count(*) AS n FROM flagged GROUP BY 1")
def rf_counts(r: Reports) -> DataFrame:
    return _flagged(r).groupBy("rf").agg(F.count("*").alias("n"))


@plan(_RF + f", {MANAGERS_SQL}, nf AS (SELECT cnpj, count(*) AS n_flags FROM flagged GROUP BY 1) SELECT gestor, round(sum(pl),2) AS pl_total, round(coalesce(sum(pl) FILTER (n_flags IS NOT NULL),0),2) AS pl_flagged, count(n_flags) AS n_flagged, count(DISTINCT cnpj) AS n_vehicles, round(coalesce(sum(pl) FILTER (n_flags IS NOT NULL),0)/nullif(sum(pl),0),6) AS share FROM sane JOIN managers USING (cnpj) LEFT JOIN nf USING (cnpj) WHERE dt='{CUTOFF}' GROUP BY 1 HAVING count(n_flags)>0")
def rf_rollup_managers(r: Reports) -> DataFrame:
    n = _flagged(r).groupBy("cnpj").agg(F.count("*").alias("n_flags"))
    j = _at(r.sane).join(managers(r), "cnpj").join(n, "cnpj", "left")
    flagged = F.coalesce(F.sum(F.when(F.col("n_flags").isNotNull(), F.col("pl"))), F.lit(0.0))
    g = j.groupBy("gestor").agg(F.round(F.sum("pl"), 2).alias("pl_total"), F.round(flagged, 2).alias("pl_flagged"), F.count("n_flags").alias("n_flagged"), F.count_distinct("cnpj").alias("n_vehicles"), F.round(flagged / F.nullif(F.sum("pl"), F.lit(0.0)), 6).alias("share"))
    return g.where("n_flagged > 0")


_HELD = f", held AS (SELECT o_custkey AS holder, cnpj, v, CASE ln%3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' END AS linked FROM lines JOIN orders ON l_orderkey=o_orderkey WHERE dt='{CUTOFF}' AND cnpj IN (SELECT cnpj FROM flagged))"


def _held(r: Reports) -> DataFrame:
    held = _at(r.late).join(_flagged(r).select("cnpj").distinct(), "cnpj", "left_semi")
    return held.select(F.col("deb").alias("holder"), "cnpj", "v", "ln", F.when(F.col("ln") % 3 == 0, "S").when(F.col("ln") % 3 == 1, "N").alias("linked"))


@plan(_RF + _HELD + " SELECT holder, round(sum(v),2) AS amount, count(DISTINCT cnpj) AS n_flagged, count(*) FILTER (linked='S') AS n_linked FROM held GROUP BY 1")
def rf_rollup_holders(r: Reports) -> DataFrame:
    return _held(r).groupBy("holder").agg(F.round(F.sum("v"), 2).alias("amount"), F.count_distinct("cnpj").alias("n_flagged"), F.count_if(F.col("linked") == "S").alias("n_linked"))


@plan(_RF + _HELD + " SELECT round(sum(v),2) AS amount, round(coalesce(sum(v) FILTER (linked='S'),0)/greatest(sum(v),1),6) AS linked_share, count(DISTINCT holder) AS n_holders, count(DISTINCT cnpj) AS n_vehicles FROM held")
def rf_rollup_summary(r: Reports) -> DataFrame:
    linked = F.coalesce(F.sum(F.when(F.col("linked") == "S", F.col("v"))), F.lit(0.0))
    return _held(r).agg(F.round(F.sum("v"), 2).alias("amount"), F.round(linked / F.greatest(F.sum("v"), F.lit(1.0)), 6).alias("linked_share"), F.count_distinct("holder").alias("n_holders"), F.count_distinct("cnpj").alias("n_vehicles"))


@plan(_RF + f", prof AS (SELECT c_mktsegment AS segment, CASE WHEN ln<=3 THEN 'senior' ELSE 'subordinada' END AS tranche, count(DISTINCT o_custkey) AS n FROM lines JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE dt='{CUTOFF}' AND cnpj IN (SELECT cnpj FROM flagged) GROUP BY 1,2) SELECT segment, tranche, n FROM prof")
def rf_rollup_investor_profile(r: Reports) -> DataFrame:
    c = r.table("customer").select(F.col("c_custkey").alias("holder"), F.col("c_mktsegment").alias("segment"))
    tranche = F.when(F.col("ln") <= 3, "senior").otherwise("subordinada")
    return _held(r).join(c, "holder").groupBy("segment", tranche.alias("tranche")).agg(F.count_distinct("holder").alias("n"))


@plan(f"SELECT dt, round(sum(pl),2) AS pl, count(*) AS n FROM sane JOIN registry USING (cnpj) WHERE admin=(SELECT min(admin) FROM registry) AND dt>='{M12}' GROUP BY 1")
def rf_one_admin_series(r: Reports) -> DataFrame:
    first = r.registry.agg(F.min("admin").alias("admin"))
    own = r.sane.where(F.col("dt") >= F.lit(M12).cast("date")).join(r.registry, "cnpj").join(F.broadcast(first), "admin")
    return own.groupBy("dt").agg(F.round(F.sum("pl"), 2).alias("pl"), F.count("*").alias("n"))
