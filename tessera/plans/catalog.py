"""The catalogue of lenses, and smaller operators that no other plan shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.analogue import CUTOFF, PARTIAL, Reports
from .market import DEBTORS_SQL, debtor_metrics
from .panel import MANAGERS_SQL, managers
from .register import plan


def _at(df: DataFrame) -> DataFrame:
    return df.where(F.col("dt") == F.lit(CUTOFF).cast("date"))


#: What each lens shows and what it does not mean; lenses 7 and 9 are curated lists that a user brings.
LENSES = {
    1: ("value under management", "not assets of the manager"), 2: ("value under administration", "not a credit risk of the administrator"), 3: ("portfolio exposure", "not a loss"), 4: ("assignor", "not the final debtor"), 5: ("debtor concentration", "lists are cut, so a floor"),
    6: ("unit-holder", "not who bears a loss first"), 7: ("corporate dependence", "not a census"), 8: ("operational", "not a failure of the provider"), 9: ("judicial", "not a conviction"),
}
_TEXT = ", ".join(f"({k}, '{n}', '{d}')" for k, (n, d) in LENSES.items())


@plan(f"""@{MANAGERS_SQL}, {DEBTORS_SQL[1:]}, names(lens, measure, does_not_mean) AS (VALUES {_TEXT}), c AS (SELECT cnpj, dt, sum(pr) AS pr FROM assignors WHERE pos<=3 GROUP BY 1,2),
vals AS (SELECT 1 AS lens, sum(pl) FILTER (gestor IS NOT NULL) AS numerator, sum(pl) AS denominator FROM sane LEFT JOIN managers USING (cnpj) WHERE dt='{CUTOFF}' UNION ALL SELECT 2, sum(pl) FILTER (admin IS NOT NULL), sum(pl) FROM sane LEFT JOIN registry USING (cnpj) WHERE dt='{CUTOFF}'
UNION ALL SELECT 3, sum(coalesce(dc_risk,0)+coalesce(dc_norisk,0)), sum(pl) FROM sane JOIN assets USING (cnpj, dt) WHERE dt='{CUTOFF}' AND pl>0 UNION ALL SELECT 4, sum(v_tot*least(pr,100)/100) FILTER (pr IS NOT NULL), sum(v_tot) FROM assets LEFT JOIN c USING (cnpj, dt) WHERE dt='{CUTOFF}'
UNION ALL SELECT 5, sum(least(list_val,dc)) FILTER (list_val IS NOT NULL), sum(dc) FROM dm WHERE dt='{CUTOFF}' AND dc>0 UNION ALL SELECT 6, sum(coalesce(v_sen,0)+coalesce(v_mez,0)+coalesce(v_sub,0)), sum(v_tot) FROM assets WHERE dt='{CUTOFF}' UNION ALL SELECT 8, sum(pl) FILTER (region IS NOT NULL), sum(pl) FROM sane LEFT JOIN registry USING (cnpj) WHERE dt='{CUTOFF}')
SELECT lens, measure, does_not_mean, round(numerator,2) AS numerator, round(denominator,2) AS denominator, round(numerator/nullif(denominator,0),6) AS coverage FROM names LEFT JOIN vals USING (lens)""")
def lens_catalog(r: Reports) -> DataFrame:
    """Numerator, denominator and coverage of each lens; NULL where the list is curated."""
    r.keep("sane")
    month = r.only(CUTOFF)
    z = F.lit(0.0)
    now = _at(r.sane)
    roles = now.join(r.registry.select("cnpj", "admin", "region"), "cnpj", "left").join(managers(r).select("cnpj", "gestor"), "cnpj", "left")
    listed = month.assignors.where("pos <= 3").groupBy("cnpj", "dt").agg(F.sum("pr").alias("pr"))

    def of(lens: int, df: DataFrame, numerator, denominator) -> DataFrame:
        return df.agg(F.lit(lens).alias("lens"), F.sum(numerator).alias("numerator"), F.sum(denominator).alias("denominator"))

    def known(c: str):
        return F.when(F.col(c).isNotNull(), F.col("pl"))

    assets = month.assets
    debt = debtor_metrics(month).where("dc > 0")
    parts = [
        of(1, roles, known("gestor"), F.col("pl")), of(2, roles, known("admin"), F.col("pl")), of(8, roles, known("region"), F.col("pl")),
        of(3, now.where("pl > 0").join(month.assets, ["cnpj", "dt"]), F.coalesce("dc_risk", z) + F.coalesce("dc_norisk", z), F.col("pl")),
        of(4, assets.join(listed, ["cnpj", "dt"], "left"), F.when(F.col("pr").isNotNull(), F.col("v_tot") * F.least("pr", F.lit(100.0)) / 100), F.col("v_tot")),
        of(5, debt, F.when(F.col("list_val").isNotNull(), F.least("list_val", "dc")), F.col("dc")),
        of(6, assets, F.coalesce("v_sen", z) + F.coalesce("v_mez", z) + F.coalesce("v_sub", z), F.col("v_tot")),
    ]
    vals = parts[0]
    for p in parts[1:]:
        vals = vals.unionByName(p)
    names = r.spark.createDataFrame([(k, n, d) for k, (n, d) in LENSES.items()], "lens int, measure string, does_not_mean string")
    return names.join(vals, "lens", "left").select("lens", "measure", "does_not_mean", F.round("numerator", 2).alias("numerator"), F.round("denominator", 2).alias("denominator"), F.round(F.col("numerator") / F.nullif("denominator", z), 6).alias("coverage"))


@plan("SELECT dt, round(avg(b90+b360+b1080),6) AS strict_mean, round(avg(coalesce(b90,0)+coalesce(b360,0)+coalesce(b1080,0)),6) AS lenient_mean FROM overdue GROUP BY 1")
def mean_of_sums(r: Reports) -> DataFrame:
    """A mean of sums where an absent part makes the sum absent, beside the one that reads it as zero."""
    parts = [F.col(c) for c in ("b90", "b360", "b1080")]
    return r.overdue.groupBy("dt").agg(F.round(F.avg(N.strict_sum(*parts)), 6).alias("strict_mean"), F.round(F.avg(N.lenient_sum(*parts)), 6).alias("lenient_mean"))


@plan("@f AS (SELECT cnpj, ced, min(dt) AS first FROM assignors WHERE pos=1 GROUP BY 1,2) SELECT cnpj, string_agg(ced, ',' ORDER BY first) AS leaders FROM f GROUP BY 1")
def ordered_distinct_list(r: Reports) -> DataFrame:
    """A vehicle's largest assignors in the order in which they came to lead, each once."""
    lead = r.assignors.where("pos = 1").groupBy("cnpj").agg(F.sort_array(F.collect_list(F.struct("dt", "ced"))).alias("x"))
    return lead.select("cnpj", F.array_join(F.array_distinct(F.transform("x", lambda y: y["ced"])), ",").alias("leaders"))


@plan("SELECT s_suppkey, regexp_replace(s_name,'\\D','','g') AS cnpj, CASE WHEN s_suppkey%2=0 THEN 'Fundo' ELSE 'Classe' END AS tp, TRY_CAST(s_name AS DOUBLE) AS label, TRY_CAST(cast(s_acctbal AS varchar) AS DOUBLE) AS bal, cast(NULL AS DOUBLE) AS missing FROM supplier", base=False)
def legacy_layout(r: Reports) -> DataFrame:
    """Two generations of a layout under one set of names, texts as numbers; what is no number or no column is NULL."""
    s = r.table("supplier").select("s_suppkey", "s_name", F.col("s_name").alias("label"), F.col("s_acctbal").cast("string").alias("bal"))
    old = s.where("s_suppkey % 2 = 0").withColumnRenamed("s_name", "CNPJ_FUNDO")
    new = s.where("s_suppkey % 2 <> 0").withColumnRenamed("s_name", "CNPJ_FUNDO_CLASSE").withColumn("TP_FUNDO_CLASSE", F.lit("Classe"))
    both = N.numeric(N.legacy_keys(old).unionByName(N.legacy_keys(new)), ["label", "bal", "missing"])
    return both.select("s_suppkey", F.col("CNPJ").alias("cnpj"), F.col("TP_FUNDO_CLASSE").alias("tp"), "label", "bal", "missing")


_TRACKS = "ta AS (SELECT ced, 'A' AS track, count(DISTINCT cnpj) AS n FROM assignors WHERE ced IN (SELECT p_brand FROM part WHERE p_size=1) GROUP BY 1), tb AS (SELECT ced, 'B' AS track, count(DISTINCT cnpj) AS n FROM assignors WHERE ced LIKE '%3' GROUP BY 1)"


@plan("@" + _TRACKS + " SELECT ced, track, n FROM (SELECT * FROM ta UNION ALL SELECT * FROM tb) QUALIFY row_number() OVER (PARTITION BY ced ORDER BY CASE track WHEN 'B' THEN 0 ELSE 1 END)=1")
def two_track_match(r: Reports) -> DataFrame:
    """Assignors matched by an exact key from a list (track A) and by their own mark (track B); B wins."""
    marked = r.table("part").where("p_size = 1").select(F.col("p_brand").alias("ced")).distinct()
    a = r.assignors.join(marked, "ced", "left_semi").groupBy("ced").agg(F.lit("A").alias("track"), F.count_distinct("cnpj").alias("n"))
    b = r.assignors.where("ced LIKE '%3'").groupBy("ced").agg(F.lit("B").alias("track"), F.count_distinct("cnpj").alias("n"))
    w = Window.partitionBy("ced").orderBy(F.when(F.col("track") == "B", 0).otherwise(1))
    return a.unionByName(b).withColumn("k", F.row_number().over(w)).where("k = 1").select("ced", "track", "n")


@plan(f"SELECT count(*) AS n, round(median(rate),6) AS median, round(quantile_cont(rate,0.25),6) AS p25, round(quantile_cont(rate,0.75),6) AS p75, round(avg(rate),6) AS mean FROM (SELECT cnpj, sum(v*tax)/nullif(sum(v),0) AS rate FROM lines WHERE dt='{CUTOFF}' GROUP BY 1)")
def rates_summary(r: Reports) -> DataFrame:
    rate = _at(r.lines).groupBy("cnpj").agg((F.sum(F.col("v") * F.col("tax")) / F.nullif(F.sum("v"), F.lit(0.0))).alias("rate"))
    return rate.agg(F.count("*").alias("n"), *[F.round(F.percentile("rate", q), 6).alias(k) for k, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))], F.round(F.avg("rate"), 6).alias("mean"))


@plan("SELECT dt, count(*) FILTER (v_sub>0) AS n_with, round(sum(v_sub),2) AS collateral, round(sum(v_sub)/nullif(sum(v_tot),0),6) AS share FROM assets GROUP BY 1")
def collateral_summary(r: Reports) -> DataFrame:
    return r.assets.groupBy("dt").agg(F.count_if(F.col("v_sub") > 0).alias("n_with"), F.round(F.sum("v_sub"), 2).alias("collateral"), F.round(F.sum("v_sub") / F.nullif(F.sum("v_tot"), F.lit(0.0)), 6).alias("share"))


@plan(f"@x AS (SELECT s.dt, s.cnpj, pl FROM sane s WHERE NOT EXISTS (SELECT 1 FROM sane b WHERE b.cnpj=s.cnpj AND b.dt>s.dt)) SELECT dt, count(*) AS n, round(sum(pl),2) AS pl, round(sum(pl*pl)/nullif(sum(pl)*sum(pl),0),6) AS hhi, count(*) FILTER (bal<0) AS n_negative, count(*) FILTER (bal IS NULL) AS n_unknown FROM x LEFT JOIN registry USING (cnpj) WHERE dt<'{PARTIAL}' GROUP BY 1")
def absent_concentration(r: Reports) -> DataFrame:
    """Vehicles by the month of their last report: their value, how concentrated it is, and what the registry says."""
    last = r.sane.groupBy("cnpj").agg(F.max_by(F.struct("dt", "pl"), "dt").alias("x")).select("cnpj", "x.dt", "x.pl").where(F.col("dt") < F.lit(PARTIAL).cast("date"))
    j = last.join(r.registry, "cnpj", "left")
    return j.groupBy("dt").agg(F.count("*").alias("n"), F.round(F.sum("pl"), 2).alias("pl"), F.round(F.sum(F.col("pl") * F.col("pl")) / F.nullif(F.sum("pl") * F.sum("pl"), F.lit(0.0)), 6).alias("hhi"), F.count_if(F.col("bal") < 0).alias("n_negative"), F.count_if(F.col("bal").isNull()).alias("n_unknown"))
