"""Views of one vehicle and of one company, from all tables that tell of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import signals as S
from ..operators.lineage import cut
from ..sources.analogue import CUTOFF, Reports
from . import signals
from .register import plan

#: Vehicles and companies shown, signals of a vehicle, vehicles of a company.
VEHICLES, COMPANIES, SIGNALS, TOP = 400, 60, 12, 5


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


_BAND = "CASE WHEN coverage<50 OR score IS NULL THEN 'not classifiable' WHEN score>=p99 AND score>0 THEN 'high' WHEN score>=p90 AND score>0 THEN 'medium' WHEN score>0 THEN 'low' ELSE 'none' END"


@plan(signals.WIDE_SQL + f""", cutl AS (SELECT l.*, o_custkey AS deb, ship - cast(o_orderdate AS date) AS late FROM lines l LEFT JOIN orders ON l_orderkey=o_orderkey WHERE dt='{CUTOFF}'),
xa AS (SELECT cnpj, round(sum(v),2) AS dc, round(sum(v) FILTER (flag='R'),2) AS dc_norisk, sum(v) FILTER (flag IN ('A','R')) AS v_low, sum(v) AS whole, sum(v) FILTER (late>0) AS overdue, sum(v) FILTER (late IS NOT NULL) AS dated FROM cutl GROUP BY 1),
xd AS (SELECT cnpj, max(val) AS top, count(*) AS n_debtors FROM (SELECT cnpj, deb, sum(v) AS val FROM cutl WHERE deb IS NOT NULL GROUP BY 1,2) GROUP BY 1),
xc AS (SELECT cnpj, max(pr) AS top_share, count(*) AS n_assignors, string_agg(ced || ':' || pos, '; ' ORDER BY pos) AS assignors FROM assignors WHERE dt='{CUTOFF}' AND pr>0 AND pr<=100 GROUP BY 1),
xs AS (SELECT cnpj, list(id ORDER BY weight DESC, id)[1:{SIGNALS}] AS signals FROM {signals.ACTIVE_SQL} JOIN ids USING (id) GROUP BY 1),
xb AS (SELECT cnpj, score, coverage, n_fired, {_BAND} AS band FROM sc CROSS JOIN (SELECT quantile_cont(score,0.9) AS p90, quantile_cont(score,0.99) AS p99 FROM sc WHERE coverage>=50 AND score>0))
SELECT s.cnpj, name, admin, gestor, region, interest, tp, pl, dc, dc_norisk, round(CASE WHEN dated>0 THEN coalesce(overdue,0)/dated END,6) AS overdue_share, round(CASE WHEN whole>0 THEN coalesce(v_low,0)/whole END,6) AS subordination, round(CASE WHEN dc>0 THEN top/dc END,6) AS top_debtor, n_debtors, top_share AS top_assignor, n_assignors, assignors, coalesce(signals,[]) AS signals, coverage, score, n_fired, band
FROM sane s LEFT JOIN registry USING (cnpj) LEFT JOIN xa USING (cnpj) LEFT JOIN xd USING (cnpj) LEFT JOIN xc USING (cnpj) LEFT JOIN xs USING (cnpj) LEFT JOIN xb USING (cnpj) WHERE s.dt='{CUTOFF}' ORDER BY pl DESC, s.cnpj LIMIT {VEHICLES}""")
def vehicle_xray(r: Reports) -> DataFrame:
    """The largest vehicles with all that the cutoff's tables tell of each: its roles, amounts, overdue and subordinated shares, debtors and assignors,
    its signals from the gravest on, and how far it can be judged: with too little data it is not classifiable, whatever fires."""
    r.keep("sane")
    month = r.only(CUTOFF)
    by = ["cnpj"]
    # all that is taken from the lines lies by vehicle, so that one shuffle serves the aggregations and their joins
    own = month.late.select("cnpj", "v", "flag", "deb", "late").repartition(*by)
    every = month.lines.select("cnpj", "v", "flag").repartition(*by)
    amounts = every.groupBy(*by).agg(F.round(F.sum("v"), 2).alias("dc"), F.round(F.sum(F.when(F.col("flag") == "R", F.col("v"))), 2).alias("dc_norisk"), F.sum(F.when(F.col("flag").isin("A", "R"), F.col("v"))).alias("v_low"), F.sum("v").alias("whole"))
    debtor = own.groupBy("cnpj", "deb").agg(F.sum("v").alias("val"), F.sum(F.when(F.col("late") > 0, F.col("v"))).alias("overdue"))
    debts = debtor.groupBy(*by).agg(F.max("val").alias("top"), F.count("*").alias("n_debtors"), F.sum("overdue").alias("overdue"), F.sum("val").alias("dated"))
    listed = month.assignors.where("pr > 0 AND pr <= 100").groupBy(*by).agg(F.max("pr").alias("top_assignor"), F.count("*").alias("n_assignors"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ced"))), lambda x: F.concat(x["ced"], F.lit(":"), x["pos"].cast("string"))), "; ").alias("assignors"))
    settled = cut(signals.settled_signals(r))
    weight = F.create_map(*[x for s in S.SIGNALS for x in (F.lit(s.id), F.lit(s.weight))])
    gravest = F.slice(F.sort_array(F.collect_list(F.when(F.col("fired"), F.struct((-weight[F.col("id")]).alias("w"), "id")))), 1, SIGNALS)  # of a vehicle's 46 at most
    active = settled.groupBy(*by).agg(F.transform(gravest, lambda x: x["id"]).alias("signals"))
    score = S.score(settled, S.SIGNALS)
    judged = S.bands(score).join(score.select("cnpj", "n_fired"), "cnpj")
    j = month.sane.where(F.col("dt") == F.lit(CUTOFF).cast("date")).select("cnpj", "tp", "pl").join(r.registry, "cnpj", "left")
    for t in (amounts, debts, listed, active, judged):
        j = j.join(t, "cnpj", "left")
    z = F.lit(0.0)
    j = j.orderBy(F.desc("pl"), "cnpj").limit(VEHICLES)
    shares = [F.round(x, 6).alias(n) for n, x in (("overdue_share", _ratio(F.coalesce("overdue", z), F.col("dated"))), ("subordination", _ratio(F.coalesce("v_low", z), F.col("whole"))), ("top_debtor", _ratio(F.col("top"), F.col("dc"))))]
    return j.select("cnpj", "name", "admin", "gestor", "region", "interest", "tp", "pl", "dc", "dc_norisk", *shares, "n_debtors", "top_assignor", "n_assignors", "assignors", F.coalesce("signals", F.array().cast("array<string>")).alias("signals"), "coverage", "score", "n_fired", "band")


@plan(f"""@own AS (SELECT a.*, s.name, t.v_tot FROM assignors a JOIN sane p ON p.cnpj=a.cnpj AND p.dt=a.dt LEFT JOIN registry s ON s.cnpj=a.cnpj LEFT JOIN assets t ON t.cnpj=a.cnpj AND t.dt=a.dt WHERE a.dt='{CUTOFF}' AND pr>0 AND pr<=100),
co AS (SELECT ced, round(sum(pr/100*v_tot),2) AS exposure, count(*) AS n_vehicles, round(max(pr),6) AS top_share FROM own GROUP BY 1),
rec AS (SELECT ced, count(DISTINCT dt) AS n_months, min(dt) AS first_month, max(dt) AS last_month FROM assignors WHERE pr>0 AND pr<=100 GROUP BY 1),
jud AS (SELECT ced, string_agg(event || ' (' || cast(dt AS varchar) || ')', '; ' ORDER BY event) AS judicial FROM (SELECT ced, 'list' AS event, min(dt) AS dt FROM assignors WHERE ced IN (SELECT p_brand FROM part WHERE p_size=1) GROUP BY 1 UNION ALL SELECT ced, 'name', min(dt) FROM assignors WHERE ced LIKE '%3' GROUP BY 1) GROUP BY 1),
five AS (SELECT ced, string_agg(coalesce(name,'?') || ' (' || cast(cast(round(pr) AS bigint) AS varchar) || '%)', '; ' ORDER BY pr DESC, cnpj) AS vehicles FROM (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY ced ORDER BY pr DESC, cnpj)<={TOP}) GROUP BY 1)
SELECT ced, exposure, n_vehicles, top_share, n_months, first_month, last_month, judicial, ced IN (SELECT p_brand FROM part WHERE p_size>48) AS holder, vehicles FROM co LEFT JOIN rec USING (ced) LEFT JOIN jud USING (ced) LEFT JOIN five USING (ced) ORDER BY exposure DESC, ced LIMIT {COMPANIES}""")
def company_xray(r: Reports) -> DataFrame:
    """The companies with the largest exposure as assignors: how often and since when they recur, what proceedings mark them, whether they hold
    units themselves, and the five vehicles in which they weigh most. No company's vehicles are gathered: the five are cut before they travel."""
    month = r.only(CUTOFF)
    now = month.assignors.where("pr > 0 AND pr <= 100").join(month.sane.select("cnpj", "dt"), ["cnpj", "dt"])
    own = now.join(month.assets.select("cnpj", "dt", "v_tot"), ["cnpj", "dt"], "left").join(r.registry.select("cnpj", "name"), "cnpj", "left")
    company = own.groupBy("ced").agg(F.round(F.sum(F.col("pr") / 100 * F.col("v_tot")), 2).alias("exposure"), F.count("*").alias("n_vehicles"), F.round(F.max("pr"), 6).alias("top_share"))
    shown = company.orderBy(F.desc("exposure"), "ced").limit(COMPANIES)
    # first and last months of each assignor, and of those whose name tells of a proceeding
    past = r.assignors.groupBy("ced", "dt").agg(F.max((F.col("pr") > 0) & (F.col("pr") <= 100)).alias("told")).groupBy("ced").agg(F.count_if("told").alias("n_months"), F.min(F.when(F.col("told"), F.col("dt"))).alias("first_month"), F.max(F.when(F.col("told"), F.col("dt"))).alias("last_month"), F.min("dt").alias("seen"))
    part = r.table("part").groupBy(F.col("p_brand").alias("ced")).agg(F.max(F.col("p_size") == 1).alias("on_list"), F.max(F.col("p_size") > 48).alias("holder"))
    by_share = Window.partitionBy("ced").orderBy(F.desc("pr"), "cnpj")
    five = own.withColumn("k", F.row_number().over(by_share)).where(F.col("k") <= TOP)
    told = F.concat(F.coalesce("name", F.lit("?")), F.lit(" ("), F.round("pr").cast("bigint").cast("string"), F.lit("%)"))
    vehicles = five.groupBy("ced").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", told.alias("t")))), lambda x: x["t"]), "; ").alias("vehicles"))
    j = shown.join(past, "ced", "left").join(part, "ced", "left").join(vehicles, "ced", "left")
    since = F.concat(F.lit(" ("), F.col("seen").cast("string"), F.lit(")"))
    marks = F.concat_ws("; ", F.when(F.col("on_list"), F.concat(F.lit("list"), since)), F.when(F.col("ced").like("%3"), F.concat(F.lit("name"), since)))
    return j.select("ced", "exposure", "n_vehicles", "top_share", "n_months", "first_month", "last_month", F.when(marks != "", marks).alias("judicial"), F.coalesce("holder", F.lit(False)).alias("holder"), "vehicles")
