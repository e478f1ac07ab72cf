"""Market series, rankings, lenses and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import ratio
from ..operators import concentration as C
from ..operators.timeseries import price_index
from ..sources.analogue import CUTOFF, M12, M36, M60, Reports
from .panel import FLOWS_SQL, MANAGERS_SQL, flows, managers
from .register import plan


def _at(df: DataFrame, month: str = CUTOFF) -> DataFrame:
    return df.where(F.col("dt") == F.lit(month).cast("date"))


def _share(c: str):
    """Share of the total; for aggregated tables of few rows, as its window has one partition."""
    return F.round(F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy()), F.lit(0.0)), 6)


_SERIES_SQL = """SELECT s.dt, count(*) AS n, count(*) FILTER (tp='Fundo') AS n_fund, count(*) FILTER (tp='Classe') AS n_class, round(sum(pl),2) AS pl, round(sum(dc_risk),2) AS dc_risk,
round(sum(dc_norisk),2) AS dc_norisk, round(sum(inad),2) AS inad, count(inad) AS n_inad FROM sane s LEFT JOIN assets a USING (cnpj, dt) LEFT JOIN overdue o USING (cnpj, dt) GROUP BY 1"""


@plan(_SERIES_SQL)
def market_series(r: Reports) -> DataFrame:
    j = r.sane.join(r.assets, ["cnpj", "dt"], "left").join(r.overdue, ["cnpj", "dt"], "left")
    return j.groupBy("dt").agg(F.count("*").alias("n"), F.count_if(F.col("tp") == "Fundo").alias("n_fund"), F.count_if(F.col("tp") == "Classe").alias("n_class"), *[F.round(F.sum(c), 2).alias(c) for c in ("pl", "dc_risk", "dc_norisk", "inad")], F.count("inad").alias("n_inad"))


INDEX_SQL = "@every AS (SELECT DISTINCT dt FROM lines), rates AS (SELECT dt, ((year(dt)*12+month(dt))*37 % 11)/10.0 AS rate FROM every), idx AS (SELECT dt, exp(sum(ln(1+rate/100)) OVER (ORDER BY dt)) AS idx FROM rates)"


def price_levels(r: Reports) -> DataFrame:
    months = r.lines.select("dt").distinct()
    return price_index(months.withColumn("rate", ((F.year("dt") * 12 + F.month("dt")) * 37 % 11) / 10.0))


@plan(INDEX_SQL + f""", hd AS (SELECT cnpj, dt, count(*) AS n_hold FROM debtors GROUP BY 1,2), ci AS (SELECT cnpj, dt, round(sum(v) FILTER (ln BETWEEN 5 AND 6),2) AS circular FROM lines GROUP BY 1,2),
m AS (SELECT s.dt, count(*) AS n, count(*) FILTER (tp='Classe') AS n_class, count(*) FILTER (tp='Fundo') AS n_fund, sum(pl) AS pl, sum(dc_risk) AS dc_risk, sum(dc_norisk) AS dc_norisk, sum(circular) AS circular, count(circular) AS n_circular, sum(pl) FILTER (bal>5000) AS pl_exclusive, sum(pl) FILTER (interest='S') AS pl_single, sum(inad) AS inad, count(inad) AS n_inad, sum(n_hold) AS n_holders
 FROM sane s LEFT JOIN assets USING (cnpj, dt) LEFT JOIN overdue USING (cnpj, dt) LEFT JOIN ci USING (cnpj, dt) LEFT JOIN hd USING (cnpj, dt) LEFT JOIN registry USING (cnpj) GROUP BY 1)
SELECT m.dt, n, n_class, n_fund, round(pl,2) AS pl, round(dc_risk,2) AS dc_risk, round(dc_norisk,2) AS dc_norisk, round(circular,2) AS circular, n_circular, round(pl-circular,2) AS pl_net, round(pl_exclusive,2) AS pl_exclusive, round(pl_single,2) AS pl_single, round(inad,2) AS inad, n_inad, n_holders, round(pl*(SELECT idx FROM idx WHERE dt='{CUTOFF}')/idx.idx,2) AS pl_real FROM m JOIN idx ON m.dt=idx.dt""")
def market_series_whole(r: Reports) -> DataFrame:
    """The market by month with all its columns: what is held inside the universe and how many tell of it, exclusive vehicles and those of a single interest,
    holders, and the value in money of the cutoff. Amounts, bands and debtors come from one shuffle of the lines with their orders."""
    orders = r._orders()
    lines = r.lines.join(orders, "l_orderkey", "left").withColumn("late", F.datediff("ship", "ordered"))
    band = r.bands()["inad"]

    def of(c: str, *flags: str):
        return F.sum(F.when(F.col("flag").isin(*flags), F.col("v"))).alias(c)

    debtor = lines.groupBy("cnpj", "dt", "deb").agg(of("risk", "N", "A"), of("norisk", "R"), F.sum(F.when(F.col("ln").between(5, 6), F.col("v"))).alias("circ"), F.sum(band).alias("late_v"))
    month = debtor.groupBy("cnpj", "dt").agg(*[F.round(F.sum(a), 2).alias(b) for a, b in (("risk", "dc_risk"), ("norisk", "dc_norisk"), ("circ", "circular"), ("late_v", "inad"))], F.least(F.count("deb"), F.lit(25)).alias("n_hold"))
    j = r.sane.join(month, ["cnpj", "dt"], "left").join(r.registry.select("cnpj", "bal", "interest"), "cnpj", "left")
    g = j.groupBy("dt").agg(
        F.count("*").alias("n"), F.count_if(F.col("tp") == "Classe").alias("n_class"), F.count_if(F.col("tp") == "Fundo").alias("n_fund"), *[F.sum(c).alias(c) for c in ("pl", "dc_risk", "dc_norisk", "circular", "inad")], F.count("circular").alias("n_circular"), F.count("inad").alias("n_inad"),
        F.sum(F.when(F.col("bal") > 5000, F.col("pl"))).alias("pl_exclusive"), F.sum(F.when(F.col("interest") == "S", F.col("pl"))).alias("pl_single"), F.sum("n_hold").alias("n_holders"),
    )
    idx = price_levels(r)
    base = idx.where(F.col("dt") == F.lit(CUTOFF).cast("date")).select(F.col("idx").alias("base"))
    j = g.join(F.broadcast(idx), "dt").crossJoin(F.broadcast(base))
    money = {"pl": F.col("pl"), "dc_risk": F.col("dc_risk"), "dc_norisk": F.col("dc_norisk"), "circular": F.col("circular"), "pl_net": F.col("pl") - F.col("circular"), "pl_exclusive": F.col("pl_exclusive"), "pl_single": F.col("pl_single"), "inad": F.col("inad"), "pl_real": F.col("pl") * F.col("base") / F.col("idx")}
    return j.select("dt", "n", "n_class", "n_fund", "n_circular", "n_inad", "n_holders", *[F.round(c, 2).alias(k) for k, c in money.items()])


@plan(INDEX_SQL + " SELECT dt, round(rate,2) AS rate, round(idx.idx,8) AS idx FROM idx JOIN rates USING (dt)")
def cumulative_index(r: Reports) -> DataFrame:
    return price_levels(r).select("dt", F.round("rate", 2).alias("rate"), F.round("idx", 8).alias("idx"))


@plan(INDEX_SQL + ", s AS (SELECT dt, sum(pl) AS pl FROM sane GROUP BY 1) SELECT s.dt, round(pl,2) AS pl, round(pl/idx.idx*(SELECT idx FROM idx ORDER BY dt DESC LIMIT 1),2) AS real_pl FROM s JOIN idx ON s.dt=idx.dt")
def market_series_deflated(r: Reports) -> DataFrame:
    idx = price_levels(r)
    last = idx.agg(F.max_by("idx", "dt").alias("base"))
    return r.sane.groupBy("dt").agg(F.sum("pl").alias("pl")).join(F.broadcast(idx), "dt").crossJoin(F.broadcast(last)).select("dt", F.round("pl", 2).alias("pl"), F.round(F.col("pl") / F.col("idx") * F.col("base"), 2).alias("real_pl"))


@plan(f"""SELECT admin, round(p0,2) AS pl, round(p0/nullif(sum(p0) OVER (),0),6) AS share, round(p0/nullif(p12,0)-1,6) AS var12, round(p0/nullif(p36,0)-1,6) AS var36, round(p0/nullif(p60,0)-1,6) AS var60 FROM
(SELECT admin, sum(pl) FILTER (dt='{CUTOFF}') AS p0, sum(pl) FILTER (dt='{M12}') AS p12, sum(pl) FILTER (dt='{M36}') AS p36, sum(pl) FILTER (dt='{M60}') AS p60 FROM sane JOIN registry USING (cnpj) GROUP BY 1) WHERE p0 IS NOT NULL""")
def admin_ranking_horizons(r: Reports) -> DataFrame:
    j = r.sane.where(F.col("dt").isin(*[F.lit(d).cast("date") for d in (CUTOFF, M12, M36, M60)])).join(r.registry, "cnpj")
    g = j.groupBy("admin").agg(*[F.sum(F.when(F.col("dt") == F.lit(d).cast("date"), F.col("pl"))).alias(n) for n, d in (("p0", CUTOFF), ("p12", M12), ("p36", M36), ("p60", M60))]).where("p0 IS NOT NULL")
    return g.select("admin", F.round("p0", 2).alias("pl"), _share("p0").alias("share"), *[F.round(F.col("p0") / F.nullif(F.col(p), F.lit(0.0)) - 1, 6).alias(f"var{p[1:]}") for p in ("p12", "p36", "p60")])


def _ranking(role: str):
    return f"SELECT {role} AS provider, count(*) AS n, round(sum(pl),2) AS pl, round(sum(pl)/nullif(sum(sum(pl)) OVER (),0),6) AS share FROM sane JOIN registry USING (cnpj) WHERE dt='{CUTOFF}' GROUP BY 1"


def _ranked(r: Reports, role: str, of: DataFrame | None = None) -> DataFrame:
    g = _at(r.sane).join(r.registry if of is None else of, "cnpj").groupBy(F.col(role).alias("provider")).agg(F.count("*").alias("n"), F.sum("pl").alias("s"))
    return g.select("provider", "n", F.round("s", 2).alias("pl"), _share("s").alias("share"))


@plan(f"@{MANAGERS_SQL} SELECT gestor AS provider, count(*) AS n, round(sum(pl),2) AS pl, round(sum(pl)/nullif(sum(sum(pl)) OVER (),0),6) AS share FROM sane JOIN managers USING (cnpj) WHERE dt='{CUTOFF}' GROUP BY 1")
def manager_ranking(r: Reports) -> DataFrame:
    return _ranked(r, "gestor", managers(r))


#: Custodian, controller and auditor as the registry's columns give them.
ROLES = {"custodian": "region", "controller": "admin", "auditor": "cast(gestor AS varchar)"}


@plan(" UNION ALL ".join(f"(SELECT '{k}' AS role, cast({c} AS varchar) AS provider, count(*) AS n, round(sum(pl),2) AS pl, round(sum(pl)/nullif(sum(sum(pl)) OVER (),0),6) AS share FROM sane JOIN registry USING (cnpj) WHERE dt='{CUTOFF}' GROUP BY 1,2)" for k, c in ROLES.items()))
def provider_ranking_by_role(r: Reports) -> DataFrame:
    # one pass: a row for each vehicle and role
    roles = F.array(*[F.struct(F.lit(k).alias("role"), F.expr(c.replace("varchar", "string")).alias("provider")) for k, c in ROLES.items()])
    g = _at(r.sane).join(r.registry, "cnpj").select("pl", F.explode(roles).alias("x")).groupBy("x.role", "x.provider").agg(F.count("*").alias("n"), F.sum("pl").alias("s"))
    share = F.col("s") / F.nullif(F.sum("s").over(Window.partitionBy("role")), F.lit(0.0))
    return g.select("role", "provider", "n", F.round("s", 2).alias("pl"), F.round(share, 6).alias("share"))


@plan(f"SELECT cnpj, pl, share FROM (SELECT cnpj, pl, round(pl/nullif(sum(pl) OVER (),0),6) AS share FROM sane WHERE dt='{CUTOFF}') ORDER BY pl DESC, cnpj LIMIT 30")
def top_vehicles(r: Reports) -> DataFrame:
    own = _at(r.sane).select("cnpj", "pl")
    total = own.agg(F.nullif(F.sum("pl"), F.lit(0.0)).alias("total"))
    return own.orderBy(F.desc("pl"), "cnpj").limit(30).crossJoin(F.broadcast(total)).select("cnpj", "pl", F.round(F.col("pl") / F.col("total"), 6).alias("share"))


def _hhi_sql(value: str, clip: bool) -> str:
    v = "greatest(g,0)" if clip else "g"
    return f"""@a AS (SELECT admin AS who, sum({value}) AS g FROM sane JOIN registry USING (cnpj) WHERE dt='{CUTOFF}' GROUP BY 1), b AS (SELECT *, {v} AS x FROM a), c AS (SELECT x/nullif(sum(x) OVER (),0) AS sh, row_number() OVER (ORDER BY x DESC, who) AS rk FROM b {'' if clip else 'WHERE x>0'})
SELECT (SELECT count(*) FROM b WHERE x<=0) AS n_excluded, round(sum(sh*sh),6) AS hhi, round(max(sh),6) AS top1, round(sum(sh) FILTER (rk<=5),6) AS top5, count(*) AS n FROM c"""


def _hhi(r: Reports, value: str, clip: bool) -> DataFrame:
    g = _at(r.sane).join(r.registry, "cnpj").groupBy(F.col("admin").alias("who")).agg(F.sum(F.expr(value)).alias("g"))
    return C.hhi(g, [], "g", clip).select("n_excluded", *[F.round(c, 6).alias(c) for c in ("hhi", "top1", "top5")], "n")


@plan(_hhi_sql("CASE WHEN bal<0 THEN -pl ELSE pl END", False))
def concentration_hhi_topk(r: Reports) -> DataFrame:
    return _hhi(r, "CASE WHEN bal<0 THEN -pl ELSE pl END", False)


@plan(_hhi_sql("CASE WHEN bal<0 THEN -pl ELSE pl END", True))
def lens8_operational(r: Reports) -> DataFrame:
    return _hhi(r, "CASE WHEN bal<0 THEN -pl ELSE pl END", True)


#: Portfolio segments are the lines' numbers; segment 7 is a subtotal and left out.
_SEGMENTS = [f"seg{i}" for i in range(1, 7)]


@plan("@wide AS (SELECT dt, " + ", ".join(f"round(sum(v) FILTER (ln={i}),2) AS seg{i}" for i in range(1, 7)) + f" FROM lines WHERE month(dt)=12 OR dt='{CUTOFF}' GROUP BY 1) SELECT dt, segment, amount FROM (UNPIVOT wide ON {', '.join(_SEGMENTS)} INTO NAME segment VALUE amount)")
def segments_unpivot_yearend(r: Reports) -> DataFrame:
    own = r.lines.where((F.month("dt") == 12) | (F.col("dt") == F.lit(CUTOFF).cast("date")))
    wide = own.groupBy("dt").agg(*[F.round(F.sum(F.when(F.col("ln") == i, F.col("v"))), 2).alias(f"seg{i}") for i in range(1, 7)])
    return wide.unpivot(["dt"], _SEGMENTS, "segment", "amount").where("amount IS NOT NULL")


@plan("SELECT dt, round(sum(b90),2) AS b90, round(sum(b360),2) AS b360, round(sum(b1080),2) AS b1080, round(sum(bmax),2) AS bmax, round(sum(b90+b360+b1080+bmax),2) AS strict_total FROM overdue o WHERE EXISTS (SELECT 1 FROM sane s WHERE s.cnpj=o.cnpj AND s.dt=o.dt) GROUP BY 1")
def aging_bands(r: Reports) -> DataFrame:
    o = r.overdue.join(r.sane.select("cnpj", "dt"), ["cnpj", "dt"], "left_semi")
    return o.groupBy("dt").agg(*[F.round(F.sum(c), 2).alias(c) for c in ("b90", "b360", "b1080", "bmax")], F.round(F.sum(F.expr("b90 + b360 + b1080 + bmax")), 2).alias("strict_total"))


@plan("SELECT tranche, round(sum(val),2) AS amount, count(*) AS n FROM (SELECT cnpj, dt, unnest(['senior','mezanino','subordinada']) AS tranche, unnest([v_sen,v_mez,v_sub]) AS val FROM assets) WHERE val IS NOT NULL GROUP BY 1")
def tranche_totals(r: Reports) -> DataFrame:
    long = r.assets.select("cnpj", "dt", F.col("v_sen").alias("senior"), F.col("v_mez").alias("mezanino"), F.col("v_sub").alias("subordinada")).unpivot(["cnpj", "dt"], ["senior", "mezanino", "subordinada"], "tranche", "val")
    return long.where("val IS NOT NULL").groupBy("tranche").agg(F.round(F.sum("val"), 2).alias("amount"), F.count("*").alias("n"))


@plan("SELECT cnpj, dt, CASE WHEN v_tot>0 THEN round((coalesce(v_sub,0)+coalesce(v_mez,0))/v_tot,6) END AS subord FROM assets")
def subordination_by_vehicle(r: Reports) -> DataFrame:
    return r.assets.select("cnpj", "dt", F.round(ratio(F.coalesce("v_sub", F.lit(0.0)) + F.coalesce("v_mez", F.lit(0.0)), F.col("v_tot")), 6).alias("subord"))


@plan("SELECT replace(k,'qty_','') AS category, round(v,2) AS total FROM (UNPIVOT (SELECT sum(qty) FILTER (ln=1) AS qty_1, sum(qty) FILTER (ln=2) AS qty_2, sum(qty) FILTER (ln=3) AS qty_3, sum(qty) FILTER (ln>3) AS qty_rest FROM lines) ON * INTO NAME k VALUE v)")
def holder_categories_transpose(r: Reports) -> DataFrame:
    q = F.col("qty")
    row = r.lines.agg(*[F.sum(F.when(F.col("ln") == i, q)).alias(f"qty_{i}") for i in (1, 2, 3)], F.sum(F.when(F.col("ln") > 3, q)).alias("qty_rest"))
    return row.unpivot([], row.columns, "k", "v").select(F.regexp_replace("k", "^qty_", "").alias("category"), F.round("v", 2).alias("total"))


@plan("SELECT chr(cast(65+cast(tax*100 AS int) AS int)) AS rating, count(*) AS n, round(sum(v),2) AS amount, round(sum(v)/nullif(sum(sum(v)) OVER (),0),6) AS share FROM lines GROUP BY 1")
def rating_distribution(r: Reports) -> DataFrame:
    g = r.lines.groupBy(F.chr((65 + F.round(F.col("tax") * 100)).cast("int")).alias("rating")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    return g.select("rating", "n", F.round("s", 2).alias("amount"), _share("s").alias("share"))


@plan("SELECT CASE WHEN qty<=10 THEN '0-10' WHEN qty<=20 THEN '11-20' WHEN qty<=30 THEN '21-30' WHEN qty<=40 THEN '31-40' ELSE '41+' END AS bucket, round(sum(v),2) AS amount FROM lines GROUP BY 1")
def liquidity_ladder(r: Reports) -> DataFrame:
    q = F.col("qty")
    b = F.when(q <= 10, "0-10").when(q <= 20, "11-20").when(q <= 30, "21-30").when(q <= 40, "31-40").otherwise("41+")
    return r.lines.groupBy(b.alias("bucket")).agg(F.round(F.sum("v"), 2).alias("amount"))


@plan("SELECT year(dt) AS yr, flag, count(*) AS n, round(sum(v),2) AS amount FROM lines GROUP BY 1,2")
def trades_yearly(r: Reports) -> DataFrame:
    return r.lines.groupBy(F.year("dt").alias("yr"), "flag").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("amount"))


@plan(f"SELECT ced, round(sum(pr/100*v_tot),2) AS stock, count(DISTINCT cnpj) AS n_vehicles FROM assignors JOIN assets USING (cnpj, dt) WHERE dt='{CUTOFF}' AND pr>0 AND pr<=100 GROUP BY 1")
def assignor_ranking(r: Reports) -> DataFrame:
    j = _at(r.assignors).where("pr > 0 AND pr <= 100").join(r.assets, ["cnpj", "dt"])
    return j.groupBy("ced").agg(F.round(F.sum(F.col("pr") / 100 * F.col("v_tot")), 2).alias("stock"), F.count_distinct("cnpj").alias("n_vehicles"))


@plan("@c AS (SELECT cnpj, dt, sum(pr) AS pr FROM assignors WHERE pos<=3 GROUP BY 1,2) SELECT dt, round(sum(v_tot*least(pr,100)/100) FILTER (pr IS NOT NULL)/nullif(sum(v_tot),0),6) AS coverage FROM assets LEFT JOIN c USING (cnpj, dt) GROUP BY 1")
def assignor_coverage(r: Reports) -> DataFrame:
    c = r.assignors.where("pos <= 3").groupBy("cnpj", "dt").agg(F.sum("pr").alias("pr"))
    j = r.assets.join(c, ["cnpj", "dt"], "left")
    return j.groupBy("dt").agg(F.round(F.sum(F.when(F.col("pr").isNotNull(), F.col("v_tot") * F.least("pr", F.lit(100.0)) / 100)) / F.nullif(F.sum("v_tot"), F.lit(0.0)), 6).alias("coverage"))


@plan("SELECT ced, count(DISTINCT dt) AS months, count(DISTINCT cnpj) AS vehicles, min(dt) AS first, max(dt) AS last FROM assignors GROUP BY 1 HAVING count(DISTINCT dt)>=12 ORDER BY 2 DESC, 1 LIMIT 500")
def assignor_recurrence_having(r: Reports) -> DataFrame:
    g = r.assignors.groupBy("ced").agg(F.count_distinct("dt").alias("months"), F.count_distinct("cnpj").alias("vehicles"), F.min("dt").alias("first"), F.max("dt").alias("last"))
    return g.where("months >= 12").orderBy(F.desc("months"), "ced").limit(500)


@plan("SELECT 'negative' AS rule, cnpj, dt FROM sane JOIN registry USING (cnpj) WHERE bal<0 UNION ALL SELECT 'leverage', cnpj, dt FROM sane JOIN assets USING (cnpj, dt) WHERE v_tot>5*pl AND pl>1e3 UNION ALL SELECT 'overdue', cnpj, dt FROM overdue WHERE inad>0.9*(inad+dcp) AND inad+dcp>5e4")
def alerts_union(r: Reports) -> DataFrame:
    negative = r.sane.join(r.registry, "cnpj").where("bal < 0").select(F.lit("negative").alias("rule"), "cnpj", "dt")
    leverage = r.sane.join(r.assets, ["cnpj", "dt"]).where("v_tot > 5 * pl AND pl > 1e3").select(F.lit("leverage").alias("rule"), "cnpj", "dt")
    overdue = r.overdue.where("inad > 0.9 * (inad + dcp) AND inad + dcp > 5e4").select(F.lit("overdue").alias("rule"), "cnpj", "dt")
    return negative.unionByName(leverage).unionByName(overdue)


@plan("SELECT cnpj, dt, round(pl/prev-1,6) AS jump FROM near WHERE prev>1e5 AND abs(pl/prev-1)>0.3")
def pl_jumps(r: Reports) -> DataFrame:
    w = Window.partitionBy("cnpj").orderBy("dt")
    j = r.panel.withColumn("prev", F.lag("pl").over(w)).where("prev > 1e5")
    return j.where("abs(pl / prev - 1) > 0.3").select("cnpj", "dt", F.round(F.col("pl") / F.col("prev") - 1, 6).alias("jump"))


@plan(FLOWS_SQL + " SELECT year(o_orderdate) AS yr, round(sum(CASE op WHEN 'O' THEN amt WHEN 'F' THEN -amt ELSE 0 END),2) AS net FROM flows WHERE sane GROUP BY 1", base=False)
def net_flows_yearly(r: Reports) -> DataFrame:
    amount = F.when(F.col("op") == "O", F.col("amt")).when(F.col("op") == "F", -F.col("amt")).otherwise(0.0)
    return flows(r).where("sane").groupBy(F.year("o_orderdate").alias("yr")).agg(F.round(F.sum(amount), 2).alias("net"))


@plan("@b AS (SELECT cnpj, dt, sum(pl) AS x FROM pl GROUP BY 1,2) SELECT count(*) AS n_both, round(sum(pl),2) AS a, round(sum(x),2) AS b, round(sum(x)-sum(pl),2) AS diff FROM panel JOIN b USING (cnpj, dt)")
def source_reconciliation(r: Reports) -> DataFrame:
    b = r.pl.groupBy("cnpj", "dt").agg(F.sum("pl").alias("x"))
    return r.panel.join(b, ["cnpj", "dt"]).agg(F.count("*").alias("n_both"), F.round(F.sum("pl"), 2).alias("a"), F.round(F.sum("x"), 2).alias("b"), F.round(F.sum("x") - F.sum("pl"), 2).alias("diff"))


@plan(f"SELECT round(sum(pl) FILTER (gestor<>0)/nullif(sum(pl),0),6) AS gestor, round(sum(pl) FILTER (bal>=0)/nullif(sum(pl),0),6) AS bal, round(count(*) FILTER (region IS NOT NULL)/count(*),6) AS region FROM sane LEFT JOIN registry USING (cnpj) WHERE dt='{CUTOFF}'")
def provider_coverage(r: Reports) -> DataFrame:
    j = _at(r.sane).join(r.registry, "cnpj", "left")
    total = F.nullif(F.sum("pl"), F.lit(0.0))
    return j.agg(F.round(F.sum(F.expr("CASE WHEN gestor <> 0 THEN pl END")) / total, 6).alias("gestor"), F.round(F.sum(F.expr("CASE WHEN bal >= 0 THEN pl END")) / total, 6).alias("bal"), F.round(F.count("region") / F.count("*"), 6).alias("region"))


@plan("SELECT dt, round(sum(b1080)/nullif(sum(inad),0),6) AS prov_ratio FROM overdue GROUP BY 1")
def provision_ratio(r: Reports) -> DataFrame:
    return r.overdue.groupBy("dt").agg(F.round(F.sum("b1080") / F.nullif(F.sum("inad"), F.lit(0.0)), 6).alias("prov_ratio"))


_HOLD = "@h AS (SELECT o_custkey AS holder, cnpj, v, CASE ln%3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' END AS linked FROM lines JOIN orders ON l_orderkey=o_orderkey WHERE EXISTS (SELECT 1 FROM sane s WHERE s.cnpj=lines.cnpj AND s.dt='2001-06-30'))"


def _holdings(r: Reports) -> DataFrame:
    o = r.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("holder"))
    held = r.lines.join(_at(r.sane).select("cnpj").distinct(), "cnpj", "left_semi").join(o, "l_orderkey")
    return held.select("holder", "cnpj", "v", F.when(F.col("ln") % 3 == 0, "S").when(F.col("ln") % 3 == 1, "N").alias("linked"))


@plan(_HOLD + " SELECT cnpj, count(DISTINCT holder) AS holders, round(sum(v),2) AS amount FROM h GROUP BY 1")
def holders_semi_join(r: Reports) -> DataFrame:
    return _holdings(r).groupBy("cnpj").agg(F.count_distinct("holder").alias("holders"), F.round(F.sum("v"), 2).alias("amount"))


@plan(_HOLD + " SELECT nullif(gestor,0) AS gestor, round(sum(v),2) AS amount FROM h JOIN registry USING (cnpj) GROUP BY 1")
def holders_by_manager_null_group(r: Reports) -> DataFrame:
    return _holdings(r).join(r.registry, "cnpj").groupBy(F.nullif(F.col("gestor"), F.lit(0)).alias("gestor")).agg(F.round(F.sum("v"), 2).alias("amount"))


_POSITIONS = f"@pos AS (SELECT lpad(cast(o_custkey AS varchar),14,'0') AS holder, l.cnpj, v, CASE ln%3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' END AS linked FROM lines l JOIN orders ON l_orderkey=o_orderkey WHERE dt='{CUTOFF}' AND l.cnpj IN (SELECT cnpj FROM sane WHERE dt='{CUTOFF}')), held AS (SELECT *, holder IN (SELECT cnpj FROM sane WHERE dt='{CUTOFF}') AS inside FROM pos)"


def _positions(r: Reports) -> DataFrame:
    """Positions in the universe's units at the cutoff: holder, vehicle, value, whether the issuer is linked (or it is not told), and whether the holder is of the universe itself."""
    universe = _at(r.sane).select("cnpj").distinct()
    own = _at(r.late).join(universe, "cnpj", "left_semi").select(F.lpad(F.col("deb").cast("string"), 14, "0").alias("holder"), "cnpj", "v", F.when(F.col("ln") % 3 == 0, "S").when(F.col("ln") % 3 == 1, "N").alias("linked"))
    return own.join(universe.select(F.col("cnpj").alias("holder"), F.lit(True).alias("inside")), "holder", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


@plan(_POSITIONS + " SELECT count(*) AS n, round(sum(v),2) AS total, round(sum(v) FILTER (NOT inside),2) AS outside, round(coalesce(sum(v) FILTER (inside),0),2) AS inside, count(DISTINCT holder) FILTER (NOT inside) AS n_outside, round(sum(v) FILTER (linked='S'),2) AS linked, round(sum(v) FILTER (linked IS NULL),2) AS unknown, count(*) FILTER (linked IS NULL) AS n_unknown FROM held")
def holders_summary(r: Reports) -> DataFrame:
    """What is held by whom: outside and inside the universe, of linked issuers, and where that is not told, which is not the same as not linked."""
    v, out = F.col("v"), ~F.col("inside")

    def of(c):
        return F.round(F.coalesce(F.sum(F.when(c, v)), F.lit(0.0)), 2)

    none = F.col("linked").isNull()
    return _positions(r).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), of(out).alias("outside"), of(F.col("inside")).alias("inside"), F.count_distinct(F.when(out, F.col("holder"))).alias("n_outside"), of(F.col("linked") == "S").alias("linked"), of(none).alias("unknown"), F.count_if(none).alias("n_unknown"))


@plan(_POSITIONS + " SELECT holder, round(sum(v),2) AS amount, count(DISTINCT cnpj) AS n_vehicles, count(*) FILTER (linked='S') AS n_linked, count(*) FILTER (linked IS NULL) AS n_unknown FROM held WHERE NOT inside GROUP BY 1")
def holders_outside(r: Reports) -> DataFrame:
    """Each holder outside the universe: its value, in how many vehicles, and how many positions are linked or not told."""
    return _positions(r).where("NOT inside").groupBy("holder").agg(F.round(F.sum("v"), 2).alias("amount"), F.count_distinct("cnpj").alias("n_vehicles"), F.count_if(F.col("linked") == "S").alias("n_linked"), F.count_if(F.col("linked").isNull()).alias("n_unknown"))


@plan(_HOLD + " SELECT holder, count(*) FILTER (linked='S') AS n_linked, count(*) FILTER (linked IS NULL) AS n_unknown, count(*) AS n FROM h GROUP BY 1")
def linked_flag_tristate(r: Reports) -> DataFrame:
    return _holdings(r).groupBy("holder").agg(F.count_if(F.col("linked") == "S").alias("n_linked"), F.count_if(F.col("linked").isNull()).alias("n_unknown"), F.count("*").alias("n"))


@plan("SELECT dt, round(quantile_cont(pl,0.1),4) AS p10, round(median(pl),4) AS p50, round(quantile_cont(pl,0.9),4) AS p90 FROM sane GROUP BY 1")
def quantile_summary(r: Reports) -> DataFrame:
    return r.sane.groupBy("dt").agg(*[F.round(F.percentile("pl", q), 4).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])


@plan("SELECT cnpj, dt, round(v_sen/nullif(v_tot,0)-dc_risk/nullif(v_tot,0),6) AS gap FROM assets")
def expected_vs_realised_gap(r: Reports) -> DataFrame:
    t = F.nullif(F.col("v_tot"), F.lit(0.0))
    return r.assets.select("cnpj", "dt", F.round(F.col("v_sen") / t - F.col("dc_risk") / t, 6).alias("gap"))


@plan("SELECT count(*) AS n, count(*) FILTER (abs(a.v_tot-coalesce(a.dc_risk,0)-coalesce(a.dc_norisk,0))>0.011) AS n_broken, count(*) FILTER (abs(a.v_tot-p.pl)>0.01) AS n_below FROM assets a JOIN panel p USING (cnpj, dt)")
def accounting_identity(r: Reports) -> DataFrame:
    j = r.assets.join(r.panel, ["cnpj", "dt"])
    return j.agg(F.count("*").alias("n"), F.count_if(F.expr("abs(v_tot - coalesce(dc_risk, 0) - coalesce(dc_norisk, 0)) > 0.011")).alias("n_broken"), F.count_if(F.expr("abs(v_tot - pl) > 0.01")).alias("n_below"))


# the exposure lenses


@plan(f"@{MANAGERS_SQL} SELECT round(sum(pl) FILTER (gestor IS NOT NULL),2) AS numerator, round(sum(pl),2) AS denominator, round(sum(pl) FILTER (gestor IS NOT NULL)/nullif(sum(pl),0),6) AS coverage, count(DISTINCT gestor) AS n_managers FROM sane LEFT JOIN managers USING (cnpj) WHERE dt='{CUTOFF}'")
def lens1_management(r: Reports) -> DataFrame:
    j = _at(r.sane).join(managers(r), "cnpj", "left")
    known = F.sum(F.when(F.col("gestor").isNotNull(), F.col("pl")))
    return j.agg(F.round(known, 2).alias("numerator"), F.round(F.sum("pl"), 2).alias("denominator"), F.round(known / F.nullif(F.sum("pl"), F.lit(0.0)), 6).alias("coverage"), F.count_distinct("gestor").alias("n_managers"))


@plan(_ranking("admin").replace(" AS provider", " AS admin"))
def lens2_administration(r: Reports) -> DataFrame:
    return _ranked(r, "admin").withColumnRenamed("provider", "admin")


@plan("SELECT dt, round(sum(coalesce(dc_risk,0)+coalesce(dc_norisk,0)),2) AS dc, round(sum(CASE WHEN pl>0 THEN coalesce(dc_risk,0)+coalesce(dc_norisk,0) END)/nullif(sum(CASE WHEN pl>0 THEN pl END),0),6) AS dc_pl FROM sane JOIN assets USING (cnpj, dt) GROUP BY 1")
def lens3_portfolio(r: Reports) -> DataFrame:
    dc = F.coalesce("dc_risk", F.lit(0.0)) + F.coalesce("dc_norisk", F.lit(0.0))
    ok = F.col("pl") > 0
    return r.sane.join(r.assets, ["cnpj", "dt"]).groupBy("dt").agg(F.round(F.sum(dc), 2).alias("dc"), F.round(F.sum(F.when(ok, dc)) / F.nullif(F.sum(F.when(ok, F.col("pl"))), F.lit(0.0)), 6).alias("dc_pl"))


DEBTORS_SQL = "@dl AS (SELECT cnpj, dt, max(val) FILTER (seq=1) AS top1_val, sum(val) FILTER (seq<=5) AS top5_val, sum(val) FILTER (seq<=10) AS top10_val, sum(val) FILTER (seq<=25) AS top25_val, sum(val) AS list_val, sum(val*val) AS sq FROM debtors GROUP BY 1,2), dm AS (SELECT cnpj, dt, dc_risk+dc_norisk AS dc, list_val, CASE WHEN dc_risk+dc_norisk>0 THEN top1_val/(dc_risk+dc_norisk) END AS top1, CASE WHEN dc_risk+dc_norisk>0 THEN top5_val/(dc_risk+dc_norisk) END AS top5, CASE WHEN dc_risk+dc_norisk>0 THEN top10_val/(dc_risk+dc_norisk) END AS top10, CASE WHEN dc_risk+dc_norisk>0 THEN top25_val/(dc_risk+dc_norisk) END AS top25, CASE WHEN dc_risk+dc_norisk>0 THEN list_val/(dc_risk+dc_norisk) END AS listed, CASE WHEN dc_risk+dc_norisk>0 THEN sq/((dc_risk+dc_norisk)*(dc_risk+dc_norisk)) END AS hhi_floor, CASE WHEN dc_risk+dc_norisk>0 THEN list_val/(dc_risk+dc_norisk)>1.05 END AS inconsistent FROM assets LEFT JOIN dl USING (cnpj, dt))"


def debtor_metrics(r: Reports) -> DataFrame:
    return C.partial_ranks(r.debtors, r.assets.select("cnpj", "dt", (F.col("dc_risk") + F.col("dc_norisk")).alias("dc")))


@plan(DEBTORS_SQL + " SELECT cnpj, dt, round(dc,2) AS dc, round(top1,6) AS top1, round(top5,6) AS top5, round(top10,6) AS top10, round(top25,6) AS top25, round(listed,6) AS listed, round(hhi_floor,6) AS hhi_floor FROM dm")
def debtor_metrics_strict_null(r: Reports) -> DataFrame:
    return debtor_metrics(r).select("cnpj", "dt", F.round("dc", 2).alias("dc"), *[F.round(c, 6).alias(c) for c in ("top1", "top5", "top10", "top25", "listed", "hhi_floor")])


_TRIPLE = " SELECT dt, round(count(*) FILTER (list_val IS NOT NULL)/count(*),6) AS cov_vehicles, round(sum(dc) FILTER (list_val IS NOT NULL)/nullif(sum(dc),0),6) AS cov_amount, round(sum(least(list_val,dc)) FILTER (list_val IS NOT NULL)/nullif(sum(dc),0),6) AS cov_explained FROM dm WHERE dc>0 GROUP BY 1"


@plan(DEBTORS_SQL + _TRIPLE)
def coverage_triple_least_filter(r: Reports) -> DataFrame:
    return C.coverage_triple(debtor_metrics(r))


@plan(DEBTORS_SQL + " SELECT dt, count(*) AS n, count(list_val) AS n_listed, round(count(list_val)/count(*),6) AS coverage FROM dm GROUP BY 1")
def debtor_coverage_series(r: Reports) -> DataFrame:
    return debtor_metrics(r).groupBy("dt").agg(F.count("*").alias("n"), F.count("list_val").alias("n_listed"), F.round(F.count("list_val") / F.count("*"), 6).alias("coverage"))


_SHARES = ("top1", "top5", "top10", "top25", "listed", "hhi_floor")
_SUMMARY = [f"SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}),6) AS mean, round(quantile_cont({c},0.25),6) AS p25, round(median({c}),6) AS med, round(quantile_cont({c},0.75),6) AS p75, round(quantile_cont({c},0.9),6) AS p90, round(max({c}),6) AS most, round(sum({c}*dc)/nullif(sum(dc) FILTER ({c} IS NOT NULL),0),6) AS weighted, count(*) FILTER ({c}>0.1) AS above10, count(*) FILTER ({c}>0.2) AS above20, count(*) FILTER ({c}>0.5) AS above50, round(coalesce(sum(dc) FILTER ({c}>0.5),0),2) AS dc_above50 FROM dm" for c in _SHARES]


@plan(DEBTORS_SQL + " " + " UNION ALL ".join(_SUMMARY))
def debtor_summary_quantiles(r: Reports) -> DataFrame:
    """Thirteen measures of each of six shares."""
    long = debtor_metrics(r).select("dc", *_SHARES).unpivot(["dc"], list(_SHARES), "measure", "x")
    x, has = F.col("x"), F.col("x").isNotNull()
    cuts = {"p25": 0.25, "med": 0.5, "p75": 0.75, "p90": 0.9}
    every = F.percentile("x", list(cuts.values()))  # one aggregate, which holds and ships a measure's values once for all four
    quantiles = [F.round(every[i], 6).alias(n) for i, n in enumerate(cuts)]
    above = [F.count_if(x > q).alias(f"above{round(100 * q)}") for q in (0.1, 0.2, 0.5)]
    return long.groupBy("measure").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), *quantiles, F.round(F.max("x"), 6).alias("most"), F.round(F.sum(x * F.col("dc")) / F.nullif(F.sum(F.when(has, F.col("dc"))), F.lit(0.0)), 6).alias("weighted"), *above, F.round(F.coalesce(F.sum(F.when(x > 0.5, F.col("dc"))), F.lit(0.0)), 2).alias("dc_above50"))


@plan(DEBTORS_SQL + ", lim AS (SELECT unnest([0.1,0.25,0.5]) AS lim) SELECT cast(lim AS double) AS lim, count(*) FILTER (top1>lim) AS n_above, round(coalesce(sum(dc) FILTER (top1>lim),0),2) AS dc_above FROM dm CROSS JOIN lim GROUP BY 1")
def debtor_thresholds(r: Reports) -> DataFrame:
    m = debtor_metrics(r).withColumn("lim", F.explode(F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5))))
    above = F.col("top1") > F.col("lim")
    return m.groupBy("lim").agg(F.count_if(above).alias("n_above"), F.round(F.coalesce(F.sum(F.when(above, F.col("dc"))), F.lit(0.0)), 2).alias("dc_above"))


@plan(DEBTORS_SQL + " SELECT inconsistent, count(*) AS n FROM dm GROUP BY 1")
def inconsistency_flag(r: Reports) -> DataFrame:
    return debtor_metrics(r).groupBy("inconsistent").agg(F.count("*").alias("n"))


@plan(f"@c AS (SELECT cnpj, dt, sum(pr) AS pr FROM assignors WHERE pos<=3 GROUP BY 1,2) SELECT round(count(pr)/count(*),6) AS cov_vehicles, round(sum(v_tot) FILTER (pr IS NOT NULL)/nullif(sum(v_tot),0),6) AS cov_dc, round(sum(v_tot*pr/100)/nullif(sum(v_tot),0),6) AS cov_value FROM assets LEFT JOIN c USING (cnpj, dt) WHERE dt='{CUTOFF}'")
def lens4_assignor(r: Reports) -> DataFrame:
    c = r.assignors.where("pos <= 3").groupBy("cnpj", "dt").agg(F.sum("pr").alias("pr"))
    j = _at(r.assets).join(c, ["cnpj", "dt"], "left")
    total = F.nullif(F.sum("v_tot"), F.lit(0.0))
    return j.agg(F.round(F.count("pr") / F.count("*"), 6).alias("cov_vehicles"), F.round(F.sum(F.when(F.col("pr").isNotNull(), F.col("v_tot"))) / total, 6).alias("cov_dc"), F.round(F.sum(F.col("v_tot") * F.col("pr") / 100) / total, 6).alias("cov_value"))


@plan(f"SELECT round(sum(v_sen),2) AS senior, round(sum(v_mez),2) AS mezanino, round(sum(v_sub),2) AS subordinada, round(count(v_sub)/count(*),6) AS cov_sub FROM assets WHERE dt='{CUTOFF}'")
def lens6_holders(r: Reports) -> DataFrame:
    return _at(r.assets).agg(*[F.round(F.sum(c), 2).alias(n) for c, n in (("v_sen", "senior"), ("v_mez", "mezanino"), ("v_sub", "subordinada"))], F.round(F.count("v_sub") / F.count("*"), 6).alias("cov_sub"))
