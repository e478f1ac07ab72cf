"""The evidence book: 31 claims, each with the figure as published and the same found anew; and the tables compiled for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tables as O
from ..operators.lineage import cut
from ..operators.tables import Claim
from ..sources.analogue import AFTER, CUTOFF, M60, Reports
from .panel import MANAGERS_SQL, managers
from .register import plan

_NOW, _SINCE, _YEAR = CUTOFF[:7], f"{M60[:7]} to {CUTOFF[:7]}", "2000"
CLAIMS = [
    Claim("C001", "value of the market", "brl", _NOW, "confirmed", "total"), Claim("C002", "reporting vehicles", "un", _NOW, "confirmed", "vehicles"), Claim("C003", "units held inside the universe", "brl", _NOW, "confirmed", "circular"),
    Claim("C004", "value without circular units", "brl", _NOW, "confirmed", "net"), Claim("C005", "nominal growth of the market", "x", _SINCE, "confirmed", "growth"), Claim("C006", "real growth of the market", "x", _SINCE, "confirmed", "real_growth"),
    Claim("C007", "positions of holders", "un", _NOW, "confirmed", "holders"), Claim("C008", "credit with its risk", "brl", _NOW, "confirmed", "with_risk"), Claim("C009", "credit without its risk", "brl", _NOW, "confirmed", "without_risk"),
    Claim("C010", "value of exclusive vehicles", "brl", _NOW, "confirmed", "exclusive"), Claim("C011", "share of the largest administrator", "%", _NOW, "confirmed", "top_admin"), Claim("C012", "share of the five largest administrators", "%", _NOW, "confirmed", "five_admins"),
    Claim("C013", "value of the largest manager", "brl", _NOW, "confirmed", "top_manager"), Claim("C014", "share of the five largest managers", "%", _NOW, "confirmed", "five_managers"), Claim("C015", "share of subordinated tranches", "%", _NOW, "confirmed", "subordinated"),
    Claim("C016", "overdue over credit", "%", _NOW, "confirmed", "overdue"), Claim("C017", "overdue for long over credit", "%", _NOW, "confirmed", "long_overdue"), Claim("C018", "exposure to the largest assignor, at least", "brl", _NOW, "strongly supported", "top_assignor"),
    Claim("C019", "share of the best ratings", "%", _NOW, "confirmed", "best_rated"), Claim("C020", "credit acquired in a year", "brl", _YEAR, "confirmed", "acquired"), Claim("C021", "credit bought back in a year", "brl", _YEAR, "confirmed", "bought_back"),
    Claim("C022", "vehicles with a negative balance", "un", _NOW, "confirmed", "negative"), Claim("C023", "day by which vehicles had to adapt", "text", "2024", "confirmed", None), Claim("C024", "rule on assignments by companies in recovery", "text", "2026", "confirmed", None),
    Claim("C025", "value by the body of the industry", "text", "2026-06", "conflicting", None), Claim("C026", "value of vehicles that report in both months", "brl", _NOW, "confirmed", "both_months"), Claim("C027", "provisions over what is overdue", "%", _NOW, "confirmed", "provisions"),
    Claim("C028", "units on the balance sheet of a bank", "text", "2025-06", "confirmed", None), Claim("C029", "units held by other funds", "brl", _NOW, "confirmed", "held"), Claim("C030", "of these of a linked issuer", "brl", _NOW, "confirmed", "linked"), Claim("C031", "value of vehicles found by a name", "brl", _NOW, "indicative", "named"),
]

#: As published, over the tables of the cutoff's vehicles: the panel with amounts, overdue bands and the registry.
_PORTFOLIO = {
    "total": "sum(pl)", "vehicles": "count(*)", "circular": "sum(quotas)", "net": "sum(pl) - sum(coalesce(quotas, 0))", "holders": "sum(n_hold)", "with_risk": "sum(dc_risk)", "without_risk": "sum(dc_norisk)", "exclusive": "sum(pl) FILTER (WHERE bal > 5000)",
    "subordinated": "sum(coalesce(v_mez, 0) + coalesce(v_sub, 0)) / sum(v_tot)", "overdue": "sum(inad) / sum(coalesce(inad, 0) + coalesce(dcp, 0))", "long_overdue": "sum(coalesce(b1080, 0) + coalesce(bmax, 0)) / sum(coalesce(inad, 0) + coalesce(dcp, 0))",
    "provisions": "sum(b90) / sum(inad)", "negative": "count(*) FILTER (WHERE bal < 0)", "held": "sum(v_tot)", "linked": "sum(linked)", "best_rated": "1 - sum(rated_low) / sum(v_tot)", "named": "sum(pl) FILTER (WHERE name LIKE '%07%')",
}
#: Anew, over the lines of the same vehicles with their orders and supplier.
_LINES = {
    "total": "sum(v) FILTER (WHERE tp = own)", "vehicles": "count(DISTINCT cnpj)", "circular": "sum(v) FILTER (WHERE ln IN (5, 6))", "net": "sum(CASE WHEN tp = own THEN v ELSE 0 END - CASE WHEN ln IN (5, 6) THEN v ELSE 0 END)", "holders": "count(DISTINCT concat(cnpj, '/', deb))", "with_risk": "sum(v) FILTER (WHERE flag <> 'R')",
    "without_risk": "sum(v) - sum(v) FILTER (WHERE flag <> 'R')", "exclusive": "sum(v) FILTER (WHERE tp = own AND s_acctbal > 5000)", "subordinated": "1 - sum(v) FILTER (WHERE flag = 'N') / sum(v)", "overdue": "1 - sum(v) FILTER (WHERE late <= 0) / sum(v)", "long_overdue": "sum(v) FILTER (WHERE late > 360) / sum(v)",
    "provisions": "sum(v) FILTER (WHERE late BETWEEN 1 AND 90) / sum(v) FILTER (WHERE late > 0)", "negative": "count(DISTINCT CASE WHEN s_acctbal < 0 THEN cnpj END)", "held": "sum(v)", "linked": "sum(v) - sum(v) FILTER (WHERE ln % 3 <> 0)", "best_rated": "sum(v) FILTER (WHERE tax < 0.05) / sum(v)", "named": "sum(v) FILTER (WHERE tp = own AND s_name LIKE '%07%')",
}
_TOPS = {"top": "max(pl) / sum(pl)", "value": "max(pl)", "five": "sum(pl) FILTER (WHERE k <= 5) / sum(pl)"}

_CLAIMS_SQL = ", ".join(f"('{c.id}','{c.subject}','{c.unit}','{c.period}','{c.confidence}',{repr(c.key) if c.key else 'NULL'})" for c in CLAIMS)


def _rows_sql(found: dict[str, str], table: str) -> str:
    return f"SELECT unnest([{', '.join(repr(k) for k in found)}]) AS key, unnest([{', '.join(f'cast({e} AS double)' for e in found.values())}]) AS x FROM {table}"


_BOOK_SQL = f"""@claims(claim, subject, unit, period, confidence, key) AS (VALUES {_CLAIMS_SQL}), {MANAGERS_SQL},
cutl AS (SELECT l.*, s.tp AS own, o_custkey AS deb, ship - cast(o_orderdate AS date) AS late, s_acctbal, s_name, s_nationkey FROM lines l JOIN sane s ON l.cnpj=s.cnpj AND l.dt=s.dt JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey WHERE l.dt='{CUTOFF}'),
tb AS (SELECT cnpj, dt, round(sum(v) FILTER (ln BETWEEN 5 AND 6),2) AS quotas, round(sum(v) FILTER (tax>=0.05),2) AS rated_low, round(sum(v) FILTER (ln%3=0),2) AS linked FROM lines WHERE dt='{CUTOFF}' GROUP BY 1,2), hd AS (SELECT cnpj, dt, count(*) AS n_hold FROM debtors GROUP BY 1,2),
pf AS (SELECT * FROM (SELECT * FROM sane WHERE dt='{CUTOFF}') LEFT JOIN assets USING (cnpj, dt) LEFT JOIN overdue USING (cnpj, dt) LEFT JOIN tb USING (cnpj, dt) LEFT JOIN hd USING (cnpj, dt) LEFT JOIN registry USING (cnpj)),
ad AS (SELECT pl, row_number() OVER (ORDER BY pl DESC, admin) AS k FROM (SELECT admin, sum(pl) AS pl FROM pf GROUP BY 1)), ma AS (SELECT pl, row_number() OVER (ORDER BY pl DESC, gestor) AS k FROM (SELECT m.gestor, sum(pl) AS pl FROM pf JOIN managers m USING (cnpj) GROUP BY 1)),
ad2 AS (SELECT list_reverse(list_sort(list(v))) AS x FROM (SELECT s_nationkey, sum(v) AS v FROM cutl WHERE tp=own GROUP BY 1)), ma2 AS (SELECT list_reverse(list_sort(list(v))) AS x FROM (SELECT CASE WHEN c.l_suppkey%10=0 AND n.s_suppkey IS NOT NULL THEN n.s_nationkey%7+10 ELSE c.s_nationkey%7 END AS g, sum(v) AS v FROM cutl c LEFT JOIN supplier n ON n.s_suppkey=c.l_suppkey+1 WHERE tp=own GROUP BY 1)),
mo AS (SELECT dt, sum(pl) AS pl FROM sane GROUP BY 1), rt AS (SELECT dt, 1+((year(dt)*12+month(dt))*37%11)/1000.0 AS f FROM (SELECT DISTINCT dt FROM lines)), ix AS (SELECT dt, exp(sum(ln(f)) OVER (ORDER BY dt)) AS ix FROM rt),
pub(key, value) AS ({_rows_sql(_PORTFOLIO, "pf")} UNION ALL SELECT 'top_admin', max(pl)/sum(pl) FROM ad UNION ALL SELECT 'five_admins', sum(pl) FILTER (k<=5)/sum(pl) FROM ad UNION ALL SELECT 'top_manager', max(pl) FROM ma UNION ALL SELECT 'five_managers', sum(pl) FILTER (k<=5)/sum(pl) FROM ma
 UNION ALL SELECT 'growth', max(pl) FILTER (dt='{CUTOFF}')/max(pl) FILTER (dt='{M60}') FROM mo UNION ALL SELECT 'real_growth', max(pl/ix) FILTER (dt='{CUTOFF}')/max(pl/ix) FILTER (dt='{M60}') FROM mo JOIN ix USING (dt)
 UNION ALL SELECT 'top_assignor', max(x) FROM (SELECT ced, sum(pr/100*v_tot) AS x FROM assignors JOIN assets USING (cnpj, dt) WHERE dt='{CUTOFF}' AND pr>0 AND pr<=100 GROUP BY 1) UNION ALL SELECT 'acquired', sum(v_roll) FROM assets WHERE year(dt)={_YEAR}
 UNION ALL SELECT 'bought_back', sum(x) FROM (SELECT cnpj, dt, round(sum(v) FILTER (ln=3 AND flag='R'),2) AS x FROM lines WHERE year(dt)={_YEAR} GROUP BY 1,2) UNION ALL SELECT 'both_months', sum(a.pl) FROM sane a JOIN sane b ON a.cnpj=b.cnpj WHERE a.dt='{CUTOFF}' AND b.dt='{AFTER}'),
anew(key, again) AS ({_rows_sql(_LINES, "cutl")} UNION ALL SELECT 'top_admin', x[1]/list_sum(x) FROM ad2 UNION ALL SELECT 'five_admins', list_sum(x[1:5])/list_sum(x) FROM ad2 UNION ALL SELECT 'top_manager', x[1] FROM ma2 UNION ALL SELECT 'five_managers', list_sum(x[1:5])/list_sum(x) FROM ma2
 UNION ALL SELECT 'growth', n.v/t.v FROM (SELECT sum(v) AS v FROM cutl WHERE tp=own) n, (SELECT sum(v) AS v FROM lines l JOIN sane s ON l.cnpj=s.cnpj AND l.dt=s.dt AND l.tp=s.tp WHERE l.dt='{M60}') t
 UNION ALL SELECT 'real_growth', n.v/t.v/(SELECT product(f) FROM rt WHERE dt>'{M60}' AND dt<='{CUTOFF}') FROM (SELECT sum(v) AS v FROM cutl WHERE tp=own) n, (SELECT sum(v) AS v FROM lines l JOIN sane s ON l.cnpj=s.cnpj AND l.dt=s.dt AND l.tp=s.tp WHERE l.dt='{M60}') t
 UNION ALL SELECT 'top_assignor', max(x) FROM (SELECT ced, sum(val) AS x FROM assignors WHERE dt='{CUTOFF}' AND pr>0 AND pr<=100 GROUP BY 1) UNION ALL SELECT 'acquired', sum(v) FROM lines WHERE year(ship)={_YEAR} AND flag='A' AND ln>=3 UNION ALL SELECT 'bought_back', sum(v) FROM lines WHERE year(ship)={_YEAR} AND flag='R' AND ln=3
 UNION ALL SELECT 'both_months', sum(v) FROM cutl WHERE tp=own AND cnpj IN (SELECT cnpj FROM sane WHERE dt='{AFTER}'))
SELECT claim, subject, unit, period, confidence, round(value,4) AS value, round(again,4) AS again, CASE WHEN key IS NULL THEN 'CURATED' WHEN value IS NULL OR again IS NULL THEN 'MISSING' WHEN abs(value-again)<=0.005*greatest(abs(value),abs(again)) THEN 'OK' ELSE 'DIVERGES' END AS status FROM claims LEFT JOIN pub USING (key) LEFT JOIN anew USING (key)"""


def _published(r: Reports, month: Reports) -> DataFrame:
    at = F.col("dt") == F.lit(CUTOFF).cast("date")
    tabs = month.lines.groupBy("cnpj", "dt").agg(*[F.round(F.sum(F.when(c, F.col("v"))), 2).alias(n) for n, c in (("quotas", F.col("ln").between(5, 6)), ("rated_low", F.col("tax") >= 0.05), ("linked", F.col("ln") % 3 == 0))])
    pf = r.sane.where(at)
    for t in (month.assets, month.overdue, tabs, month.debtors.groupBy("cnpj", "dt").agg(F.count("*").alias("n_hold"))):
        pf = pf.join(t, ["cnpj", "dt"], "left")
    pf = cut(pf.join(r.registry, "cnpj", "left"))

    def ranked(df: DataFrame, by: str) -> DataFrame:
        sums = df.groupBy(by).agg(F.sum("pl").alias("pl"))  # a row for each role
        return sums.withColumn("k", F.row_number().over(Window.orderBy(F.desc("pl"), by)))

    ad, ma = ranked(pf, "admin"), ranked(pf.drop("gestor").join(managers(r), "cnpj"), "gestor")
    months = r.sane.groupBy("dt").agg(F.sum("pl").alias("pl"))
    rates = months.select("dt", (1 + ((F.year("dt") * 12 + F.month("dt")) * 37 % 11) / 1000.0).alias("f"))
    level = rates.withColumn("ix", F.exp(F.sum(F.log("f")).over(Window.orderBy("dt"))))  # a row for each month

    def on(x: str, d: str) -> str:
        return f"max({x}) FILTER (WHERE dt = DATE '{d}')"

    exposure = month.assignors.where("pr > 0 AND pr <= 100").join(month.assets, ["cnpj", "dt"]).groupBy("ced").agg(F.sum(F.col("pr") / 100 * F.col("v_tot")).alias("x"))
    year = r.lines.where(F.year("dt") == int(_YEAR)).groupBy("cnpj", "dt").agg(r.amounts()["v_roll"].alias("roll"), F.round(F.sum(F.when((F.col("ln") == 3) & (F.col("flag") == "R"), F.col("v"))), 2).alias("back"))
    both = pf.join(r.sane.where(F.col("dt") == F.lit(AFTER).cast("date")).select("cnpj"), "cnpj")
    parts = [
        O.figures(pf, _PORTFOLIO, "value"), O.figures(ad, {"top_admin": _TOPS["top"], "five_admins": _TOPS["five"]}, "value"), O.figures(ma, {"top_manager": _TOPS["value"], "five_managers": _TOPS["five"]}, "value"),
        O.figures(months, {"growth": f"{on('pl', CUTOFF)} / {on('pl', M60)}"}, "value"), O.figures(months.join(level, "dt"), {"real_growth": f"{on('pl / ix', CUTOFF)} / {on('pl / ix', M60)}"}, "value"),
        O.figures(exposure, {"top_assignor": "max(x)"}, "value"), O.figures(year, {"acquired": "sum(roll)", "bought_back": "sum(back)"}, "value"), O.figures(both, {"both_months": "sum(pl)"}, "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _anew(r: Reports, month: Reports) -> DataFrame:
    supplier = r.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", "s_name", "s_nationkey")
    own = r.sane.where(F.col("dt") == F.lit(CUTOFF).cast("date")).select("cnpj", F.col("tp").alias("own"))
    lines = cut(month.late.join(own, "cnpj").join(supplier, "l_suppkey"))
    panel = lines.where("tp = own")

    def largest(df: DataFrame, by: list) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("v").alias("v")).agg(F.sort_array(F.collect_list("v"), asc=False).alias("x"))  # a value for each role

    first, five, whole = "any_value(x)[0]", "any_value(aggregate(slice(x, 1, 5), 0.0D, (a, b) -> a + b))", "any_value(aggregate(x, 0.0D, (a, b) -> a + b))"
    beside = supplier.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("s_nationkey").alias("other"))
    manager = F.when((F.col("l_suppkey") % 10 == 0) & F.col("other").isNotNull(), F.col("other") % 7 + 10).otherwise(F.col("s_nationkey") % 7)
    then = r.lines.where(F.col("dt") == F.lit(M60).cast("date")).join(r.sane, ["cnpj", "dt", "tp"], "left_semi").agg(F.sum("v").alias("then"))
    ends = panel.agg(F.sum("v").alias("now")).crossJoin(F.broadcast(then))
    months = r.lines.where((F.col("dt") > F.lit(M60).cast("date")) & (F.col("dt") <= F.lit(CUTOFF).cast("date"))).select("dt").distinct()
    grown = months.agg(F.product(1 + ((F.year("dt") * 12 + F.month("dt")) * 37 % 11) / 1000.0).alias("grown"))
    marked = month.assignors.where("pr > 0 AND pr <= 100").groupBy("ced").agg(F.sum("val").alias("x"))
    later = r.sane.where(F.col("dt") == F.lit(AFTER).cast("date")).select("cnpj")
    parts = [
        O.figures(lines, _LINES, "again"), O.figures(largest(panel, ["s_nationkey"]), {"top_admin": f"{first} / {whole}", "five_admins": f"{five} / {whole}"}, "again"),
        O.figures(largest(panel.join(beside, "l_suppkey", "left"), [manager.alias("g")]), {"top_manager": first, "five_managers": f"{five} / {whole}"}, "again"),
        O.figures(ends.crossJoin(F.broadcast(grown)), {"growth": "max(now / then)", "real_growth": "max(now / then / grown)"}, "again"), O.figures(marked, {"top_assignor": "max(x)"}, "again"),
        O.figures(r.lines.where(F.year("ship") == int(_YEAR)), {"acquired": "sum(v) FILTER (WHERE flag = 'A' AND ln >= 3)", "bought_back": "sum(v) FILTER (WHERE flag = 'R' AND ln = 3)"}, "again"), O.figures(panel.join(later, "cnpj", "left_semi"), {"both_months": "sum(v)"}, "again"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan(_BOOK_SQL)
def evidence_book(r: Reports) -> DataFrame:
    """The 31 claims with both figures; four of them rest on texts that a user brings."""
    r.__dict__["sane"] = cut(r.sane)
    month = r.only(CUTOFF)
    found = O.book(r.spark, CLAIMS, _published(r, month), _anew(r, month))
    return found.select("claim", "subject", "unit", "period", "confidence", F.round("value", 4).alias("value"), F.round("again", 4).alias("again"), "status")


def reader_tables(r: Reports) -> dict[str, DataFrame]:
    """The tables compiled for readers."""
    at = F.col("dt") == F.lit(CUTOFF).cast("date")
    now = r.sane.where(at)
    vehicles = now.join(r.registry, "cnpj").withColumn("share", F.col("pl") / F.sum("pl").over(Window.partitionBy("dt")))
    admins = vehicles.groupBy("admin").agg(F.sum("pl").alias("pl"), F.count("*").alias("n"), F.sum("share").alias("share"))
    assignors = r.assignors.where(at).groupBy("ced").agg(F.sum("val").alias("exposure"), F.count("*").alias("n"), F.max("pr").alias("top_share"))
    return {
        "vehicles": O.compiled(vehicles, {"cnpj": "id", "name": "text", "pl": "brl", "share": "%", "no_such": "un"}, [F.desc("pl"), F.col("cnpj")], 25),
        "admins": O.compiled(admins, {"admin": "text", "pl": "brl", "share": "%", "n": "un"}, [F.desc("pl"), F.col("admin")], 25),
        "assignors": O.compiled(assignors, {"ced": "text", "exposure": "brl", "n": "un", "top_share": "%"}, [F.desc("exposure"), F.col("ced")], 40),
    }


@plan(f"""@v AS (SELECT cnpj, name, admin, pl, pl/sum(pl) OVER () AS share FROM sane JOIN registry USING (cnpj) WHERE dt='{CUTOFF}'), units(tab, col, unit) AS (VALUES ('vehicles','pl','brl'),('vehicles','share','%'),('admins','pl','brl'),('admins','share','%'),('admins','n','un'),('assignors','exposure','brl'),('assignors','n','un'),('assignors','top_share','%')),
c1 AS (SELECT * FROM v ORDER BY pl DESC, cnpj LIMIT 25), c2 AS (SELECT admin, sum(pl) AS pl, count(*) AS n, sum(share) AS share FROM v GROUP BY 1 ORDER BY pl DESC, admin LIMIT 25), c3 AS (SELECT ced, sum(val) AS exposure, count(*) AS n, max(pr) AS top_share FROM assignors WHERE dt='{CUTOFF}' GROUP BY 1 ORDER BY exposure DESC, ced LIMIT 40),
cells AS (SELECT 'vehicles' AS tab, cnpj AS key, unnest(['pl','share']) AS col, unnest([pl, share]) AS value FROM c1 UNION ALL SELECT 'admins', admin, unnest(['pl','share','n']), unnest([pl, share, n]) FROM c2 UNION ALL SELECT 'assignors', ced, unnest(['exposure','n','top_share']), unnest([exposure, n, top_share]) FROM c3)
SELECT tab, key, col, unit, round(value,4) AS value FROM cells JOIN units USING (tab, col)""")
def reader_cells(r: Reports) -> DataFrame:
    """Every number of the compiled tables with its row's key and the unit that its column declares."""
    out = None
    for name, df in reader_tables(r).items():
        declared = O.units(df)
        key, numbers = df.columns[0], [c for c, u in declared.items() if u not in ("id", "text")]
        cells = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(declared[c]).alias("unit"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in numbers])
        rows = df.select(F.lit(name).alias("tab"), F.col(key).alias("key"), F.explode(cells).alias("x")).select("tab", "key", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out
