"""The formula gate: every published indicator has a second figure, found by another way than the first, and the two must agree.

Sums come from the lines and orders themselves, counts from set operations, medians and limits from sorted ranks,
streaks from islands of months, price levels from the months' rates. An indicator without a second figure fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import signals as S
from ..operators.lineage import cut
from ..sources.analogue import AFTER, BEFORE, CUTOFF, M3, M6, M12, M24, M36, M60, Reports
from . import signals
from .evidence import _IND, Edition, _cut, _indicators, _stacked
from .register import plan

_LINES = {
    "pl_total": "sum(v) FILTER (WHERE tp = own)", "n_veiculos": "count(DISTINCT cnpj)", "circularidade": "sum(v) FILTER (WHERE ln BETWEEN 5 AND 6)", "pl_liquido": "sum(v) FILTER (WHERE tp = own) - sum(v) FILTER (WHERE ln BETWEEN 5 AND 6)", "dc_total": "sum(v)", "dc_sem_risco": "sum(v) FILTER (WHERE flag = 'R')", "aquisicoes_mes": "sum(v) FILTER (WHERE flag = 'A' AND ln >= 3)",
    "inadimplencia": "sum(v) FILTER (WHERE late > 0) / nullif(sum(v), 0)", "atraso_180": "sum(v) FILTER (WHERE late > 360) / nullif(sum(v), 0)", "provisionamento": "sum(v) FILTER (WHERE late BETWEEN 1 AND 90) / nullif(sum(v) FILTER (WHERE late > 0), 0)", "subordinacao": "sum(v) FILTER (WHERE flag IN ('A', 'R')) / nullif(sum(v), 0)",
    "serie_senior": "sum(v) FILTER (WHERE flag = 'N')", "serie_mezanino": "sum(v) FILTER (WHERE flag = 'A')", "serie_subordinada": "sum(v) FILTER (WHERE flag = 'R')", "veiculos_com_garantia": "count(DISTINCT CASE WHEN flag = 'R' THEN cnpj END)", "detido_fundos": "sum(v)", "emissor_ligado": "sum(v) FILTER (WHERE ln % 3 = 0)",
}
#: Over each vehicle's lines of the month, by tranche: the sum of the tranches, and all of them.
_TRANCHES = {"identidade_contabil": "count(*) FILTER (WHERE abs(coalesce(n, 0) + coalesce(a, 0) + coalesce(r, 0) - whole) > 0.011)", "series_abaixo_esperado": "count(*) FILTER (WHERE n < coalesce(a, 0) + coalesce(r, 0))"}
#: Over each vehicle's debtors: the largest and all that are listed, beside its credit (with both kinds).
_DEBTORS = {"sacado_cobertura_dc": "1 - coalesce(sum(dc) FILTER (WHERE top IS NULL), 0) / nullif(sum(dc), 0)", "sacado_n_top1_50": "count(*) FILTER (WHERE 2 * top > dc)"}
#: Over each marked assignor of the month.
_MARKED = {"rj_vinculos": "count(*)", "rj_exposicao": "sum(val)", "rj_casos": "count(*) FILTER (WHERE most >= 20)"}
_THEN = {BEFORE: "var_1m", M3: "var_3m", M6: "var_6m", M12: "var_12m", M24: "var_24m"}

#: Limits by ranks, what fires by them, and its islands of months; scores by vehicle.
_ENGINE_SQL = f"""rk AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY value) AS rn, count(*) OVER (PARTITION BY id) AS n FROM lf WHERE dt='{CUTOFF}' AND grp AND evaluable AND material AND value IS NOT NULL),
lim2 AS (SELECT ids.id, CASE WHEN any_value(kind)<>'pct' THEN any_value(q)::DOUBLE WHEN max(n)>=30 THEN max(value) FILTER (rn=floor((n-1)*q)+1) + (max(value) FILTER (rn=ceil((n-1)*q)+1) - max(value) FILTER (rn=floor((n-1)*q)+1)) * (max((n-1)*q)-floor(max((n-1)*q))) END AS lim FROM ids LEFT JOIN rk USING (id) GROUP BY ids.id),
hit2 AS (SELECT cnpj, id, dt, year(dt)*12+month(dt)-row_number() OVER (PARTITION BY cnpj, id ORDER BY dt) AS isle FROM lf JOIN lim2 USING (id) JOIN ids USING (id) WHERE evaluable AND grp AND material AND CASE WHEN up THEN value>=lim2.lim ELSE value<=lim2.lim END),
act2 AS (SELECT cnpj, id, count(*) AS len FROM hit2 GROUP BY cnpj, id, isle HAVING max(dt)='{CUTOFF}'),
sc2 AS (SELECT l.cnpj, round(100.0*sum(CASE WHEN a.len>=months THEN weight ELSE 0 END)/nullif(sum(CASE WHEN evaluable THEN weight END),0),2) AS score, 100.0*avg(CASE WHEN evaluable THEN 1 ELSE 0 END) AS coverage FROM lf l JOIN ids USING (id) LEFT JOIN act2 a ON a.cnpj=l.cnpj AND a.id=l.id WHERE l.dt='{CUTOFF}' GROUP BY 1),
pos2 AS (SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM sc2 WHERE coverage>=50 AND score>0), p2 AS (SELECT max(score) FILTER (rn=floor((n-1)*0.99)+1) + (max(score) FILTER (rn=ceil((n-1)*0.99)+1) - max(score) FILTER (rn=floor((n-1)*0.99)+1)) * (max((n-1)*0.99)-floor(max((n-1)*0.99))) AS p99 FROM pos2)"""
_AGAIN_SQL = f"""al AS (SELECT l.*, s.tp AS own, ship - cast(o_orderdate AS date) AS late FROM lines l JOIN sane s ON l.cnpj=s.cnpj AND l.dt=s.dt JOIN orders ON l_orderkey=o_orderkey WHERE l.dt='{CUTOFF}'),
am AS (SELECT dt, sum(pl) AS pl FROM sane GROUP BY 1), now_ AS (SELECT cnpj, pl FROM sane WHERE dt='{CUTOFF}'), was_ AS (SELECT cnpj, pl FROM sane WHERE dt='{BEFORE}'), next_ AS (SELECT cnpj, pl FROM sane WHERE dt='{AFTER}'),
tr AS (SELECT cnpj, sum(v) FILTER (flag='N') AS n, sum(v) FILTER (flag='A') AS a, sum(v) FILTER (flag='R') AS r, sum(v) AS whole FROM al GROUP BY 1),
db AS (SELECT * FROM (SELECT cnpj, sum(v) FILTER (flag IN ('N','A'))+sum(v) FILTER (flag='R') AS dc FROM lines WHERE dt='{CUTOFF}' GROUP BY 1) LEFT JOIN (SELECT cnpj, max(val) AS top FROM (SELECT cnpj, o_custkey, sum(v) AS val FROM lines JOIN orders ON l_orderkey=o_orderkey WHERE dt='{CUTOFF}' GROUP BY 1,2) GROUP BY 1) USING (cnpj) WHERE dc>0),
dbr AS (SELECT top/dc AS x, row_number() OVER (ORDER BY top/dc) AS rn, count(*) OVER () AS n FROM db WHERE top IS NOT NULL),
mk AS (SELECT ced, sum(val) AS val, max(pr) AS most FROM assignors WHERE dt='{CUTOFF}' AND ced LIKE '%1' AND pr>0 AND pr<=100 GROUP BY 1),
fl AS (SELECT o_orderstatus AS op, o_totalprice AS amt, c_acctbal AS bal, (SELECT max(struct_pack(d:=p.o_orderdate, k:=p.o_orderkey, a:=p.o_totalprice)).a FROM orders p WHERE p.o_custkey=o.o_custkey AND (p.o_orderdate<o.o_orderdate OR p.o_orderdate=o.o_orderdate AND p.o_orderkey<o.o_orderkey)) AS prev FROM orders o JOIN customer ON o_custkey=c_custkey WHERE last_day(cast(o_orderdate AS date))='{M36}'),
fs AS (SELECT op, amt, greatest(coalesce(bal,0), coalesce(prev,0)) AS base FROM fl),
{_ENGINE_SQL},
again AS (SELECT unnest([{", ".join(f"'{k}'" for k in _LINES)}]) AS indicator, unnest([{", ".join(f"cast({e} AS double)" for e in _LINES.values())}]) AS again FROM al
 UNION ALL SELECT unnest([{", ".join(f"'{k}'" for k in _TRANCHES)}]), unnest([{", ".join(f"cast({e} AS double)" for e in _TRANCHES.values())}]) FROM tr
 UNION ALL SELECT unnest([{", ".join(f"'{k}'" for k in _DEBTORS)}]), unnest([{", ".join(f"cast({e} AS double)" for e in _DEBTORS.values())}]) FROM db
 UNION ALL SELECT unnest([{", ".join(f"'{k}'" for k in _MARKED)}]), unnest([{", ".join(f"cast({e} AS double)" for e in _MARKED.values())}]) FROM mk
 UNION ALL SELECT 'sacado_mediana_top1', avg(x) FROM dbr WHERE 2*rn BETWEEN n AND n+2
 UNION ALL SELECT 'captacoes_mes', sum(amt) FROM fs WHERE op='O' AND NOT amt-100000>3*base UNION ALL SELECT 'resgates_mes', sum(amt) FROM fs WHERE op<>'O' AND NOT amt-100000>3*base
 UNION ALL SELECT 'cagr_real', power((SELECT pl FROM am WHERE dt='{CUTOFF}')/(SELECT pl FROM am WHERE dt='{M60}')/(SELECT product(1+rate/100) FROM rates WHERE dt>'{M60}' AND dt<='{CUTOFF}'), 0.2)-1
 UNION ALL SELECT CASE dt {" ".join(f"WHEN DATE '{d}' THEN '{n}'" for d, n in _THEN.items())} END, (SELECT pl FROM am WHERE dt='{CUTOFF}')/pl-1 FROM am WHERE dt IN ({", ".join(f"'{d}'" for d in _THEN)})
 UNION ALL SELECT 'mudou_entrantes', count(*) FROM (SELECT cnpj FROM now_ EXCEPT SELECT cnpj FROM was_) UNION ALL SELECT 'mudou_saintes', count(*) FROM (SELECT cnpj FROM was_ EXCEPT SELECT cnpj FROM now_) UNION ALL SELECT 'jul_ausentes', count(*) FROM (SELECT cnpj FROM now_ EXCEPT SELECT cnpj FROM next_)
 UNION ALL SELECT 'jul_pl_ausente', sum(pl) FROM now_ WHERE cnpj NOT IN (SELECT cnpj FROM next_) UNION ALL SELECT 'jul_same_store', sum(n.pl)/nullif(sum(a.pl),0)-1 FROM now_ a JOIN next_ n USING (cnpj)
 UNION ALL SELECT 'rj_processos', count(*) FROM orders WHERE o_orderpriority='1-URGENT' UNION ALL SELECT 'posicoes_cotistas', count(*) FROM debtors WHERE dt='{CUTOFF}' AND cnpj IN (SELECT cnpj FROM now_)
 UNION ALL SELECT 'mudou_sinais_novos', count(*) FROM act2 WHERE len=1 UNION ALL SELECT 'mudou_sinais_persistentes', count(*) FROM act2 WHERE len>1 UNION ALL SELECT 'mudou_sinais_encerrados', count(*) FROM {signals.edition_sql(BEFORE)} b WHERE NOT EXISTS (SELECT 1 FROM act2 a WHERE a.cnpj=b.cnpj AND a.id=b.id)
 UNION ALL SELECT 'rf_nao_classificavel', count(*) FROM sc2 WHERE NOT coalesce(coverage>=50 AND score IS NOT NULL,false) UNION ALL SELECT 'rf_atencao_alta', count(*) FROM sc2, p2 WHERE coverage>=50 AND score>0 AND score>=p99 UNION ALL SELECT 'rf_sem_sinal', count(*) FROM sc2 WHERE coverage>=50 AND NOT score>0 UNION ALL SELECT 'rf_n_sinais', count(DISTINCT id) FROM lf WHERE dt='{CUTOFF}')"""


def _one(name: str, df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("indicator"), value.cast("double").alias("again"))


def _several(df: DataFrame, found: dict[str, str]) -> DataFrame:
    return _stacked(df, {k: ("", "", e) for k, e in found.items()}).select("indicator", F.col("value").alias("again"))


def _ranked(df: DataFrame, by: list[str], value: str, q: Column) -> DataFrame:
    """(by, lim, n): the quantile of each group from the two ranks around it."""
    w = Window.partitionBy(*by).orderBy(value)
    at = (F.col("n") - 1) * q
    ranked = df.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    low, high = (F.max(F.when(F.col("rn") == f(at) + 1, F.col(value))) for f in (F.floor, F.ceil))
    g = ranked.groupBy(*by).agg(low.alias("low"), high.alias("high"), F.max("n").alias("n"), F.max(at).alias("at"))
    return g.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("lim"), "n")


def _flows(r: Reports) -> DataFrame:
    """The month's flows of one kind or another, with the customer's flow before by a latest-before aggregation."""
    o = r.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    own = o.where(F.last_day(F.to_date("o_orderdate")) == F.lit(M36).cast("date"))
    past = o.join(own.select("o_custkey").distinct(), "o_custkey", "left_semi").select("o_custkey", *[F.col(c).alias(f"p_{c[2:]}") for c in ("o_orderdate", "o_orderkey", "o_totalprice")])
    earlier = (past["p_orderdate"] < own["o_orderdate"]) | ((past["p_orderdate"] == own["o_orderdate"]) & (past["p_orderkey"] < own["o_orderkey"]))
    met = own.join(past, (own["o_custkey"] == past["o_custkey"]) & earlier, "left").drop(past["o_custkey"])
    last = met.groupBy("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice").agg(F.max_by("p_totalprice", F.struct("p_orderdate", "p_orderkey")).alias("prev"))
    j = last.join(r.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    base = F.greatest(F.coalesce("c_acctbal", F.lit(0.0)), F.coalesce("prev", F.lit(0.0)))
    return j.where(~(F.col("o_totalprice") - 100000 > 3 * base)).select(F.col("o_orderstatus").alias("op"), F.col("o_totalprice").alias("amt"))


def _engine_again(e: Edition) -> list[DataFrame]:
    """What the engine publishes, from the same months of each vehicle: limits by ranks, streaks by islands."""
    spark = e.all.spark
    meta = spark.createDataFrame([(s.id, s.kind, float(s.limit), s.up, s.weight, s.months) for s in S.SIGNALS], "id string, kind string, q double, up boolean, weight int, months int")
    meta = F.broadcast(meta)  # a row for each signal
    long = S.long_form(signals.kept_wide(e.all), S.SIGNALS).join(meta, "id")
    now = _cut(long)
    limits = _ranked(now.where("grp AND evaluable AND material AND kind = 'pct'"), ["id", "q"], "value", F.col("q")).where("n >= 30").select("id", "lim")
    limits = limits.unionByName(meta.where("kind <> 'pct'").select("id", F.col("q").alias("lim")))
    met = long.join(F.broadcast(limits), "id").where("evaluable AND grp AND material AND CASE WHEN up THEN value >= lim ELSE value <= lim END")
    isle = F.year("dt") * 12 + F.month("dt") - F.row_number().over(Window.partitionBy("cnpj", "id").orderBy("dt"))
    active = met.withColumn("isle", isle).groupBy("cnpj", "id", "isle").agg(F.count("*").alias("len"), F.max("dt").alias("last"))
    active = cut(active.where(F.col("last") == F.lit(CUTOFF).cast("date")).select("cnpj", "id", "len"))
    weight = F.col("weight")
    j = now.select("cnpj", "id", "evaluable", "weight", "months").join(active, ["cnpj", "id"], "left")
    hit = F.sum(F.when(F.col("len") >= F.col("months"), weight).otherwise(0))
    scores = cut(j.groupBy("cnpj").agg(F.round(100.0 * hit / F.nullif(F.sum(F.when(F.col("evaluable"), weight)), F.lit(0)), 2).alias("score"), (100.0 * F.avg(F.when(F.col("evaluable"), 1).otherwise(0))).alias("coverage")))
    told = scores.where("coverage >= 50 AND score > 0").withColumn("every", F.lit(1))
    p99 = _ranked(told, ["every"], "score", F.lit(0.99)).select("lim")
    n = F.count("*")
    return [
        _one("mudou_sinais_novos", active.where("len = 1"), n), _one("mudou_sinais_persistentes", active.where("len > 1"), n), _one("mudou_sinais_encerrados", e.before.join(active, ["id", "cnpj"], "left_anti"), n),
        _one("rf_nao_classificavel", scores.where("NOT coalesce(coverage >= 50 AND score IS NOT NULL, false)"), n), _one("rf_sem_sinal", scores.where("coverage >= 50 AND NOT score > 0"), n),
        _one("rf_atencao_alta", told.crossJoin(F.broadcast(p99)).where("score >= lim"), n), _one("rf_n_sinais", now.select("id").distinct(), n),
    ]


def again(e: Edition) -> DataFrame:
    """(indicator, again) of all 47."""
    r, m = e.all, e.month
    lines = m.late.join(_cut(r.sane).select("cnpj", F.col("tp").alias("own")), "cnpj")
    parts = [_several(lines, _LINES)]
    tranche = lines.groupBy("cnpj").agg(*[F.sum(F.when(F.col("flag") == k, F.col("v"))).alias(k.lower()) for k in "NAR"], F.sum("v").alias("whole"))
    parts.append(_several(tranche, _TRANCHES))
    credit = m.lines.groupBy("cnpj").agg((F.sum(F.when(F.col("flag").isin("N", "A"), F.col("v"))) + F.sum(F.when(F.col("flag") == "R", F.col("v")))).alias("dc")).where("dc > 0")
    debts = credit.join(m.late.groupBy("cnpj", "deb").agg(F.sum("v").alias("val")).groupBy("cnpj").agg(F.max("val").alias("top")), "cnpj", "left")
    parts += [_several(debts, _DEBTORS), _ranked(debts.withColumn("x", F.col("top") / F.col("dc")).withColumn("every", F.lit(1)), ["every"], "x", F.lit(0.5)).select(F.lit("sacado_mediana_top1").alias("indicator"), F.col("lim").alias("again"))]
    marked = m.assignors.where("ced LIKE '%1' AND pr > 0 AND pr <= 100").groupBy("ced").agg(F.sum("val").alias("val"), F.max("pr").alias("most"))
    parts.append(_several(marked, _MARKED))
    flows = _flows(r)
    parts.append(_several(flows, {"captacoes_mes": "sum(amt) FILTER (WHERE op = 'O')", "resgates_mes": "sum(amt) FILTER (WHERE op <> 'O')"}))
    months = r.sane.groupBy("dt").agg(F.sum("pl").alias("pl"))
    now = _cut(months).select(F.col("pl").alias("now"))
    then = months.where(F.col("dt").isin(*[F.lit(d).cast("date") for d in _THEN])).crossJoin(F.broadcast(now))
    name = F.create_map(*[x for d, n in _THEN.items() for x in (F.lit(d), F.lit(n))])[F.date_format("dt", "yyyy-MM-dd")]
    parts.append(then.select(name.alias("indicator"), (F.col("now") / F.col("pl") - 1).alias("again")))
    rate = 1 + ((F.year("dt") * 12 + F.month("dt")) * 37 % 11) / 1000.0
    grown = months.where((F.col("dt") > F.lit(M60).cast("date")) & (F.col("dt") <= F.lit(CUTOFF).cast("date"))).agg(F.product(rate).alias("grown"))
    ends = now.crossJoin(F.broadcast(_cut(months, M60).select(F.col("pl").alias("then")))).crossJoin(F.broadcast(grown))
    parts.append(ends.select(F.lit("cagr_real").alias("indicator"), (F.pow(F.col("now") / F.col("then") / F.col("grown"), F.lit(0.2)) - 1).alias("again")))
    a, b, c = (_cut(r.sane, d).select("cnpj", "pl") for d in (CUTOFF, BEFORE, AFTER))
    ids = [x.select("cnpj") for x in (a, b, c)]
    n = F.count("*")
    parts += [_one("mudou_entrantes", ids[0].subtract(ids[1]), n), _one("mudou_saintes", ids[1].subtract(ids[0]), n), _one("jul_ausentes", ids[0].subtract(ids[2]), n), _one("jul_pl_ausente", a.join(c, "cnpj", "left_anti"), F.sum("pl"))]
    both = a.join(c.withColumnRenamed("pl", "later"), "cnpj")
    parts.append(_one("jul_same_store", both, F.sum("later") / F.nullif(F.sum("pl"), F.lit(0.0)) - 1))
    parts.append(_one("rj_processos", r.table("orders").groupBy("o_orderpriority").count().where("o_orderpriority = '1-URGENT'"), F.sum("count")))
    parts.append(_one("posicoes_cotistas", m.debtors.join(a, "cnpj", "left_semi"), n))
    out = parts[0]
    for p in parts[1:] + _engine_again(e):
        out = out.unionByName(p)
    return out


def gated(published: DataFrame, again: DataFrame) -> DataFrame:
    """(indicator, status) of (indicator, value) and (indicator, again): OK where the second figure is within a thousandth of the
    first, or both are NULL; FAIL where it is not, and where there is no second figure."""
    j = published.join(again.withColumn("seen", F.lit(True)), "indicator", "left")
    close = F.expr("abs(value - again) <= 0.001 * greatest(abs(value), abs(again))")
    ok = F.col("seen").isNotNull() & ((F.col("value").isNull() & F.col("again").isNull()) | F.coalesce(close, F.lit(False)))
    return j.select("indicator", F.when(ok, "OK").otherwise("FAIL").alias("status"))


@plan(_IND + ", " + _AGAIN_SQL + " SELECT indicator, CASE WHEN seen IS NOT NULL AND (value IS NULL AND again IS NULL OR coalesce(abs(value-again)<=0.001*greatest(abs(value),abs(again)),false)) THEN 'OK' ELSE 'FAIL' END AS status FROM ind LEFT JOIN (SELECT *, true AS seen FROM again) USING (indicator)")
def formula_gate(r: Reports) -> DataFrame:
    """Every published indicator against its second figure."""
    e = Edition(r)
    return gated(_indicators(e).select("indicator", "value"), again(e))
