"""Backtest plans: events are vehicles whose panel value falls by more than 80% in a month.

S1 hardly anything overdue beside one large assignor; S2 rolled amounts against the portfolio; S3 little
subordination; S4 a jump of the value; S5 a single interest; S6 one assignor alone. NULL: cannot be evaluated. Limits
fit the derived tables' amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import timeseries as T
from ..operators.lineage import cut
from ..sources.analogue import Reports
from .register import plan

#: The signals' conditions over a vehicle's month; the same text for Spark and DuckDB.
SIGNALS = {
    "s1": "CASE WHEN inad IS NOT NULL AND pr_max IS NOT NULL THEN coalesce(dcp, 0) + inad > 1e3 AND inad < 0.5 * (coalesce(dcp, 0) + inad) AND pr_max >= 50 END",
    "s2": "CASE WHEN v_tot > 0 THEN coalesce(v_roll, 0) / v_tot > 0.15 END",
    "s3": "CASE WHEN v_sub IS NOT NULL THEN v_sub / nullif(v_tot, 0) < 0.25 END",
    "s4": "CASE WHEN prev IS NOT NULL THEN abs(pl / prev - 1) > 0.3 END",
    "s5": "interest = 'S'",
    "s6": "CASE WHEN pr_max IS NOT NULL THEN pr_max >= 80 END",
}
_EV = f"""@topced AS (SELECT cnpj, dt, max(pr) AS pr_max FROM assignors GROUP BY 1,2), months AS (SELECT *, lag(pl) OVER (PARTITION BY cnpj ORDER BY dt) AS prev FROM sane),
sig AS MATERIALIZED (SELECT s.cnpj, s.dt, s.tp, s.pl, {", ".join(f"{e} AS {k}" for k, e in SIGNALS.items())} FROM months s LEFT JOIN overdue USING (cnpj, dt) LEFT JOIN assets USING (cnpj, dt) LEFT JOIN topced USING (cnpj, dt) LEFT JOIN registry USING (cnpj)),
ev AS MATERIALIZED (SELECT cnpj, min(dt) AS event FROM near WHERE pl<0.2*prev AND dt>='1997-01-31' GROUP BY 1)"""


def _signals(r: Reports) -> DataFrame:
    top = r.assignors.groupBy("cnpj", "dt").agg(F.max("pr").alias("pr_max"))
    j = r.sane.withColumn("prev", F.lag("pl").over(T.by_month()))
    for t in (r.overdue, r.assets, top):
        j = j.join(t, ["cnpj", "dt"], "left")
    j = j.join(r.registry.select("cnpj", "interest"), "cnpj", "left")
    return j.select("cnpj", "dt", "tp", "pl", *[F.expr(e).alias(k) for k, e in SIGNALS.items()])


def _events(r: Reports) -> DataFrame:
    n = r.panel.withColumn("prev", F.lag("pl").over(T.by_month())).where("pl < 0.2 * prev AND dt >= date'1997-01-31'")
    return n.groupBy("cnpj").agg(F.min("dt").alias("event"))


@plan(_EV + " SELECT dt, " + ", ".join(f"count({k}) AS e{k[1]}, count(*) FILTER ({k}) AS f{k[1]}" for k in SIGNALS) + " FROM sig GROUP BY 1")
def bt_signals_s1_s6(r: Reports) -> DataFrame:
    return _signals(r).groupBy("dt").agg(*[x for k in SIGNALS for x in (F.count(k).alias(f"e{k[1]}"), F.count_if(k).alias(f"f{k[1]}"))])


_WINDOW = "dt<event AND dt>=last_day((event - INTERVAL 12 MONTH)::date)"


def _before(r: Reports) -> DataFrame:
    return B.before_event(_signals(r), _events(r))


@plan(_EV + f" SELECT cnpj, dt, event FROM sig JOIN ev USING (cnpj) WHERE {_WINDOW}")
def bt_window_no_leak(r: Reports) -> DataFrame:
    return _before(r).select("cnpj", "dt", "event")


_CASES = ", po AS (SELECT 1 AS kase, s.cnpj, s.tp, s.pl FROM sig s JOIN (SELECT cnpj, max(dt) AS dt FROM sig JOIN ev USING (cnpj) WHERE dt<event GROUP BY 1) USING (cnpj, dt)), ca AS (SELECT cnpj AS control, tp, pl AS cpl FROM sig WHERE dt='1998-06-30' AND cnpj NOT IN (SELECT cnpj FROM ev))"
_MATCH = _CASES + ", ma AS (SELECT kase, cnpj, control, row_number() OVER (PARTITION BY kase, cnpj ORDER BY md5(control || '1')) AS k FROM po JOIN ca USING (tp) WHERE cpl>=0.5*pl AND cpl<=2*pl AND control<>cnpj QUALIFY k<=3)"


def _cases(r: Reports) -> tuple[DataFrame, DataFrame]:
    s, ev = _signals(r).select("cnpj", "dt", "tp", "pl"), _events(r)
    last = s.join(ev, "cnpj").where("dt < event").groupBy("cnpj").agg(F.max_by(F.struct("tp", "pl"), "dt").alias("x"))
    return last.select(F.lit(1).alias("case"), "cnpj", "x.tp", "x.pl"), s.where("dt = date'1998-06-30'").join(ev, "cnpj", "left_anti")


@plan(_EV + _MATCH + ' SELECT kase AS "case", cnpj, control, k FROM ma')
def bt_matched_controls(r: Reports) -> DataFrame:
    return B.matched_controls(*_cases(r))


@plan(_EV + _MATCH + " SELECT count(*) AS n FROM (SELECT cnpj FROM ev INTERSECT SELECT control FROM ma)")
def bt_contamination(r: Reports) -> DataFrame:
    return _events(r).select("cnpj").intersect(B.matched_controls(*_cases(r)).select("control")).agg(F.count("*").alias("n"))


_ANY = ", ".join(f"bool_or(coalesce({k},false)) AS {k}" for k in SIGNALS)
_RATES = _EV + f", pv AS (SELECT cnpj, {_ANY}, max(datediff('month', dt, event)) FILTER (s4) AS lead FROM sig JOIN ev USING (cnpj) WHERE {_WINDOW} GROUP BY 1), cv AS (SELECT cnpj, {_ANY} FROM sig WHERE cnpj NOT IN (SELECT cnpj FROM ev) AND dt BETWEEN '1997-07-31' AND '1998-06-30' GROUP BY 1)"


def _groups(r: Reports) -> DataFrame:
    """(grp, cnpj, s1 .. s6, lead): which signals fired in a vehicle's window, positives and controls in one pass."""
    s = _signals(r).join(_events(r), "cnpj", "left")
    near = (F.col("dt") < F.col("event")) & (F.col("dt") >= F.last_day(F.add_months("event", -12)))
    grp = F.when(near, "positive").when(F.col("event").isNull() & F.col("dt").between(F.lit("1997-07-31").cast("date"), F.lit("1998-06-30").cast("date")), "control")
    months = (F.year("event") - F.year("dt")) * 12 + F.month("event") - F.month("dt")
    return s.withColumn("grp", grp).where("grp IS NOT NULL").groupBy("cnpj", "grp").agg(*[F.max(F.coalesce(k, F.lit(False))).alias(k) for k in SIGNALS], F.max(F.when(F.col("s4"), months)).alias("lead"))


@plan(_RATES + " SELECT count(*) AS n, " + ", ".join(f"round(count(*) FILTER ({k})/nullif(count(*),0),6) AS r{k[1]}" for k in SIGNALS) + ", median(lead) AS lead FROM pv")
def bt_rates_lead(r: Reports) -> DataFrame:
    n = F.nullif(F.count("*"), F.lit(0))
    return _groups(r).where("grp = 'positive'").agg(F.count("*").alias("n"), *[F.round(F.count_if(k) / n, 6).alias(f"r{k[1]}") for k in SIGNALS], F.median("lead").alias("lead"))


def _table(r: Reports) -> DataFrame:
    hits = F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).alias("hit")) for k in SIGNALS])
    long = _groups(r).select("grp", F.explode(hits).alias("x")).select("grp", "x.*")
    return long.groupBy("signal").pivot("grp", ["positive", "control"]).agg(F.count_if("hit").alias("hit"), F.count(F.lit(1)).alias("n"))


_HIT = "CASE signal " + " ".join(f"WHEN '{k}' THEN {k}" for k in SIGNALS) + " END"
_TAB = f", tab AS (SELECT signal, (SELECT count(*) FROM pv WHERE {_HIT}) AS a, (SELECT count(*) FROM pv) AS np, (SELECT count(*) FROM cv WHERE {_HIT}) AS c, (SELECT count(*) FROM cv) AS nc FROM (VALUES {', '.join(f"('{k}')" for k in SIGNALS)}) t(signal))"


@plan(_RATES + _TAB + " SELECT signal, round(a/nullif(np,0),6) AS rate_pos, round(c/nullif(nc,0),6) AS rate_ctrl, round((a/nullif(np,0))/nullif(c/nullif(nc,0),0),6) AS lift FROM tab")
def bt_lift_pivot(r: Reports) -> DataFrame:
    rp = F.col("positive_hit") / F.nullif(F.col("positive_n"), F.lit(0))
    rc = F.col("control_hit") / F.nullif(F.col("control_n"), F.lit(0))
    return _table(r).select("signal", F.round(rp, 6).alias("rate_pos"), F.round(rc, 6).alias("rate_ctrl"), F.round(rp / F.nullif(rc, F.lit(0.0)), 6).alias("lift"))


@plan(_RATES + _TAB + ", f AS (SELECT signal, a, np-a AS b, c, nc-c AS d FROM tab), x AS (SELECT *, unnest(range(a, least(a+b,a+c)+1)) AS x FROM f) SELECT signal, a, b, c, d, CASE WHEN (a+b)*(c+d)*(a+c)*(b+d)>0 THEN round(sum(exp(lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(x+1)-lgamma(a+b-x+1)-lgamma(a+c-x+1)-lgamma(d-a+x+1))),4) END AS p FROM x GROUP BY 1,2,3,4,5")
def bt_fisher(r: Reports) -> DataFrame:
    t = _table(r).select("signal", F.col("positive_hit").alias("a"), (F.col("positive_n") - F.col("positive_hit")).alias("b"), F.col("control_hit").alias("c"), (F.col("control_n") - F.col("control_hit")).alias("d"))
    return B.fisher_tail(t)


#: Known events: the day, and the vehicles by their administrator or by a mark in their name.
EVENTS = [("K1", "2000-03-15", "admin", "NATION_7"), ("K2", "1999-08-20", "name", "07"), ("K3", "1998-05-18", "name", "03"), ("K4", "2001-02-10", "admin", "NATION_3")]
_KNOWN_SQL = _EV.replace("@topced", "@known(kase, day, kind, mark) AS (VALUES " + ", ".join(f"('{c}', DATE '{d}', '{k}', '{m}')" for c, d, k, m in EVENTS) + "), topced") + """,
ref AS (SELECT kase, kind, mark, last_day(day) AS event, (SELECT max(dt) FROM sane WHERE dt<last_day(day)) AS ref FROM known),
pos AS MATERIALIZED (SELECT DISTINCT kase, s.cnpj, event, ref, tp, pl FROM ref JOIN sane s ON s.dt=ref LEFT JOIN registry g ON g.cnpj=s.cnpj WHERE CASE kind WHEN 'admin' THEN admin=mark ELSE contains(upper(name), mark) END),
el AS (SELECT p.kase, p.cnpj, list(s.cnpj ORDER BY md5(s.cnpj || p.kase)) AS e FROM pos p JOIN sane s ON s.dt=p.ref AND s.tp=p.tp AND s.pl>=0.5*p.pl AND s.pl<=2*p.pl WHERE s.cnpj NOT IN (SELECT cnpj FROM pos) GROUP BY 1,2),
turn AS (SELECT *, row_number() OVER (PARTITION BY kase ORDER BY cnpj) AS i FROM el),
ctl AS MATERIALIZED (WITH RECURSIVE g(kase, i, cnpj, take, used) AS (SELECT kase, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM known UNION ALL
  SELECT t.kase, t.i, t.cnpj, list_filter(t.e, lambda x: NOT list_contains(g.used, x))[1:3], list_concat(g.used, list_filter(t.e, lambda x: NOT list_contains(g.used, x))[1:3]) FROM g JOIN turn t ON t.kase=g.kase AND t.i=g.i+1)
  SELECT kase, cnpj, unnest(take) AS control, unnest(range(1,len(take)+1)) AS k FROM g)"""


def _known(r: Reports) -> DataFrame:
    """(case, cnpj, event, ref): the vehicles of the known events."""
    events = r.spark.createDataFrame(EVENTS, "case string, day string, kind string, mark string").withColumn("day", F.to_date("day"))
    return B.linked(events, r.sane, r.registry)


@plan(_KNOWN_SQL + ' SELECT kase AS "case", cnpj, event, ref FROM pos')
def bt_events_linked(r: Reports) -> DataFrame:
    return _known(r)


def _controls(r: Reports, known: DataFrame) -> DataFrame:
    return B.matched_without_reuse(*B.of_cases(known, r.sane))


@plan(_KNOWN_SQL + ' SELECT kase AS "case", cnpj, control, k FROM ctl')
def bt_matched_without_reuse(r: Reports) -> DataFrame:
    """The controls of each known event's vehicles; within a case a control serves one of them, and no vehicle of any event serves."""
    return _controls(r, _known(r))


_DETAIL_SQL = _KNOWN_SQL + f""", who AS (SELECT kase, 'positive' AS grp, cnpj FROM pos UNION ALL SELECT kase, 'control', control FROM ctl),
det AS MATERIALIZED (SELECT who.kase, grp, s.cnpj, datediff('month', s.dt, ref) AS ahead, {", ".join(SIGNALS)} FROM who JOIN ref ON ref.kase=who.kase JOIN sig s ON s.cnpj=who.cnpj AND s.dt<event AND s.dt>=last_day((event - INTERVAL 12 MONTH)::date)),
veh AS (SELECT kase, grp, cnpj, signal, bool_or(hit) AS fired, max(ahead) FILTER (hit) AS lead FROM (SELECT kase, grp, cnpj, ahead, unnest([{", ".join(f"'{s}'" for s in SIGNALS)}]) AS signal, unnest([{", ".join(SIGNALS)}]) AS hit FROM det) GROUP BY 1,2,3,4),
rat AS (SELECT kase, signal, grp, count(fired) AS n, count(*) FILTER (fired) AS n_fired, count(*)-count(fired) AS n_not_evaluable, round(count(*) FILTER (fired)/nullif(count(fired),0),6) AS rate, round(count(fired)/count(*),6) AS coverage, median(lead) AS lead FROM veh GROUP BY 1,2,3 HAVING count(fired)>0)"""


def _detail(r: Reports) -> DataFrame:
    """(case, grp, cnpj, ahead, signals): the months before each event, of its vehicles and their controls. A positive among the controls stops the run."""
    known = cut(_known(r))
    controls = cut(_controls(r, known))
    B.check_contamination(known, controls)
    dates = F.broadcast(known.select("case", "event", "ref").distinct())
    who = known.select("case", F.lit("positive").alias("grp"), "cnpj").unionByName(controls.select("case", F.lit("control").alias("grp"), F.col("control").alias("cnpj"))).join(dates, "case")
    months = B.before_event(_signals(r), who)
    ahead = (F.year("ref") - F.year("dt")) * 12 + F.month("ref") - F.month("dt")
    return months.select("case", "grp", "cnpj", ahead.alias("ahead"), *SIGNALS)


@plan(_DETAIL_SQL + ' SELECT kase AS "case", signal, grp, n, n_fired, n_not_evaluable, rate, coverage, lead FROM rat')
def bt_case_rates(r: Reports) -> DataFrame:
    return B.case_rates(_detail(r), list(SIGNALS))


@plan(_DETAIL_SQL + """, f AS (SELECT p.kase, p.signal, p.n_fired AS a, p.n-p.n_fired AS b, c.n_fired AS c, c.n-c.n_fired AS d FROM rat p JOIN rat c ON p.kase=c.kase AND p.signal=c.signal WHERE p.grp='positive' AND c.grp='control'), x AS (SELECT *, unnest(range(a, least(a+b,a+c)+1)) AS x FROM f)
SELECT kase AS "case", signal, round((a/(a+b))/nullif(c/(c+d),0),6) AS lift, CASE WHEN (a+b)*(c+d)*(a+c)*(b+d)>0 THEN round(sum(exp(lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(x+1)-lgamma(a+b-x+1)-lgamma(a+c-x+1)-lgamma(d-a+x+1))),4) END AS p FROM x GROUP BY kase, signal, a, b, c, d""")
def bt_case_contrast(r: Reports) -> DataFrame:
    """Lift and Fisher's p of each signal before each known event."""
    return B.case_contrast(B.case_rates(_detail(r), list(SIGNALS)))
