"""The signal engine over the report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import signals as S
from ..operators import snapshots as V
from ..operators import timeseries as T
from ..operators.lineage import cut, shared_folder
from ..sources.analogue import CUTOFF, GRID_FROM, Reports
from .register import plan

_IDS = S.SIGNALS


#: What the smaller report tables hold, as sums over a vehicle's lines of a month; the same text for Spark and DuckDB.
_TABS = {
    "perform": "round(sum(v) FILTER (WHERE flag = 'N' AND ln = 1), 2)",
    "rent_min": "min(round(100 * tax - 1, 6)) FILTER (WHERE flag = 'N')",
    "rent_max": "max(round(100 * tax - 1, 6)) FILTER (WHERE flag = 'N')",
    **{f"seg{i}": f"coalesce(round(sum(v) FILTER (WHERE ln = {i}), 2), 0.0)" for i in range(1, 8)},
    "quotas": "coalesce(round(sum(v) FILTER (WHERE ln BETWEEN 5 AND 6), 2), 0.0)",
    "total": "round(sum(v) FILTER (WHERE ln <= 6), 2)",
    "book": "round(sum(v), 2)",
    "lots": "floor(sum(qty) / 400)",
    "in_court": "round(sum(v) FILTER (WHERE ln = 7 AND flag = 'R'), 2)",
    "sg_court": "coalesce(round(sum(v) FILTER (WHERE ln >= 6), 2), 0.0)",
    "rated_low": "coalesce(round(sum(v) FILTER (WHERE tax >= 0.05), 2), 0.0)",
    "rated": "round(sum(v), 2)",
    "tax_debt": "round(sum(v * tax) FILTER (WHERE tax >= 0.08), 2)",
    "admin_code": "min(l_orderkey) % 5",
    "related": "round(sum(v) FILTER (WHERE ln = 4 AND flag = 'A'), 2)",
    "sold": "round(sum(v) FILTER (WHERE ln = 3 AND flag = 'R'), 2)",
    "sold_book": "round(sum(v * (1 + 15 * tax)) FILTER (WHERE ln = 3 AND flag = 'R'), 2)",
    "poor": "round(sum(v) FILTER (WHERE flag = 'A' AND qty < 10), 2)",
    "liq0": "round(sum(v) FILTER (WHERE ln = 1 AND flag = 'A'), 2)",
    "liq30": "round(sum(v) FILTER (WHERE ln = 2 AND flag = 'A'), 2)",
}
_TABS_SQL = ", ".join(f"{e} AS {n}" for n, e in _TABS.items())

#: What the registry tells of a vehicle.
_ROLES = {
    "name": "name",
    "form": "CASE WHEN gestor % 2 = 0 THEN 'ABERTO' ELSE 'FECHADO' END",
    "interest": "interest",
    "exclusive": "CASE WHEN bal > 5000 THEN 'S' ELSE 'N' END",
    "same_party": "CASE WHEN gestor = length(admin) - 4 THEN 1.0 ELSE 0.0 END",
    "measure": "CASE WHEN name LIKE '%7' THEN 1.0 ELSE 0.0 END",
    "no_provider": "CASE WHEN nullif(region, 'ASIA') IS NULL THEN 1.0 ELSE 0.0 END",
    "closing": "CASE WHEN bal < 0 THEN 1.0 ELSE 0.0 END",
}
_ROLES_SQL = ", ".join(f"{e} AS {n}" for n, e in _ROLES.items())

#: Each row's own derivations.
_OWN = {"sg_max": "greatest(seg1, seg2, seg3, seg4, seg5, seg6, seg7)", "sg_sum": "seg1 + seg2 + seg3 + seg4 + seg5 + seg6 + seg7"}
_OWN_SQL = ", ".join(f"{e} AS {n}" for n, e in _OWN.items())

#: What the windows over a vehicle's months read.
_MOVING = ["cnpj", "dt", "pl", "book", "lots", "admin_code", "inad", "base", "v_sub", "v_tot", "v_sen", "v_mez", "related", "poor"]


def _facts(r: Reports) -> DataFrame:
    """What a vehicle's reports of a month say, from the grid's first month on."""
    own = F.col("dt") >= F.lit(GRID_FROM).cast("date")
    own = own & (F.col("dt") <= F.lit(CUTOFF).cast("date"))
    lines, late = r.lines.where(own), r.late.where(own)
    ced = r.assignors.where(own).groupBy("cnpj", "dt").agg(F.max("pr").alias("pr_max"), F.sum(F.col("pr") * F.col("pr")).alias("hhi_ced"), F.sum("pr").alias("pr_sum"), F.count("*").alias("n_ced"), F.count_if(F.col("pr") > 60).alias("n_bad"), F.max(F.when(F.col("val") % 7 < 1, F.col("pr"))).alias("pr_person"))
    # amounts overdue and the number of listed debtors from one shuffle of the lines with their orders; a vehicle's few lines of a
    # month lie in all files, so that sums by file would be as many rows and wider
    by = ["cnpj", "dt"]
    debts = late.select(*by, "deb", "late", "v").repartition(*by).groupBy(*by, "deb").agg(*[F.sum(x).alias(n) for n, x in r.bands().items()])
    debts = debts.groupBy("cnpj", "dt").agg(*[F.round(F.sum(n), 2).alias(n) for n in r.bands()], F.least(F.count("*"), F.lit(25)).alias("n_hold"))
    tabs = lines.select(*by, "v", "flag", "qty", "tax", "ln", "l_orderkey").repartition(*by).groupBy(*by).agg(*[x.alias(n) for n, x in r.amounts().items()], *[F.expr(e).alias(n) for n, e in _TABS.items()])
    return tabs.join(debts, ["cnpj", "dt"], "left").join(ced, ["cnpj", "dt"], "left")


def _wide(r: Reports, cutoff: str = CUTOFF, earlier: tuple[str, ...] = ()) -> DataFrame:
    """The months that signals look at; for each earlier cutoff also gaps_<i> and told_<i>, the gaps as they were then and whether the
    vehicle had reported: all else of a month is the same in every edition that holds it, as windows look back."""
    own = F.col("dt").between(F.lit(GRID_FROM).cast("date"), F.lit(cutoff).cast("date"))
    facts = _facts(r).where(own)
    grid = T.densify(r.sane.where(own).select("cnpj", "dt", "pl"), r.lines.where(own).select("dt").distinct())
    for i, c in enumerate(earlier):
        then = F.max(F.col("obs") & (F.col("dt") <= F.lit(c).cast("date"))).over(Window.partitionBy("cnpj"))
        grid = T.interior_gaps(grid, c).drop("gap").withColumnRenamed("gaps", f"gaps_{i}").withColumn(f"told_{i}", then)
    grid = T.interior_gaps(grid).drop("gap")
    j = grid.join(facts, ["cnpj", "dt"], "left")
    j = j.join(r.registry.select("cnpj", *[F.expr(e).alias(n) for n, e in _ROLES.items()]), "cnpj", "left")
    z = F.lit(0.0)
    j = j.withColumns({n: F.expr(e) for n, e in _OWN.items()})
    j = j.withColumns({"dc": F.when(F.col("v_tot").isNotNull(), F.coalesce("dc_risk", z) + F.coalesce("dc_norisk", z)), "prov": F.coalesce("b90", z), "inad_long": F.coalesce("bmax", z), "base": F.coalesce("dcp", z) + F.coalesce("inad", z)})
    w = T.by_month()
    # what no window reads goes through them as one column
    moved = [c for c in j.columns if c not in _MOVING]
    j = T.stagnation(j.select(*_MOVING, F.struct(*moved).alias("rest")), "lots")

    def grown(c: str):
        return F.ln(F.when(F.lag(c, 12).over(w) > 0, F.when(F.col(c) > 0, F.col(c) / F.lag(c, 12).over(w))))

    sub = F.coalesce("v_sub", z) / F.nullif(F.col("v_tot"), z)
    tx = F.col("inad") / F.nullif(F.col("base"), z)
    j = j.withColumns({"tx": tx, "subord": sub})
    return j.withColumns({
        "d_inad_12": F.col("tx") - F.lag("tx", 12).over(w), "d_subord_12": F.col("subord") - F.lag("subord", 12).over(w), "pl_1": F.lag("pl", 1).over(w), "pl_12": F.lag("pl", 12).over(w),
        "aq_12m": T.rolling(F.col("v_sen")), "roll_12m": T.rolling(F.col("v_mez")), "med_12": T.rolling_mean(F.col("v_tot")),
        "related_12m": T.rolling(F.coalesce("related", z)), "poor_12m": T.rolling(F.coalesce("poor", z)), "shift_12": grown("pl") - grown("book"),
        "new_admin": (F.col("admin_code") != F.lag("admin_code", 12).over(w)).cast("double"),
    }).withColumn("var_m", F.col("pl") / F.nullif(F.col("pl_1"), z) - 1).where(F.col("dt") >= F.lit("2000-06-30").cast("date")).select("*", "rest.*").drop("rest")


_ROLL = "CASE WHEN count({c}) OVER w12>=10 THEN sum({c}) OVER w12/count({c}) OVER w12*12 END"
WIDE_SQL = f"""@mon AS (SELECT DISTINCT dt FROM lines WHERE dt BETWEEN '{GRID_FROM}' AND '{CUTOFF}'), thin AS (SELECT cnpj, dt, pl FROM sane WHERE dt BETWEEN '{GRID_FROM}' AND '{CUTOFF}'),
g0 AS (SELECT c.cnpj, m.dt, s.pl, s.pl IS NOT NULL AS obs FROM (SELECT DISTINCT cnpj FROM thin) c CROSS JOIN mon m LEFT JOIN thin s ON s.cnpj=c.cnpj AND s.dt=m.dt),
g1 AS (SELECT *, min(dt) FILTER (obs) OVER (PARTITION BY cnpj) AS f, max(dt) FILTER (obs) OVER (PARTITION BY cnpj) AS l FROM g0),
g2 AS (SELECT *, sum(CASE WHEN NOT obs AND dt>f AND dt<l THEN 1 ELSE 0 END) OVER (PARTITION BY cnpj ORDER BY dt) AS gaps FROM g1),
ced AS (SELECT cnpj, dt, max(pr) AS pr_max, sum(pr*pr) AS hhi_ced, sum(pr) AS pr_sum, count(*) AS n_ced, count(*) FILTER (pr>60) AS n_bad, max(pr) FILTER (val%7<1) AS pr_person FROM assignors GROUP BY 1,2), hold AS (SELECT cnpj, dt, count(*) AS n_hold FROM debtors GROUP BY 1,2),
tabs AS (SELECT cnpj, dt, {_TABS_SQL} FROM lines GROUP BY 1,2), roles AS (SELECT cnpj, {_ROLES_SQL} FROM registry),
j AS (SELECT g2.cnpj, g2.dt, pr_sum, n_ced, n_bad, pr_person, tabs.* EXCLUDE (cnpj, dt), roles.* EXCLUDE (cnpj), {_OWN_SQL}, pl, obs, gaps, v_sen, v_mez, v_sub, v_tot, inad, pr_max, hhi_ced, n_hold, dc_risk, CASE WHEN v_tot IS NOT NULL THEN coalesce(dc_risk,0)+coalesce(dc_norisk,0) END AS dc, coalesce(b90,0) AS prov, coalesce(bmax,0) AS inad_long, coalesce(dcp,0)+coalesce(inad,0) AS base
 FROM g2 LEFT JOIN assets USING (cnpj, dt) LEFT JOIN overdue USING (cnpj, dt) LEFT JOIN ced USING (cnpj, dt) LEFT JOIN hold USING (cnpj, dt) LEFT JOIN tabs USING (cnpj, dt) LEFT JOIN roles USING (cnpj)),
eq AS (SELECT *, CASE WHEN lots=lag(lots) OVER (PARTITION BY cnpj ORDER BY dt) THEN 1 ELSE 0 END AS eq FROM j), isl AS (SELECT *, sum(1-eq) OVER (PARTITION BY cnpj ORDER BY dt) AS isl FROM eq),
j2 AS (SELECT * EXCLUDE (eq, isl), sum(eq) OVER (PARTITION BY cnpj, isl ORDER BY dt) AS same, inad/nullif(base,0) AS tx, coalesce(v_sub,0)/nullif(v_tot,0) AS subord FROM isl),
wide AS MATERIALIZED (SELECT * FROM (SELECT *, tx-lag(tx,12) OVER w AS d_inad_12, subord-lag(subord,12) OVER w AS d_subord_12, lag(pl,1) OVER w AS pl_1, lag(pl,12) OVER w AS pl_12, pl/nullif(lag(pl,1) OVER w,0)-1 AS var_m,
 {_ROLL.format(c='v_sen')} AS aq_12m, {_ROLL.format(c='v_mez')} AS roll_12m, {_ROLL.format(c='coalesce(related,0)')} AS related_12m, {_ROLL.format(c='coalesce(poor,0)')} AS poor_12m, ln(CASE WHEN lag(pl,12) OVER w>0 AND pl>0 THEN pl/lag(pl,12) OVER w END)-ln(CASE WHEN lag(book,12) OVER w>0 AND book>0 THEN book/lag(book,12) OVER w END) AS shift_12, cast(admin_code<>lag(admin_code,12) OVER w AS double) AS new_admin, CASE WHEN count(v_tot) OVER w12>=10 THEN avg(v_tot) OVER w12 END AS med_12 FROM j2
 WINDOW w AS (PARTITION BY cnpj ORDER BY dt), w12 AS (PARTITION BY cnpj ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE dt>='2000-06-30'),
lf AS MATERIALIZED (SELECT cnpj, dt, x.* FROM (SELECT cnpj, dt, unnest([{', '.join("{'id': '" + s.id + "', 'value': cast(" + s.value + " AS double), 'grp': coalesce(" + s.group + ", false), 'evaluable': coalesce(" + s.can() + ", false), 'material': coalesce(" + s.material + ", false)}" for s in _IDS)}]) AS x FROM wide)),
ids AS (SELECT * FROM (VALUES {','.join(f"('{s.id}','{s.kind}',{s.limit},{str(s.up).lower()},{s.weight},{s.months},{str(s.observed).lower()})" for s in _IDS)}) AS t(id, kind, q, up, weight, months, observed)),
qs AS (SELECT id, count(value) AS n, {', '.join(f"quantile_cont(value, {q}) AS q{round(100 * q)}" for q in sorted({s.limit for s in _IDS if s.kind == 'pct'}))} FROM lf WHERE dt='{CUTOFF}' AND grp AND evaluable AND material GROUP BY 1),
lim AS MATERIALIZED (SELECT ids.id, CASE WHEN kind<>'pct' THEN cast(q AS double) WHEN n>=30 THEN CASE round(100*q) {' '.join(f"WHEN {round(100 * q)} THEN q{round(100 * q)}" for q in sorted({s.limit for s in _IDS if s.kind == 'pct'}))} END END AS lim, coalesce(n,0) AS n FROM ids LEFT JOIN qs USING (id)),
fi AS MATERIALIZED (SELECT lf.*, lim.lim, coalesce(evaluable AND grp AND material AND CASE WHEN up THEN value>=lim.lim ELSE value<=lim.lim END,false) AS fired FROM lf JOIN lim USING (id) JOIN ids USING (id)),
st0 AS (SELECT *, max(dt) FILTER (NOT fired) OVER (PARTITION BY cnpj, id) AS stop FROM fi), st AS (SELECT cnpj, id, count(*) FILTER (stop IS NULL OR dt>stop) AS streak FROM st0 GROUP BY 1,2),
sc AS (SELECT cnpj, round(100.0*coalesce(sum(weight) FILTER (fired AND streak>=months),0)/nullif(sum(weight) FILTER (evaluable),0),2) AS score, round(100.0*count(*) FILTER (evaluable)/count(*),2) AS coverage, count(*) FILTER (fired AND streak>=months) AS n_fired
 FROM fi JOIN st USING (cnpj, id) JOIN ids USING (id) WHERE dt='{CUTOFF}' GROUP BY 1)"""


def _long(r: Reports) -> DataFrame:
    return S.long_form(_wide(r), _IDS)


def kept_wide(r: Reports, cutoff: str = CUTOFF) -> DataFrame:
    """The edition's months, written once: read for the limits and for what they are held against."""
    kept = r.__dict__.setdefault("kept_wide", {})
    if cutoff not in kept:
        kept[cutoff] = cut(_wide(r, cutoff))
    return kept[cutoff]


def keep_editions(r: Reports, *cutoffs: str) -> None:
    """Writes the months of several editions once: an earlier one is a part of the latest."""
    *earlier, last = sorted(set(cutoffs))
    every = cut(_wide(r, last, tuple(earlier)))
    extra = [f"{k}_{i}" for i in range(len(earlier)) for k in ("gaps", "told")]
    kept = r.__dict__.setdefault("kept_wide", {})
    kept[last] = every.drop(*extra)
    for i, c in enumerate(earlier):
        kept[c] = every.where((F.col("dt") <= F.lit(c).cast("date")) & F.col(f"told_{i}")).withColumn("gaps", F.col(f"gaps_{i}")).drop(*extra)


def settled_signals(r: Reports, cutoff: str = CUTOFF) -> DataFrame:
    """Each vehicle's signals at the cutoff: (cnpj, id, fired, evaluable, streak)."""
    wide = kept_wide(r, cutoff)
    return S.state(wide, S.thresholds(wide, _IDS, cutoff), _IDS, cutoff)


def active_signals(r: Reports, cutoff: str = CUTOFF) -> DataFrame:
    """What an edition publishes: (id, cnpj, streak) of the signals that fire at its cutoff."""
    return settled_signals(r, cutoff).where("fired").select("id", "cnpj", "streak")


def _at(df: DataFrame) -> DataFrame:
    return df.where(F.col("dt") == F.lit(CUTOFF).cast("date"))


def _scores(r: Reports) -> DataFrame:
    return S.score(settled_signals(r), _IDS)


@plan(WIDE_SQL + " SELECT id, round(lim,6) AS lim, n FROM lim")
def signal_thresholds(r: Reports) -> DataFrame:
    return S.thresholds(_wide(r), _IDS, CUTOFF).select("id", F.round("lim", 6).alias("lim"), "n")


@plan(WIDE_SQL + f" SELECT id, cnpj, round(value,6) AS value, grp, evaluable, material FROM lf WHERE dt='{CUTOFF}'")
def signal_long_form(r: Reports) -> DataFrame:
    return _at(_long(r)).select("id", "cnpj", F.round("value", 6).alias("value"), "grp", "evaluable", "material")


@plan(WIDE_SQL + f" SELECT id, count(*) FILTER (grp) AS n_group, count(*) AS n_universe, count(*) FILTER (evaluable) AS n_evaluable, count(*) FILTER (evaluable AND material) AS n_material, round(100.0*count(*) FILTER (evaluable)/count(*),2) AS coverage FROM lf WHERE dt='{CUTOFF}' GROUP BY 1")
def signal_catalog_stats(r: Reports) -> DataFrame:
    g = _at(_long(r)).groupBy("id")
    return g.agg(F.count_if("grp").alias("n_group"), F.count("*").alias("n_universe"), F.count_if("evaluable").alias("n_evaluable"), F.count_if(F.col("evaluable") & F.col("material")).alias("n_material"), F.round(100.0 * F.count_if("evaluable") / F.count("*"), 2).alias("coverage"))


#: Up to the firings, without what only the scores need; then each signal's months since its last stop.
_FIRED_SQL = WIDE_SQL[: WIDE_SQL.index("st0 AS (")].rstrip().removesuffix(",")
ACTIVE_SQL = f"(SELECT id, cnpj, count(*) FILTER (stop IS NULL OR dt>stop) AS streak FROM (SELECT id, cnpj, dt, fired, max(dt) FILTER (NOT fired) OVER (PARTITION BY cnpj, id) AS stop FROM fi) GROUP BY 1,2 HAVING bool_or(fired) FILTER (dt='{CUTOFF}'))"


@plan(_FIRED_SQL + f" SELECT id, cnpj, streak, streak>=months AS persistent FROM {ACTIVE_SQL} JOIN ids USING (id)")
def signals_fired(r: Reports) -> DataFrame:
    months = F.create_map(*[x for s in _IDS for x in (F.lit(s.id), F.lit(s.months))])
    return active_signals(r).withColumn("persistent", F.col("streak") >= months[F.col("id")])


def edition_sql(cutoff: str) -> str:
    """The signals active in the edition of another cutoff, as a subquery with CTEs of its own."""
    return f"(WITH {_FIRED_SQL.removeprefix('@')} SELECT * FROM {ACTIVE_SQL})".replace(f"'{CUTOFF}'", f"'{cutoff}'")


_SNAPSHOT = "id string, cnpj string, streak long"


def snapshots(r: Reports, *cutoffs: str) -> tuple[DataFrame, DataFrame]:
    """The active signals of the editions at the cutoffs, each stored as a snapshot, and of these the latest two."""
    folder = f"{shared_folder(r.spark)}/snapshots-{uuid.uuid4().hex}"
    keep_editions(r, *cutoffs)
    for cutoff in cutoffs:
        V.append(active_signals(r, cutoff), folder, cutoff)
    return V.latest_two(r.spark, folder, _SNAPSHOT)


@plan(WIDE_SQL + " SELECT cnpj, score, coverage, n_fired FROM sc")
def score_vehicle(r: Reports) -> DataFrame:
    return _scores(r)


@plan(WIDE_SQL + ", cuts AS (SELECT quantile_cont(score,0.9) AS p90, quantile_cont(score,0.99) AS p99 FROM sc WHERE coverage>=50 AND score>0) SELECT cnpj, score, coverage, CASE WHEN coverage<50 OR score IS NULL THEN 'not classifiable' WHEN score>=p99 AND score>0 THEN 'high' WHEN score>=p90 AND score>0 THEN 'medium' WHEN score>0 THEN 'low' ELSE 'none' END AS band FROM sc CROSS JOIN cuts")
def score_bands(r: Reports) -> DataFrame:
    return S.bands(_scores(r))


@plan(WIDE_SQL + f""" SELECT cnpj, count(*) FILTER (evaluable) AS n_evaluable, count(*) FILTER (fired) AS n_fired, count(*) FILTER (fired AND streak>=months) AS n_persistent, count(*) FILTER (fired AND streak>=months AND weight=10) AS n_critical, count(*) FILTER (fired AND streak>=months AND weight=6) AS n_high,
count(*) FILTER (fired AND observed) AS n_observed, count(*) FILTER (fired AND NOT observed) AS n_derived, round(count(*) FILTER (fired AND observed)/nullif(count(*) FILTER (fired),0),3) AS strength, round(avg(streak) FILTER (fired),4) AS mean_streak FROM fi JOIN st USING (cnpj, id) JOIN ids USING (id) WHERE dt='{CUTOFF}' GROUP BY 1""")
def score_dimensions(r: Reports) -> DataFrame:
    return S.dimensions(settled_signals(r), _IDS)


_STAKES_SQL = f"stk AS (SELECT cnpj, unnest([{', '.join(repr(k) for k in S.STAKES)}]) AS id, unnest([{', '.join(f'cast({e} AS double)' for e in S.STAKES.values())}]) AS stake FROM wide WHERE dt='{CUTOFF}')"


@plan(WIDE_SQL + f", {_STAKES_SQL} SELECT cnpj, round(max(stake) FILTER (fired),2) AS stake_max, round(coalesce(sum(stake) FILTER (fired),0),2) AS stake_sum, max(dt) FILTER (fired) AS current FROM fi LEFT JOIN stk USING (cnpj, id) WHERE dt='{CUTOFF}' GROUP BY 1")
def score_stakes(r: Reports) -> DataFrame:
    """The amounts at stake of each vehicle's signals, and how current they are."""
    settled = settled_signals(r)
    return S.stakes(kept_wide(r), settled, CUTOFF)


@plan("@v AS (SELECT cnpj, dt, inad FROM overdue WHERE dt='2001-06-30'), c AS (SELECT cnpj, dt, max(pr) AS pr FROM assignors WHERE dt='2001-06-30' GROUP BY 1,2) SELECT coalesce(v.cnpj,c.cnpj) AS cnpj, round(inad,2) AS inad, pr, coalesce(inad<1,true) AND coalesce(pr>=50,false) AS rf1 FROM v FULL JOIN c ON v.cnpj=c.cnpj")
def rf1_full_join(r: Reports) -> DataFrame:
    v = _at(r.overdue).select("cnpj", "inad")
    c = _at(r.assignors).groupBy("cnpj").agg(F.max("pr").alias("pr"))
    return v.join(c, "cnpj", "full").select("cnpj", F.round("inad", 2).alias("inad"), "pr", F.expr("coalesce(inad < 1, true) AND coalesce(pr >= 50, false)").alias("rf1"))


@plan("SELECT cnpj, dt, round(pl/prev-1,5) AS fall FROM near WHERE pl<0.5*prev")
def rf4_fall(r: Reports) -> DataFrame:
    w = T.by_month()
    return r.panel.withColumn("prev", F.lag("pl").over(w)).where("pl < 0.5 * prev").select("cnpj", "dt", F.round(F.col("pl") / F.col("prev") - 1, 5).alias("fall"))


@plan("SELECT c_custkey FROM customer WHERE upper(c_name) LIKE '%11%' OR upper(c_mktsegment) LIKE '%BUILD%'", base=False)
def rf6_name_match(r: Reports) -> DataFrame:
    return r.table("customer").where(F.upper("c_name").contains("11") | F.upper("c_mktsegment").contains("BUILD")).select("c_custkey")


@plan("SELECT gestor, count(DISTINCT near.cnpj) AS n_flagged FROM near JOIN registry USING (cnpj) WHERE pl<0.5*prev GROUP BY 1")
def rf_by_manager(r: Reports) -> DataFrame:
    return rf4_fall(r).join(r.registry, "cnpj").groupBy("gestor").agg(F.count_distinct("cnpj").alias("n_flagged"))
