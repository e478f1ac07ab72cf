"""Evidence: published indicators, re-execution, audits, coverage and drift."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import signals as S
from ..operators import snapshots as V
from ..operators import timeseries as T
from ..operators.lineage import cut
from ..sources.analogue import AFTER, BEFORE, CUTOFF, M3, M6, M12, M24, M36, M60, Reports
from . import signals
from .market import DEBTORS_SQL, INDEX_SQL as _INDEX, debtor_metrics, price_levels as _index
from .panel import FLOWS_SQL, MANAGERS_SQL, flows, managers
from .register import plan


@dataclass(frozen=True)
class Source:
    """A table that indicators are taken from: as SQL (extra CTEs, then what follows FROM), as a DataFrame (of the reports of
    the cutoff's month, or of all where it looks at others), and the expressions over it, the same text for both. Each
    indicator: unit, status, expression."""

    ctes: str
    table: str
    frame: Callable[[Reports], DataFrame]
    indicators: dict[str, tuple[str, str, str]]


def _cut(df: DataFrame, month: str = CUTOFF) -> DataFrame:
    return df.where(F.col("dt") == F.lit(month).cast("date"))


def _whole(r: Reports) -> DataFrame:
    tabs = _cut(r.lines).groupBy("cnpj", "dt").agg(F.round(F.sum(F.when(F.col("ln").between(5, 6), F.col("v"))), 2).alias("quotas"))
    hold = _cut(r.debtors).groupBy("cnpj", "dt").agg(F.count("*").alias("n_hold"))
    j = _cut(r.sane)
    for t in (r.assets, r.overdue, tabs, hold):
        j = j.join(t, ["cnpj", "dt"], "left")
    return j


def _real(r: Reports) -> DataFrame:
    idx = _index(r)
    last = idx.agg(F.max_by("idx", "dt").alias("base"))
    return r.sane.groupBy("dt").agg(F.sum("pl").alias("pl")).join(F.broadcast(idx), "dt").crossJoin(F.broadcast(last)).withColumn("real_pl", F.col("pl") / F.col("idx") * F.col("base"))


def _present(r: Reports) -> DataFrame:
    def at(month: str):
        return F.max(F.when(F.col("dt") == F.lit(month).cast("date"), F.col("pl")))

    own = r.sane.where(F.col("dt").isin(*[F.lit(d).cast("date") for d in (BEFORE, CUTOFF, AFTER)]))
    return own.groupBy("cnpj").agg(at(BEFORE).alias("was"), at(CUTOFF).alias("now"), at(AFTER).alias("next"))


def _on(key: str, month: str) -> str:
    return f"max({key}) FILTER (WHERE dt = DATE '{month}')"


def _linked(r: Reports) -> DataFrame:
    held = _cut(r.lines).join(_cut(r.sane).select("cnpj"), "cnpj", "left_semi")
    return held.select("v", F.when(F.col("ln") % 3 == 0, "S").when(F.col("ln") % 3 == 1, "N").alias("linked"))


def _judicial(r: Reports) -> DataFrame:
    j = _cut(r.assignors).where("pr > 0 AND pr <= 100").join(_cut(r.assets).drop("dt"), "cnpj")
    return j.where("ced LIKE '%1'")


SOURCES = {
    "portfolio": Source(
        f"q AS (SELECT cnpj, dt, round(sum(v) FILTER (ln BETWEEN 5 AND 6),2) AS quotas FROM lines WHERE dt='{CUTOFF}' GROUP BY 1,2), nh AS (SELECT cnpj, dt, count(*) AS n_hold FROM debtors WHERE dt='{CUTOFF}' GROUP BY 1,2)",
        f"(SELECT * FROM sane WHERE dt='{CUTOFF}') LEFT JOIN assets USING (cnpj, dt) LEFT JOIN overdue USING (cnpj, dt) LEFT JOIN q USING (cnpj, dt) LEFT JOIN nh USING (cnpj, dt)",
        _whole,
        {
            "pl_total": ("brl", "observed", "sum(pl)"), "pl_liquido": ("brl", "calculated", "sum(pl) - sum(coalesce(quotas, 0))"), "circularidade": ("brl", "observed", "sum(quotas)"), "n_veiculos": ("un", "observed", "count(*)"),
            "posicoes_cotistas": ("un", "observed", "sum(n_hold)"), "dc_total": ("brl", "calculated", "sum(coalesce(dc_risk, 0) + coalesce(dc_norisk, 0))"), "dc_sem_risco": ("brl", "observed", "sum(dc_norisk)"), "aquisicoes_mes": ("brl", "observed", "sum(v_roll)"),
            "inadimplencia": ("%", "calculated", "sum(inad) / nullif(sum(coalesce(inad, 0) + coalesce(dcp, 0)), 0)"), "atraso_180": ("%", "calculated", "sum(coalesce(b1080, 0) + coalesce(bmax, 0)) / nullif(sum(coalesce(dc_risk, 0) + coalesce(dc_norisk, 0)), 0)"), "provisionamento": ("%", "calculated", "sum(b90) / nullif(sum(inad), 0)"),
            "subordinacao": ("%", "calculated", "sum(coalesce(v_mez, 0) + coalesce(v_sub, 0)) / nullif(sum(v_tot), 0)"), "serie_senior": ("brl", "observed", "sum(v_sen)"), "serie_mezanino": ("brl", "observed", "sum(v_mez)"), "serie_subordinada": ("brl", "observed", "sum(v_sub)"),
            "identidade_contabil": ("un", "calculated", "count(*) FILTER (WHERE abs(v_tot - coalesce(dc_risk, 0) - coalesce(dc_norisk, 0)) > 0.011)"), "series_abaixo_esperado": ("un", "calculated", "count(*) FILTER (WHERE v_sen < 0.5 * v_tot)"), "veiculos_com_garantia": ("un", "calculated", "count(*) FILTER (WHERE v_sub > 0)"),
        },
    ),
    "months": Source(
        _INDEX[1:] + ", rl AS (SELECT s.dt, pl, pl/idx.idx*(SELECT idx FROM idx ORDER BY dt DESC LIMIT 1) AS real_pl FROM (SELECT dt, sum(pl) AS pl FROM sane GROUP BY 1) s JOIN idx ON s.dt=idx.dt)",
        "rl",
        _real,
        {f"var_{n}m": ("%", "calculated", f"{_on('pl', CUTOFF)} / nullif({_on('pl', d)}, 0) - 1") for n, d in ((1, BEFORE), (3, M3), (6, M6), (12, M12), (24, M24))} | {"cagr_real": ("%", "calculated", f"power({_on('real_pl', CUTOFF)} / nullif({_on('real_pl', M60)}, 0), 0.2) - 1")},
    ),
    "flows": Source(
        FLOWS_SQL.removeprefix("WITH "),
        f"(SELECT * FROM flows WHERE sane AND last_day(cast(o_orderdate AS date))='{M36}')",
        lambda r: flows(r).where(F.col("sane") & (F.last_day(F.to_date("o_orderdate")) == F.lit(M36).cast("date"))),
        {"captacoes_mes": ("brl", "observed", "sum(amt) FILTER (WHERE op = 'O')"), "resgates_mes": ("brl", "observed", "sum(amt) FILTER (WHERE op <> 'O')")},
    ),
    "presence": Source(
        f"pr3 AS (SELECT cnpj, max(pl) FILTER (dt='{BEFORE}') AS was, max(pl) FILTER (dt='{CUTOFF}') AS now, max(pl) FILTER (dt='{AFTER}') AS next FROM sane WHERE dt IN ('{BEFORE}','{CUTOFF}','{AFTER}') GROUP BY 1)",
        "pr3",
        _present,
        {
            "mudou_entrantes": ("un", "calculated", "count(*) FILTER (WHERE now IS NOT NULL AND was IS NULL)"), "mudou_saintes": ("un", "calculated", "count(*) FILTER (WHERE now IS NULL AND was IS NOT NULL)"), "jul_ausentes": ("un", "calculated", "count(*) FILTER (WHERE now IS NOT NULL AND next IS NULL)"),
            "jul_same_store": ("%", "calculated", "sum(next) FILTER (WHERE now IS NOT NULL) / nullif(sum(now) FILTER (WHERE next IS NOT NULL), 0) - 1"), "jul_pl_ausente": ("brl", "calculated", "sum(now) FILTER (WHERE next IS NULL)"),
        },
    ),
    "debtors": Source(
        DEBTORS_SQL[1:],
        f"(SELECT * FROM dm WHERE dt='{CUTOFF}' AND dc>0)",
        lambda r: _cut(debtor_metrics(r)).where("dc > 0"),
        {"sacado_cobertura_dc": ("%", "calculated", "sum(dc) FILTER (WHERE list_val IS NOT NULL) / nullif(sum(dc), 0)"), "sacado_mediana_top1": ("%", "calculated", "median(top1)"), "sacado_n_top1_50": ("un", "calculated", "count(*) FILTER (WHERE top1 > 0.5)")},
    ),
    "holders": Source(
        f"hl AS (SELECT v, CASE ln%3 WHEN 0 THEN 'S' WHEN 1 THEN 'N' END AS linked FROM lines WHERE dt='{CUTOFF}' AND cnpj IN (SELECT cnpj FROM sane WHERE dt='{CUTOFF}'))",
        "hl",
        _linked,
        {"detido_fundos": ("brl", "observed", "sum(v)"), "emissor_ligado": ("brl", "observed", "sum(v) FILTER (WHERE linked = 'S')")},
    ),
    "processes": Source("", "orders", lambda r: r.table("orders"), {"rj_processos": ("un", "observed", "count(*) FILTER (WHERE o_orderpriority = '1-URGENT')")}),
    "judicial": Source(
        f"jd AS (SELECT a.cnpj, ced, pr, v_tot FROM assignors a JOIN assets s ON a.cnpj=s.cnpj AND a.dt=s.dt WHERE a.dt='{CUTOFF}' AND pr>0 AND pr<=100 AND ced LIKE '%1')",
        "jd",
        _judicial,
        {"rj_vinculos": ("un", "inferred", "count(DISTINCT ced)"), "rj_exposicao": ("brl", "estimated", "sum(pr / 100 * v_tot)"), "rj_casos": ("un", "inferred", "count(DISTINCT CASE WHEN pr >= 20 THEN ced END)")},
    ),
}
#: Sources that look at other months than the cutoff's.
_ALL_MONTHS = ("months", "flows", "presence", "processes")
#: What the signal engine publishes: of the signals active now, and of those of the edition before.
ENGINE = {"mudou_sinais_novos": ("un", "calculated", "count(*) FILTER (WHERE streak_now = 1)"), "mudou_sinais_persistentes": ("un", "calculated", "count(*) FILTER (WHERE streak_now > 1)"), "mudou_sinais_encerrados": ("un", "calculated", "count(*) FILTER (WHERE state = 'closed')")}
BANDS = {"rf_nao_classificavel": ("un", "calculated", "count(*) FILTER (WHERE coverage < 50 OR score IS NULL)"), "rf_atencao_alta": ("un", "calculated", "count(*) FILTER (WHERE band = 'high')"), "rf_sem_sinal": ("un", "calculated", "count(*) FILTER (WHERE coverage >= 50 AND score = 0)"), "rf_n_sinais": ("un", "observed", "max(n_signals)")}


class Edition:
    """What the indicators and their verifiers read, each table written once: the panel, the cutoff's month alone, and the
    snapshots of the edition before and of this one."""

    def __init__(self, r: Reports):
        r.__dict__["sane"] = cut(r.sane)
        self.all, self.month = r, r.only(CUTOFF)
        self.before, self.now = signals.snapshots(r, BEFORE, CUTOFF)

    def bands(self) -> DataFrame:
        """Vehicles with their score and band."""
        return S.bands(S.score(signals.settled_signals(self.all), S.SIGNALS)).withColumn("n_signals", F.lit(len(S.SIGNALS)))


def _stacked(df: DataFrame, found: dict[str, tuple[str, str, str]]) -> DataFrame:
    """A row for each indicator from one aggregation."""
    row = df.agg(*[F.round(F.expr(e).cast("double"), 6).alias(k) for k, (*_, e) in found.items()])
    each = [F.struct(F.lit(k).alias("indicator"), F.lit(u).alias("unit"), F.lit(st).alias("status"), F.col(k).alias("value")) for k, (u, st, _) in found.items()]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def _stacked_sql(table: str, found: dict[str, tuple[str, str, str]]) -> str:
    def several(values: Iterable[str]) -> str:
        return f"unnest([{', '.join(values)}])"

    names, units, states = (several(f"'{x}'" for x in xs) for xs in (found, [u for u, *_ in found.values()], [t for _, t, _ in found.values()]))
    return f"SELECT {names} AS indicator, {units} AS unit, {states} AS status, {several(f'round(cast({e} AS double),6)' for *_, e in found.values())} AS value FROM {table}"


_BANDED = f"(SELECT sc.*, {len(S.SIGNALS)} AS n_signals, CASE WHEN coverage<50 OR score IS NULL THEN 'not classifiable' WHEN score>=p99 AND score>0 THEN 'high' WHEN score>=p90 AND score>0 THEN 'medium' WHEN score>0 THEN 'low' ELSE 'none' END AS band FROM sc CROSS JOIN (SELECT quantile_cont(score,0.9) AS p90, quantile_cont(score,0.99) AS p99 FROM sc WHERE coverage>=50 AND score>0))"
_IND = signals.WIDE_SQL + "".join(f", {s.ctes}" for s in SOURCES.values() if s.ctes) + ", ind AS MATERIALIZED (" + " UNION ALL ".join([*[_stacked_sql(s.table, s.indicators) for s in SOURCES.values()], _stacked_sql(f"(SELECT n.streak AS streak_now, CASE WHEN n.id IS NULL THEN 'closed' END AS state FROM {signals.edition_sql(BEFORE)} b FULL JOIN {signals.ACTIVE_SQL} n ON b.id=n.id AND b.cnpj=n.cnpj)", ENGINE), _stacked_sql(_BANDED, BANDS)]) + ")"


def _indicators(e: Edition) -> DataFrame:
    parts = [_stacked(s.frame(e.all if name in _ALL_MONTHS else e.month), s.indicators) for name, s in SOURCES.items()]
    parts += [_stacked(V.compared(e.before, e.now, ["id", "cnpj"]), ENGINE), _stacked(e.bands(), BANDS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan(_IND + " SELECT indicator, unit, status, value FROM ind")
def indicator_registry(r: Reports) -> DataFrame:
    """The 47 published indicators."""
    return _indicators(Edition(r))


#: The audit: a test's name, what it measures, and the condition under which it passes (else it warns or fails).
_TESTS = {
    "T1_series": ("abs(pl_lines / pl_panel - 1)", "x < 0.001", "FAIL"), "T2_admins": ("abs(pl_admins / pl_panel - 1)", "x < 0.001", "WARN"), "T2b_managers": ("abs(pl_managers / pl_panel - 1)", "x < 0.001", "WARN"), "T3_duplicates": ("n_duplicates", "x = 0", "FAIL"), "T4_cancelled": ("n_cancelled", "x < 30", "WARN"),
    "T5_negative_pl": ("n_negative", "x = 0", "WARN"), "T5b_negative_dc": ("n_negative_dc", "x = 0", "WARN"), "T6_months": ("n_missing", "x = 0", "WARN"), "T7_jump": ("jump", "x < 0.3", "WARN"), "T8_top20": ("20 - n_top", "x <= 1", "FAIL"), "T9_admin_again": ("admin_diff", "x < 0.001", "FAIL"),
    "T10_hhi": ("abs(hhi_a - hhi_b)", "x < 0.000001", "FAIL"), "T11_circular": ("circular / pl_panel", "x < 1", "WARN"), "T12_related": ("n_related", "x >= 0", "WARN"), "T15_series_to_pl": ("abs(series / pl_panel - 1)", "x < 0.01", "WARN"),
}
_FACTS_SQL = f"""@cutp AS (SELECT * FROM sane WHERE dt='{CUTOFF}'), cutl AS (SELECT l.* FROM lines l JOIN cutp s ON l.cnpj=s.cnpj AND l.dt=s.dt AND l.tp=s.tp), adm AS (SELECT admin, sum(pl) AS pl FROM cutp JOIN registry USING (cnpj) GROUP BY 1), adl AS (SELECT admin, sum(v) AS v FROM cutl JOIN registry USING (cnpj) GROUP BY 1), {MANAGERS_SQL}, mon AS (SELECT dt, sum(pl) AS pl FROM sane GROUP BY 1), jm AS (SELECT abs(pl/lag(pl) OVER (ORDER BY dt)-1) AS v FROM mon WHERE dt<='{CUTOFF}'),
ta AS (SELECT cnpj FROM cutp ORDER BY pl DESC, cnpj LIMIT 20), tb AS (SELECT cnpj FROM (SELECT cnpj, sum(v) AS v FROM cutl GROUP BY 1) ORDER BY v DESC, cnpj LIMIT 20),
facts AS (SELECT (SELECT sum(v) FROM cutl) AS pl_lines, (SELECT sum(pl) FROM cutp) AS pl_panel, (SELECT sum(pl) FROM adm) AS pl_admins, (SELECT sum(pl) FROM cutp JOIN managers USING (cnpj)) AS pl_managers, (SELECT count(*) FROM (SELECT cnpj, dt FROM panel GROUP BY 1,2 HAVING count(*)>1)) AS n_duplicates,
 (SELECT count(*) FROM cutp JOIN registry USING (cnpj) WHERE bal<0) AS n_cancelled, (SELECT count(*) FROM cutp WHERE pl<0) AS n_negative, (SELECT count(*) FROM assets WHERE dt='{CUTOFF}' AND (dc_risk<0 OR dc_norisk<0)) AS n_negative_dc, (SELECT datediff('month', min(dt), max(dt))+1-count(*) FROM mon) AS n_missing, (SELECT max(v) FROM jm) AS jump, (SELECT count(*) FROM ta JOIN tb USING (cnpj)) AS n_top,
 (SELECT max(abs(v/pl-1)) FROM adm JOIN adl USING (admin)) AS admin_diff, (SELECT sum(x*x) FROM (SELECT pl/sum(pl) OVER () AS x FROM cutp WHERE pl>0)) AS hhi_a, (SELECT sum(pl*pl)/power(sum(pl),2) FROM cutp WHERE pl>0) AS hhi_b, (SELECT sum(v) FROM cutl WHERE ln BETWEEN 5 AND 6) AS circular, (SELECT count(DISTINCT cnpj) FROM lines WHERE ln=4 AND flag='A' AND dt>'{M12}' AND dt<='{CUTOFF}') AS n_related, (SELECT sum(v_tot) FROM cutp JOIN assets USING (cnpj, dt)) AS series)"""


@plan(_FACTS_SQL + " SELECT test, round(x,6) AS found, status FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS test, x, CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS status FROM (SELECT cast({e} AS double) AS x FROM facts)" for k, (e, ok, bad) in _TESTS.items()) + ")")
def audit_tests(r: Reports) -> DataFrame:
    """Tests T1 to T12 and T15; T13 (files by their hashes) is sources.files.manifest, T14 compares with a figure from
    outside."""
    r.keep("sane")
    now = _cut(r.sane)
    lines = r.lines.join(now.select("cnpj", "dt", "tp"), ["cnpj", "dt", "tp"])
    by_admin = now.join(r.registry, "cnpj").groupBy("admin").agg(F.sum("pl").alias("pl"), F.count_if(F.col("bal") < 0).alias("bad"))
    by_lines = lines.join(r.registry, "cnpj").groupBy("admin").agg(F.sum("v").alias("v"))
    months = r.sane.groupBy("dt").agg(F.sum("pl").alias("pl"))
    jump = months.where(F.col("dt") <= F.lit(CUTOFF).cast("date")).select(F.abs(F.col("pl") / F.lag("pl").over(Window.orderBy("dt")) - 1).alias("v"))
    total = now.where("pl > 0").agg(F.sum("pl").alias("total"))
    per_vehicle = lines.groupBy("cnpj").agg(F.sum("v").alias("v"))
    top = now.select("cnpj", "pl").orderBy(F.desc("pl"), "cnpj").limit(20).join(per_vehicle.orderBy(F.desc("v"), "cnpj").limit(20), "cnpj")
    year = (F.col("dt") > F.lit(M12).cast("date")) & (F.col("dt") <= F.lit(CUTOFF).cast("date"))
    facts = [
        lines.agg(F.sum("v").alias("pl_lines"), F.sum(F.when(F.col("ln").between(5, 6), F.col("v"))).alias("circular")),
        now.agg(F.sum("pl").alias("pl_panel"), F.count_if(F.col("pl") < 0).alias("n_negative"), (F.sum(F.when(F.col("pl") > 0, F.col("pl") * F.col("pl"))) / F.pow(F.sum(F.when(F.col("pl") > 0, F.col("pl"))), F.lit(2))).alias("hhi_b")),
        by_admin.join(by_lines, "admin", "left").agg(F.sum("pl").alias("pl_admins"), F.sum("bad").alias("n_cancelled"), F.max(F.abs(F.col("v") / F.col("pl") - 1)).alias("admin_diff")),
        now.join(managers(r), "cnpj").agg(F.sum("pl").alias("pl_managers")),
        r.panel.groupBy("cnpj", "dt").count().where("count > 1").agg(F.count("*").alias("n_duplicates")),
        _cut(r.assets).agg(F.count_if(F.expr("dc_risk < 0 OR dc_norisk < 0")).alias("n_negative_dc")),
        months.agg((F.months_between(F.max("dt"), F.min("dt")) + 1 - F.count("*")).alias("n_missing")),
        jump.agg(F.max("v").alias("jump")),
        top.agg(F.count("*").alias("n_top")),
        now.where("pl > 0").crossJoin(F.broadcast(total)).agg(F.sum(F.pow(F.col("pl") / F.col("total"), F.lit(2))).alias("hhi_a")),
        r.lines.where(year).where("ln = 4 AND flag = 'A'").agg(F.count_distinct("cnpj").alias("n_related")),
        now.join(r.assets, ["cnpj", "dt"]).agg(F.sum("v_tot").alias("series")),
    ]
    row = facts[0]
    for f in facts[1:]:  # each has one row
        row = row.crossJoin(F.broadcast(f))
    each = [F.struct(F.lit(k).alias("test"), F.expr(e).cast("double").alias("x"), F.lit(ok).alias("ok"), F.lit(bad).alias("bad")) for k, (e, ok, bad) in _TESTS.items()]
    x = row.select(F.explode(F.array(*each)).alias("y")).select("y.*")
    passed = F.lit(False)
    for k, (_, ok, _) in _TESTS.items():
        passed = F.when(F.col("test") == k, F.coalesce(F.expr(ok), F.lit(False))).otherwise(passed)
    return x.select("test", F.round("x", 6).alias("found"), F.when(passed, "PASS").otherwise(F.col("bad")).alias("status"))


#: Fixed patterns of the linter: process numbers, and words that identify a person by role.
_PROCESS, _ROLE = r"[0-9]{5}\.[0-9]{6}/[0-9]{4}-[0-9]{2}|RJ ?[0-9]{4}/[0-9]+", r"\b(her|his|their) (directors?|manager)\b"


@plan(f"SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(lower(coalesce(text,'')), 'condem|convict|condena') AND NOT regexp_matches(coalesce(text,''), '{_PROCESS}')) AS n_unproven, count(*) FILTER (regexp_matches(lower(coalesce(text,'')), '{_ROLE}')) AS n_role, count(*) FILTER (regexp_matches(coalesce(text,''), '^ *Director')) AS n_person FROM documents GROUP BY 1", base=False)
def legal_linter_text(r: Reports) -> DataFrame:
    """Texts that speak of a conviction without a process number, identify someone by role, or open with a role."""
    t = F.coalesce("text", F.lit(""))
    unproven = F.regexp_like(F.lower(t), F.lit("condem|convict|condena")) & ~F.regexp_like(t, F.lit(_PROCESS))
    return r.table("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(unproven).alias("n_unproven"), F.count_if(F.regexp_like(F.lower(t), F.lit(_ROLE))).alias("n_role"), F.count_if(F.regexp_like(t, F.lit("^ *Director"))).alias("n_person"))


@plan("@a AS (SELECT cnpj, pl FROM sane WHERE dt='2001-05-31'), b AS (SELECT cnpj, pl FROM sane WHERE dt='2001-06-30') SELECT coalesce(a.cnpj,b.cnpj) AS cnpj, CASE WHEN a.cnpj IS NULL THEN 'entered' WHEN b.cnpj IS NULL THEN 'left' WHEN md5(cast(cast(round(a.pl) AS bigint) AS varchar))<>md5(cast(cast(round(b.pl) AS bigint) AS varchar)) THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.cnpj=b.cnpj")
def snapshot_diff(r: Reports) -> DataFrame:
    a, b = (r.sane.where(F.col("dt") == F.lit(d).cast("date")).select("cnpj", F.md5(F.round("pl").cast("bigint").cast("string")).alias(n)) for d, n in (("2001-05-31", "a"), ("2001-06-30", "b")))
    return a.join(b, "cnpj", "full").select("cnpj", F.when(F.col("a").isNull(), "entered").when(F.col("b").isNull(), "left").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("state"))


@plan("@m AS (SELECT dt, lag(dt) OVER (ORDER BY dt) AS pv FROM (SELECT DISTINCT dt FROM sane)) SELECT m.dt, count(*) FILTER (NOT EXISTS (SELECT 1 FROM sane p WHERE p.cnpj=s.cnpj AND p.dt=m.pv)) AS entered, count(*) AS n FROM m JOIN sane s ON s.dt=m.dt WHERE pv IS NOT NULL GROUP BY 1")
def entrants_leavers(r: Reports) -> DataFrame:
    m = r.sane.select("dt").distinct().withColumn("pv", F.lag("dt").over(Window.orderBy("dt"))).where("pv IS NOT NULL")
    was = r.sane.withColumn("before", F.lag("dt").over(T.by_month())).join(F.broadcast(m), "dt")
    return was.groupBy("dt").agg(F.count_if(~F.coalesce(F.col("before") == F.col("pv"), F.lit(False))).alias("entered"), F.count("*").alias("n"))


@plan(" SELECT field, filled, total, round(filled/nullif(total,0),6) AS coverage FROM (SELECT unnest(['dc_risk','dc_norisk','v_sen','v_mez','v_sub']) AS field, unnest([count(dc_risk),count(dc_norisk),count(v_sen),count(v_mez),count(v_sub)]) AS filled, count(*) AS total FROM assets)")
def field_coverage(r: Reports) -> DataFrame:
    return P.field_coverage(r.assets, ["dc_risk", "dc_norisk", "v_sen", "v_mez", "v_sub"])


@plan("@h AS (SELECT last_day(dt) AS period, list_sort(list(DISTINCT p_brand)) AS cols FROM lines JOIN part ON l_partkey=p_partkey GROUP BY 1), l AS (SELECT *, lag(cols) OVER (ORDER BY period) AS pv FROM h) SELECT period, list_sort(list_filter(cols, lambda x: NOT list_contains(pv, x))) AS added, list_sort(list_filter(pv, lambda x: NOT list_contains(cols, x))) AS removed FROM l WHERE pv IS NOT NULL")
def schema_drift(r: Reports) -> DataFrame:
    part = r.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    h = r.lines.join(part, "l_partkey").groupBy(F.col("dt").alias("period")).agg(F.sort_array(F.collect_set("p_brand")).alias("columns"))
    return P.header_changes(h).select("period", F.sort_array("added").alias("added"), F.sort_array("removed").alias("removed"))


@plan("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?%')) AS n_percent, regexp_matches(lower(text), 'stupid|pathetic') AS flagged FROM documents", base=False)
def extract_percentages(r: Reports) -> DataFrame:
    t = F.col("text")
    return r.table("documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:[.,][0-9]+)?%"), F.lit(0))).alias("n_percent"), F.regexp_like(F.lower(t), F.lit("stupid|pathetic")).alias("flagged"))


@plan("SELECT c_mktsegment, CASE WHEN count(*)>=5 THEN count(*) END AS n FROM customer WHERE c_acctbal<0 GROUP BY 1", base=False)
def person_suppression_groupby(r: Reports) -> DataFrame:
    g = r.table("customer").where("c_acctbal < 0").groupBy("c_mktsegment").agg(F.count("*").alias("k"))
    return g.select("c_mktsegment", F.when(F.col("k") >= 5, F.col("k")).alias("n"))
