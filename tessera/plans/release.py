"""Releases of the engine's tables: the manifest of one, one that a gate stops, and what changed between editions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import release as L
from ..operators import snapshots as V
from ..sources.analogue import BEFORE, CUTOFF, OUTLIER_FLOOR, OUTLIER_TIMES, Reports
from . import signals
from .register import plan


def _at_cutoff(df: DataFrame) -> DataFrame:
    return df.where(F.col("dt") == F.lit(CUTOFF).cast("date"))


def stages(r: Reports, least_balance: bool = False) -> list[L.Stage]:
    """The chain of publication: the panel, what is derived from it, and the gates between. With ``least_balance`` a gate more,
    which no vehicle with a negative balance passes."""

    def repeated(t: dict[str, DataFrame]) -> DataFrame:
        return t["panel"].groupBy("cnpj", "dt").agg(F.count("*").alias("n")).where("n > 1")

    def market(t: dict[str, DataFrame]) -> DataFrame:
        return t["sane"].groupBy("dt").agg(F.count("*").alias("n"), F.round(F.sum("pl"), 2).alias("pl"))

    def admins(t: dict[str, DataFrame]) -> DataFrame:
        return _at_cutoff(t["sane"]).join(r.registry, "cnpj").groupBy("admin").agg(F.count("*").alias("n"), F.round(F.sum("pl"), 2).alias("pl"))

    def audit(t: dict[str, DataFrame]) -> DataFrame:
        """The market and its administrators tell the same sum and number."""
        whole = _at_cutoff(t["market"]).select("n", "pl")
        parts = t["admins"].agg(F.sum("n").alias("n"), F.sum("pl").alias("pl"))
        told = [d.select(F.lit(k).alias("told"), F.col("n").cast("long").alias("n"), F.round("pl", 0).cast("long").alias("pl")) for k, d in (("market", whole), ("admins", parts))]
        return told[0].unionByName(told[1])

    def ranking(t: dict[str, DataFrame]) -> DataFrame:
        return _at_cutoff(t["sane"]).join(r.registry.select("cnpj", "name"), "cnpj").orderBy(F.desc("pl"), "cnpj").limit(25).select("cnpj", "name", "pl")

    chain = [
        L.Stage("panel", lambda t: r.panel),
        L.Stage("repeated", repeated, ("panel",), gate="n_rows = 0"),
        L.Stage("sane", lambda t: P.sane(t["panel"], OUTLIER_FLOOR, OUTLIER_TIMES), ("panel",), checks={"n_negative": "count_if(pl < 0)", "n_missing": "count_if(pl IS NULL)"}, gate="n_negative = 0 AND n_missing = 0"),
        L.Stage("market", market, ("sane",)),
        L.Stage("admins", admins, ("sane",)),
        L.Stage("audit", audit, ("market", "admins"), checks={"n_gap": "max(n) - min(n)", "pl_gap": "(max(pl) - min(pl)) / max(pl)"}, gate="n_gap = 0 AND pl_gap <= 0.001"),
        L.Stage("ranking", ranking, ("sane",)),
    ]
    if least_balance:
        poor = L.Stage("poor", lambda t: _at_cutoff(t["sane"]).join(r.registry.where("bal < 0"), "cnpj").select("cnpj", "bal"), ("sane",), gate="n_rows = 0")
        chain.insert(4, poor)
    return chain


#: A table's columns by name, as text (double, or any other), for the same content hash in SQL.
_TABLES = {
    "panel": ("panel", {"cnpj": False, "dt": False, "pl": True, "tp": False}),
    "repeated": ("(SELECT cnpj, dt, count(*) AS n FROM panel GROUP BY 1,2 HAVING count(*)>1)", {"cnpj": False, "dt": False, "n": False}),
    "sane": ("sane", {"cnpj": False, "dt": False, "pl": True, "tp": False}),
    "market": ("rmarket", {"dt": False, "n": False, "pl": True}),
    "poor": (f"(SELECT cnpj, bal FROM sane JOIN registry USING (cnpj) WHERE dt='{CUTOFF}' AND bal<0)", {"bal": True, "cnpj": False}),
    "admins": ("radmins", {"admin": False, "n": False, "pl": True}),
    "audit": (f"(SELECT 'market' AS told, n, round(pl,0)::BIGINT AS pl FROM rmarket WHERE dt='{CUTOFF}' UNION ALL SELECT 'admins', sum(n), round(sum(pl),0)::BIGINT FROM radmins)", {"n": False, "pl": False, "told": False}),
    "ranking": (f"(SELECT cnpj, name, pl FROM sane JOIN registry USING (cnpj) WHERE dt='{CUTOFF}' ORDER BY pl DESC, cnpj LIMIT 25)", {"cnpj": False, "name": False, "pl": True}),
}


def _manifest_sql(names: list[str], gates: dict[str, str]) -> str:
    def text(c: str, double: bool) -> str:
        t = f"cast(cast(round({c},6) AS decimal(38,6)) AS varchar)" if double else f"cast({c} AS varchar)"
        return f"coalesce(length({t}) || ':' || {t}, '-')"

    rows = []
    for i, name in enumerate(names, 1):
        table, columns = _TABLES[name]
        hashed = f"coalesce(sum(cast('0x' || substr(md5({' || '.join(text(c, d) for c, d in columns.items())}),1,15) AS bigint)),0)::VARCHAR"
        rows.append(f"SELECT {i} AS position, '{name}' AS stage, {str(name in gates).lower()} AS gate, count(*) AS n_rows, {hashed} AS content_hash, {gates.get(name, 'true')} AS passed FROM {table}")
    return f"""@rmarket AS (SELECT dt, count(*) AS n, round(sum(pl),2) AS pl FROM sane GROUP BY 1), radmins AS (SELECT admin, count(*) AS n, round(sum(pl),2) AS pl FROM sane JOIN registry USING (cnpj) WHERE dt='{CUTOFF}' GROUP BY 1),
told AS ({" UNION ALL ".join(rows)}), seen AS (SELECT *, coalesce(bool_and(passed) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached FROM told)
SELECT position, stage, gate, CASE WHEN NOT reached THEN 'SKIPPED' WHEN passed THEN 'OK' ELSE 'FAILED' END AS status, CASE WHEN reached THEN n_rows END AS n_rows, CASE WHEN reached THEN content_hash END AS content_hash FROM seen"""


_GATES = {"repeated": "count(*)=0", "sane": "coalesce(count(*) FILTER (pl<0 OR pl IS NULL),0)=0", "audit": "max(n)-min(n)=0 AND (max(pl)-min(pl))/max(pl)<=0.001"}
_CHAIN = ["panel", "repeated", "sane", "market", "admins", "audit", "ranking"]


def _manifest(r: Reports, chain: list[L.Stage]) -> DataFrame:
    return L.release(r.spark, chain).manifest(r.spark).select("position", "stage", "gate", "status", "n_rows", "content_hash")


@plan(_manifest_sql(_CHAIN, _GATES))
def release_manifest(r: Reports) -> DataFrame:
    """The manifest of a whole release: every stage with its status, rows and content hash."""
    return _manifest(r, stages(r))


@plan(_manifest_sql([*_CHAIN[:4], "poor", *_CHAIN[4:]], _GATES | {"poor": "count(*)=0"}))
def release_stopped(r: Reports) -> DataFrame:
    """The same with a gate that stops it where a vehicle has a negative balance."""
    return _manifest(r, stages(r, least_balance=True))


@plan(f"SELECT coalesce(n.id, b.id) AS id, coalesce(n.cnpj, b.cnpj) AS cnpj, CASE WHEN b.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'closed' ELSE 'persisting' END AS state, b.streak AS streak_before, n.streak AS streak_now FROM {signals.edition_sql(BEFORE)} b FULL JOIN {signals.edition_sql(CUTOFF)} n ON b.id=n.id AND b.cnpj=n.cnpj")
def closed_signals(r: Reports) -> DataFrame:
    """Signals of the edition before and of this one: new, persisting or closed."""
    before, now = signals.snapshots(r, BEFORE, CUTOFF)
    return V.compared(before, now, ["id", "cnpj"])
