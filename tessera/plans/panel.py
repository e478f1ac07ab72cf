"""Canonical panel and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import panel as P
from ..sources.analogue import OUTLIER_FLOOR, OUTLIER_TIMES, Reports
from .register import plan

_LAST = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@plan(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cast(l_shipdate AS date) AS ship FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LAST.split(', '))})=1", base=False)
def dedup_keep_last(r: Reports) -> DataFrame:
    kept = P.keep_last(r.table("lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _LAST.split(", ")])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("ship"))


@plan("SELECT sum(n)::BIGINT AS rows_read, count(*) AS rows_kept, (sum(n)-count(*))::BIGINT AS rows_removed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)", base=False)
def dedup_log(r: Reports) -> DataFrame:
    return P.dedup_log(r.table("lineitem"), ["l_orderkey", "l_linenumber"])


@plan("SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem", base=False)
def full_row_distinct(r: Reports) -> DataFrame:
    return r.table("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates()


@plan("SELECT cnpj, dt, tp, pl FROM rule_i")
def panel_rule_i(r: Reports) -> DataFrame:
    return P.class_over_fund(r.pl)


@plan("SELECT p.cnpj, p.dt, p.tp, p.pl FROM pl p WHERE NOT (tp='Fundo' AND EXISTS (SELECT 1 FROM pl c JOIN class_map m ON c.cnpj=m.classe WHERE c.tp='Classe' AND m.fundo=p.cnpj AND c.dt=p.dt))")
def panel_rule_ii(r: Reports) -> DataFrame:
    return P.drop_covered_funds(r.pl, r.class_map)


@plan("SELECT cnpj, dt, tp, pl FROM panel")
def panel_canonical(r: Reports) -> DataFrame:
    return r.panel


@plan('SELECT cnpj, dt, tp, pl, prev, nxt AS "next" FROM outl')
def pl_outliers(r: Reports) -> DataFrame:
    return P.outliers(r.panel, OUTLIER_FLOOR, OUTLIER_TIMES)


@plan("SELECT cnpj, dt, tp, pl FROM sane")
def panel_sane(r: Reports) -> DataFrame:
    return r.sane


@plan("SELECT classe, fundo FROM class_map WHERE classe<>fundo")
def class_fund_map(r: Reports) -> DataFrame:
    return r.class_map.where("classe <> fundo").distinct()


#: A vehicle's manager: that of its class before its own, non-negative balances before others.
MANAGERS_SQL = """mg AS (SELECT cnpj, 'a' AS regime, gestor, bal FROM registry UNION ALL SELECT fundo, 'b', gestor+10, bal FROM class_map JOIN registry ON classe=cnpj),
managers AS (SELECT cnpj, regime, gestor FROM mg QUALIFY row_number() OVER (PARTITION BY cnpj ORDER BY CASE regime WHEN 'a' THEN 1 ELSE 0 END, CASE WHEN bal>=0 THEN 0 ELSE 1 END, bal DESC, gestor)=1)"""


def managers(r: Reports) -> DataFrame:
    own = r.registry.select("cnpj", F.lit("a").alias("regime"), "gestor", "bal")
    via = r.class_map.join(r.registry, r.class_map["classe"] == r.registry["cnpj"]).select(F.col("fundo").alias("cnpj"), F.lit("b").alias("regime"), (F.col("gestor") + 10).alias("gestor"), "bal")
    w = Window.partitionBy("cnpj").orderBy(F.when(F.col("regime") == "a", 1).otherwise(0), F.when(F.col("bal") >= 0, 0).otherwise(1), F.desc("bal"), "gestor")
    return own.unionByName(via).withColumn("n", F.row_number().over(w)).where("n = 1").select("cnpj", "regime", "gestor")


@plan("@" + MANAGERS_SQL + " SELECT cnpj, regime, gestor FROM managers")
def manager_resolution_after_union(r: Reports) -> DataFrame:
    return managers(r)


@plan("SELECT c_custkey, CASE WHEN length(d)>=12 THEN lpad(d,14,'0') WHEN length(d)>=11 THEN lpad(d,11,'0') END AS doc FROM (SELECT c_custkey, regexp_replace(c_name || cast(c_custkey*7919 AS varchar),'\\D','','g') AS d FROM customer)", base=False)
def doc_normalize_lpad(r: Reports) -> DataFrame:
    return r.table("customer").select("c_custkey", N.document_id(F.concat("c_name", (F.col("c_custkey") * 7919).cast("string"))).alias("doc"))


@plan("SELECT s_suppkey, regexp_replace(s_name,'\\D','','g') AS digits FROM supplier", base=False)
def digits_only(r: Reports) -> DataFrame:
    return r.table("supplier").select("s_suppkey", N.digits_only(F.col("s_name")).alias("digits"))


_SERIES = ["Sênior 1", "Subclasse Subordinada Mezanino", "Subclasse Subordinada", "Única", "XPTO"]


@plan("SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN 'senior' WHEN 1 THEN 'mezanino' WHEN 2 THEN 'subordinada' WHEN 3 THEN 'classe_unica' WHEN 4 THEN 'outra' ELSE 'nao_informado' END AS tipo FROM part", base=False)
def classify_tranche(r: Reports) -> DataFrame:
    name = F.try_element_at(F.array(*[F.lit(s) for s in _SERIES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return r.table("part").select("p_partkey", N.tranche(name).alias("tipo"))


@plan("SELECT cnpj, dt, pos, ced AS id, pr AS share FROM assignors WHERE pr>0 AND pr<=100")
def unpivot_assignors(r: Reports) -> DataFrame:
    wide = r.assignors.groupBy("cnpj", "dt").agg(*[F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{k}_{i}") for i in range(1, 10) for c, k in (("ced", "ced"), ("pr", "pr"))])
    return P.unpivot_pairs(wide, ["cnpj", "dt"], "ced", "pr", 9).where("share > 0 AND share <= 100")


#: A flow above three times the larger of balance and the customer's flow before, and a floor, is not believed.
FLOWS_SQL = """WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus AS op, o_totalprice AS amt, c_acctbal, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders JOIN customer ON o_custkey=c_custkey),
flows AS (SELECT *, amt<=3*greatest(coalesce(c_acctbal,0),coalesce(prev,0))+100000 AS sane FROM f)"""


def flows(r: Reports) -> DataFrame:
    """Orders as flows (op, amt) with the balance, and whether each is believed."""
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = r.table("orders").withColumn("prev", before).join(r.table("customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    limit = 3 * F.greatest(F.coalesce("c_acctbal", F.lit(0.0)), F.coalesce("prev", F.lit(0.0))) + 100000
    return o.select("o_orderdate", F.col("o_orderstatus").alias("op"), F.col("o_totalprice").alias("amt"), (F.col("o_totalprice") <= limit).alias("sane"))


@plan(FLOWS_SQL + " SELECT year(o_orderdate) AS yr, count(*) FILTER (NOT sane) AS n_dropped, round(coalesce(sum(amt) FILTER (sane),0),2) AS kept FROM flows GROUP BY 1", base=False)
def flow_sanity_filter(r: Reports) -> DataFrame:
    return flows(r).groupBy(F.year("o_orderdate").alias("yr")).agg(F.count_if(~F.col("sane")).alias("n_dropped"), F.round(F.coalesce(F.sum(F.when(F.col("sane"), F.col("amt"))), F.lit(0.0)), 2).alias("kept"))


@plan("SELECT cnpj, dt, pos, ced AS id, pr AS share FROM assignors WHERE pr>=0 AND pr<=100")
def unpivot_assignors_inclusive(r: Reports) -> DataFrame:
    """The other predicate: a share of zero is a share."""
    return r.assignors.where("pr >= 0 AND pr <= 100").select("cnpj", "dt", "pos", F.col("ced").alias("id"), F.col("pr").alias("share"))


@plan("SELECT cnpj, dt, ced, pr FROM assignors WHERE NOT (pr>0 AND pr<=60)")
def share_anomalies(r: Reports) -> DataFrame:
    return r.assignors.where(~((F.col("pr") > 0) & (F.col("pr") <= 60))).select("cnpj", "dt", "ced", "pr")
