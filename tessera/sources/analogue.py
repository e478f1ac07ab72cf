"""The report tables as they are derived from the star-schema tables: who reports what, each month.

A vehicle is a supplier, its month the month end of the ship date, fund or class the line status; amounts
are discounted prices. The same definitions stand in ``BASE_SQL`` for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators.lineage import cut

#: Months beside the cutoff.
BEFORE, AFTER, M3, M6, M24 = "2001-05-31", "2001-07-31", "2001-03-31", "2000-12-31", "1999-06-30"
CUTOFF, M12, M36, M60, PARTIAL = "2001-06-30", "2000-06-30", "1998-06-30", "1996-06-30", "2001-11-30"
GRID_FROM = "1999-06-30"
OUTLIER_FLOOR, OUTLIER_TIMES = 1e5, 5.0


class Reports:
    """Lazily built tables over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str, month: str | None = None):
        self.spark, self.folder, self.month = spark, folder, month

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def only(self, month: str) -> Reports:
        """The reports of one month (its last day) alone, the scan cut to it; lines with their orders are written once. The panel, which
        looks at the months around, stays that of all."""
        own = Reports(self.spark, self.folder, month)
        orders = self._orders().withColumn("has_order", F.lit(True))
        lines = cut(own.lines.join(orders, "l_orderkey", "left"))
        own.__dict__["lines"] = lines.drop("ordered", "deb", "has_order")
        own.__dict__["late"] = lines.where("has_order").withColumn("late", F.datediff("ship", "ordered")).drop("has_order")
        own.__dict__["panel"], own.__dict__["sane"] = self.panel, self.sane
        return own

    def keep(self, *names: str) -> Reports:
        """Writes tables (of a row for each vehicle and month) that a plan reads several times to the shared folder."""
        for name in names:
            self.__dict__[name] = cut(getattr(self, name))
        return self

    @cached_property
    def lines(self) -> DataFrame:
        t = self.table("lineitem")
        if self.month:
            end = F.lit(self.month).cast("timestamp_ntz")
            t = t.where((F.col("l_shipdate") >= F.trunc(F.lit(self.month).cast("date"), "month").cast("timestamp_ntz")) & (F.col("l_shipdate") < end + F.expr("INTERVAL 1 DAY")))
        return t.select(
            F.lpad(F.col("l_suppkey").cast("string"), 14, "0").alias("cnpj"), F.last_day(F.to_date("l_shipdate")).alias("dt"), F.when(F.col("l_linestatus") == "F", "Fundo").otherwise("Classe").alias("tp"),
            (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("v"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"), F.col("l_linenumber").alias("ln"),
            "l_suppkey", "l_partkey", "l_orderkey", F.to_date("l_shipdate").alias("ship"),
        )

    @cached_property
    def pl(self) -> DataFrame:
        return self.lines.groupBy("cnpj", "dt", "tp").agg(F.round(F.sum("v"), 2).alias("pl"))

    @cached_property
    def class_map(self) -> DataFrame:
        s = self.table("supplier").where("s_suppkey % 10 = 1")
        return s.select(F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("classe"), F.lpad((F.col("s_suppkey") - 1).cast("string"), 14, "0").alias("fundo"))

    @cached_property
    def panel(self) -> DataFrame:
        # fund and class of a month side by side, so that the class stands without a second shuffle
        own = [F.round(F.sum(F.when(F.col("tp") == t, F.col("v"))), 2).alias(t) for t in ("Classe", "Fundo")]
        month = self.lines.groupBy("cnpj", "dt").agg(*own)
        first = month.select("cnpj", "dt", F.when(F.col("Classe").isNotNull(), "Classe").otherwise("Fundo").alias("tp"), F.coalesce("Classe", "Fundo").alias("pl"))
        return P.drop_covered_funds(first, self.class_map)

    @cached_property
    def sane(self) -> DataFrame:
        return P.sane(self.panel, OUTLIER_FLOOR, OUTLIER_TIMES)

    @staticmethod
    def amounts() -> dict[str, Column]:
        """What a vehicle's lines of a month add up to."""

        def of(*flags: str) -> Column:
            return F.round(F.sum(F.when(F.col("flag").isin(*flags), F.col("v"))), 2)

        return {"dc_risk": of("N", "A"), "dc_norisk": of("R"), "v_sen": of("N"), "v_mez": of("A"), "v_sub": of("R"), "v_tot": F.round(F.sum("v"), 2), "v_roll": F.round(F.sum(F.when((F.col("flag") == "A") & (F.col("ln") >= 3), F.col("v"))), 2)}

    @cached_property
    def assets(self) -> DataFrame:
        return self.lines.groupBy("cnpj", "dt").agg(*[x.alias(n) for n, x in self.amounts().items()])

    @cached_property
    def overdue(self) -> DataFrame:
        return self.late.groupBy("cnpj", "dt").agg(*[F.round(F.sum(x), 2).alias(n) for n, x in self.bands().items()])

    @cached_property
    def late(self) -> DataFrame:
        """Lines with their order: days late and the customer."""
        return self.lines.join(self._orders(), "l_orderkey").withColumn("late", F.datediff("ship", "ordered"))

    def _orders(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("ordered"), F.col("o_custkey").alias("deb"))

    @staticmethod
    def bands() -> dict[str, Column]:
        limits = {"b90": (1, 90), "b360": (91, 360), "b1080": (361, 1080), "bmax": (1081, 99999), "inad": (1, 99999), "dcp": (-99999, 0)}
        return {n: F.when(F.col("late").between(low, high), F.col("v")) for n, (low, high) in limits.items()}

    @cached_property
    def assignors(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ced"))
        # by vehicle and month at once, and ranks and sums over one order: one shuffle, one sort and one window
        lines = self.lines.join(p, "l_partkey").select("cnpj", "dt", "ced", "v").repartition("cnpj", "dt")
        v = lines.groupBy("cnpj", "dt", "ced").agg(F.round(F.sum("v"), 2).alias("val"))
        w = Window.partitionBy("cnpj", "dt").orderBy(F.desc("val"), "ced")
        whole = F.sum("val").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ranked = v.select("cnpj", "dt", "ced", "val", whole.alias("whole"), F.row_number().over(w).alias("pos")).where("pos <= 9")
        return ranked.select("cnpj", "dt", "ced", "val", F.round(100 * F.col("val") / F.nullif("whole", F.lit(0.0)), 6).alias("pr"), "pos")

    @cached_property
    def debtors(self) -> DataFrame:
        lines = self.late.select("cnpj", "dt", "deb", "v").repartition("cnpj", "dt")  # one shuffle for the sums and the ranks
        v = lines.groupBy("cnpj", "dt", "deb").agg(F.round(F.sum("v"), 2).alias("val"))
        return v.withColumn("seq", F.row_number().over(Window.partitionBy("cnpj", "dt").orderBy(F.desc("val"), "deb"))).where("seq <= 25")

    @cached_property
    def registry(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("cnpj"), F.col("s_name").alias("name"), F.col("n_name").alias("admin"), (F.col("s_nationkey") % 7).alias("gestor"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("bal"), F.when(F.col("s_name").like("%1"), "S").otherwise("N").alias("interest"))


BASE_SQL = f"""
WITH lines AS MATERIALIZED (SELECT lpad(cast(l_suppkey AS varchar),14,'0') AS cnpj, last_day(cast(l_shipdate AS date)) AS dt,
  CASE WHEN l_linestatus='F' THEN 'Fundo' ELSE 'Classe' END AS tp, floor(l_extendedprice*(1-l_discount)*100+0.5)/100 AS v, l_returnflag AS flag,
  l_quantity AS qty, l_tax AS tax, l_linenumber AS ln, l_suppkey, l_partkey, l_orderkey, cast(l_shipdate AS date) AS ship FROM lineitem),
pl AS (SELECT cnpj, dt, tp, round(sum(v),2) AS pl FROM lines GROUP BY 1,2,3),
class_map AS (SELECT lpad(cast(s_suppkey AS varchar),14,'0') AS classe, lpad(cast(s_suppkey-1 AS varchar),14,'0') AS fundo FROM supplier WHERE s_suppkey%10=1),
rule_i AS (SELECT cnpj, dt, tp, pl FROM pl QUALIFY row_number() OVER (PARTITION BY cnpj, dt ORDER BY CASE WHEN tp='Classe' THEN 0 ELSE 1 END)=1),
panel AS MATERIALIZED (SELECT * FROM rule_i p WHERE NOT (tp='Fundo' AND EXISTS (SELECT 1 FROM rule_i c JOIN class_map m ON c.cnpj=m.classe WHERE c.tp='Classe' AND m.fundo=p.cnpj AND c.dt=p.dt))),
near AS MATERIALIZED (SELECT *, lag(pl) OVER w AS prev, lead(pl) OVER w AS nxt FROM panel WINDOW w AS (PARTITION BY cnpj ORDER BY dt)),
outl AS (SELECT * FROM near WHERE pl>{OUTLIER_FLOOR} AND prev IS NOT NULL AND nxt IS NOT NULL AND pl>{OUTLIER_TIMES}*greatest(prev,nxt)),
sane AS MATERIALIZED (SELECT p.* FROM panel p WHERE NOT EXISTS (SELECT 1 FROM outl o WHERE o.cnpj=p.cnpj AND o.dt=p.dt)),
assets AS MATERIALIZED (SELECT cnpj, dt, round(sum(v) FILTER (flag IN ('N','A')),2) AS dc_risk, round(sum(v) FILTER (flag='R'),2) AS dc_norisk, round(sum(v) FILTER (flag='N'),2) AS v_sen,
  round(sum(v) FILTER (flag='A'),2) AS v_mez, round(sum(v) FILTER (flag='R'),2) AS v_sub, round(sum(v),2) AS v_tot,
  round(sum(v) FILTER (flag='A' AND ln>=3),2) AS v_roll FROM lines GROUP BY 1,2),
late AS MATERIALIZED (SELECT l.*, ship - cast(o_orderdate AS date) AS late FROM lines l JOIN orders ON l_orderkey=o_orderkey),
overdue AS MATERIALIZED (SELECT cnpj, dt, round(sum(v) FILTER (late BETWEEN 1 AND 90),2) AS b90, round(sum(v) FILTER (late BETWEEN 91 AND 360),2) AS b360, round(sum(v) FILTER (late BETWEEN 361 AND 1080),2) AS b1080,
  round(sum(v) FILTER (late>1080),2) AS bmax, round(sum(v) FILTER (late>0),2) AS inad, round(sum(v) FILTER (late<=0),2) AS dcp FROM late GROUP BY 1,2),
ced0 AS (SELECT cnpj, dt, p_brand AS ced, round(sum(v),2) AS val FROM lines JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3),
ced1 AS (SELECT *, round(100*val/nullif(sum(val) OVER (PARTITION BY cnpj, dt),0),6) AS pr, row_number() OVER (PARTITION BY cnpj, dt ORDER BY val DESC, ced) AS pos FROM ced0),
assignors AS MATERIALIZED (SELECT * FROM ced1 WHERE pos<=9),
deb0 AS (SELECT cnpj, dt, o_custkey AS deb, round(sum(v),2) AS val FROM lines JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2,3),
debtors AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, dt ORDER BY val DESC, deb) AS seq FROM deb0) WHERE seq<=25),
registry AS MATERIALIZED (SELECT lpad(cast(s_suppkey AS varchar),14,'0') AS cnpj, s_name AS name, n_name AS admin, s_nationkey%7 AS gestor, r_name AS region, s_acctbal AS bal, CASE WHEN s_name LIKE '%1' THEN 'S' ELSE 'N' END AS interest
  FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)
"""
