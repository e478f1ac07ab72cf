"""Time series over months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import timeseries as T
from ..sources.analogue import CUTOFF, GRID_FROM, M12, PARTIAL, Reports
from .register import plan

_GRID = f"@mon AS (SELECT DISTINCT dt FROM lines WHERE dt BETWEEN '{GRID_FROM}' AND '{CUTOFF}'), thin AS (SELECT * FROM sane WHERE dt BETWEEN '{GRID_FROM}' AND '{CUTOFF}'), grid AS (SELECT c.cnpj, m.dt, s.pl, s.pl IS NOT NULL AS obs FROM (SELECT DISTINCT cnpj FROM thin) c CROSS JOIN mon m LEFT JOIN thin s ON s.cnpj=c.cnpj AND s.dt=m.dt)"


def _grid(r: Reports) -> DataFrame:
    """Vehicles by months; where one did not report there is a gap."""
    own = F.col("dt").between(F.lit(GRID_FROM).cast("date"), F.lit(CUTOFF).cast("date"))
    return T.densify(r.sane.where(own).select("cnpj", "dt", "pl"), r.lines.where(own).select("dt").distinct())


@plan(_GRID + " SELECT cnpj, dt, pl, obs FROM grid")
def densify_grid(r: Reports) -> DataFrame:
    return _grid(r)


@plan(_GRID + " SELECT cnpj, dt, lag(pl,12) OVER w AS pl_12, lag(pl,1) OVER w AS pl_1 FROM grid WINDOW w AS (PARTITION BY cnpj ORDER BY dt)")
def calendar_lag_12(r: Reports) -> DataFrame:
    return _grid(r).select("cnpj", "dt", F.lag("pl", 12).over(T.by_month()).alias("pl_12"), F.lag("pl", 1).over(T.by_month()).alias("pl_1"))


@plan(_GRID + " SELECT cnpj, dt, CASE WHEN count(pl) OVER w>=10 THEN round(sum(pl) OVER w/count(pl) OVER w*12,2) END AS pl_12m FROM grid WINDOW w AS (PARTITION BY cnpj ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling12_min10_rescaled(r: Reports) -> DataFrame:
    return _grid(r).select("cnpj", "dt", F.round(T.rolling(F.col("pl")), 2).alias("pl_12m"))


_GAPS = _GRID + ", e AS (SELECT *, min(dt) FILTER (obs) OVER w AS f, max(dt) FILTER (obs) OVER w AS l FROM grid WINDOW w AS (PARTITION BY cnpj)), g AS (SELECT *, CASE WHEN NOT obs AND dt>f AND dt<l THEN 1 ELSE 0 END AS gap FROM e)"


@plan(_GAPS + " SELECT cnpj, dt, gap, (sum(gap) OVER (PARTITION BY cnpj ORDER BY dt))::BIGINT AS gaps FROM g")
def interior_gaps(r: Reports) -> DataFrame:
    return T.interior_gaps(_grid(r)).select("cnpj", "dt", "gap", "gaps")


_STAG = _GRID + ", b AS (SELECT cnpj, dt, floor(pl/2e5) AS band FROM grid), q AS (SELECT *, coalesce(CAST(band=lag(band) OVER (PARTITION BY cnpj ORDER BY dt) AS int),0) AS eq FROM b), i AS (SELECT *, sum(1-eq) OVER (PARTITION BY cnpj ORDER BY dt) AS isl FROM q)"


@plan(_STAG + " SELECT cnpj, dt, (sum(eq) OVER (PARTITION BY cnpj, isl ORDER BY dt))::BIGINT AS same FROM i")
def stagnation_islands(r: Reports) -> DataFrame:
    return T.stagnation(_grid(r).withColumn("band", F.floor(F.col("pl") / 2e5)), "band").select("cnpj", "dt", "same")


@plan(_GRID + ", f AS (SELECT cnpj, dt, coalesce(pl>1e5,false) AS fired FROM grid), s AS (SELECT *, max(dt) FILTER (NOT fired) OVER (PARTITION BY cnpj) AS stop FROM f) SELECT cnpj, count(*) FILTER (stop IS NULL OR dt>stop) AS streak FROM s GROUP BY 1")
def trailing_streak(r: Reports) -> DataFrame:
    return T.trailing_streak(_grid(r).withColumn("fired", F.col("pl") > 1e5), ["cnpj"])


@plan(f"SELECT count(*) AS n, round(sum(a.pl),2) AS pl0, round(sum(b.pl),2) AS pl12, round(sum(a.pl)/nullif(sum(b.pl),0)-1,6) AS growth FROM sane a JOIN sane b ON a.cnpj=b.cnpj AND a.dt='{CUTOFF}' AND b.dt='{M12}'")
def same_store_growth(r: Reports) -> DataFrame:
    a, b = (r.sane.where(F.col("dt") == F.lit(d).cast("date")).select("cnpj", F.col("pl").alias(n)) for d, n in ((CUTOFF, "a"), (M12, "b")))
    return a.join(b, "cnpj").agg(F.count("*").alias("n"), F.round(F.sum("a"), 2).alias("pl0"), F.round(F.sum("b"), 2).alias("pl12"), F.round(F.sum("a") / F.nullif(F.sum("b"), F.lit(0.0)) - 1, 6).alias("growth"))


def _months(r: Reports) -> DataFrame:
    return r.sane.select("dt").distinct().withColumn("nx", F.lead("dt").over(Window.orderBy("dt")))


@plan("SELECT cnpj, pl FROM sane a WHERE dt=(SELECT max(dt) FROM sane WHERE dt<'" + PARTIAL + "') AND NOT EXISTS (SELECT 1 FROM sane b WHERE b.cnpj=a.cnpj AND b.dt='" + PARTIAL + "')")
def absentees_anti_join(r: Reports) -> DataFrame:
    m = _months(r).where(F.col("nx") == F.lit(PARTIAL).cast("date"))
    last = r.sane.join(F.broadcast(m), "dt", "left_semi")
    return last.join(r.sane.where(F.col("dt") == F.lit(PARTIAL).cast("date")), "cnpj", "left_anti").select("cnpj", "pl")


@plan("SELECT cnpj, min(dt) AS first FROM sane GROUP BY 1 HAVING min(dt)>(SELECT min(dt) FROM sane)")
def newcomers(r: Reports) -> DataFrame:
    start = r.sane.agg(F.min("dt").alias("start"))
    return r.sane.groupBy("cnpj").agg(F.min("dt").alias("first")).crossJoin(F.broadcast(start)).where("first > start").select("cnpj", "first")


@plan("@m AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM sane)) SELECT m.dt, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM sane b WHERE b.cnpj=s.cnpj AND b.dt=m.nx)) AS n_gone, round(coalesce(sum(pl) FILTER (NOT EXISTS (SELECT 1 FROM sane b WHERE b.cnpj=s.cnpj AND b.dt=m.nx)),0),2) AS pl_gone FROM m JOIN sane s ON s.dt=m.dt WHERE nx IS NOT NULL GROUP BY 1")
def attrition_history(r: Reports) -> DataFrame:
    # a vehicle stays if its own next report is of the next month that anyone reports
    s = r.sane.withColumn("again", F.lead("dt").over(T.by_month())).join(F.broadcast(_months(r).where("nx IS NOT NULL")), "dt")
    gone = ~F.coalesce(F.col("again") == F.col("nx"), F.lit(False))
    return s.groupBy("dt").agg(F.count("*").alias("n"), F.count_if(gone).alias("n_gone"), F.round(F.coalesce(F.sum(F.when(gone, F.col("pl"))), F.lit(0.0)), 2).alias("pl_gone"))


@plan("@t AS (SELECT dt, sum(pl) AS pl FROM sane GROUP BY 1), v AS (SELECT pl/nullif(lag(pl) OVER (ORDER BY dt),0)-1 AS x FROM t) SELECT round(max(abs(x)),6) AS jump, count(x) AS n FROM v")
def max_month_jump(r: Reports) -> DataFrame:
    t = r.sane.groupBy("dt").agg(F.sum("pl").alias("pl"))
    v = t.select((F.col("pl") / F.nullif(F.lag("pl").over(Window.orderBy("dt")), F.lit(0.0)) - 1).alias("x"))
    return v.agg(F.round(F.max(F.abs("x")), 6).alias("jump"), F.count("x").alias("n"))


@plan("SELECT cnpj, dt, max(dt) OVER (PARTITION BY cnpj ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM sane")
def latest_before(r: Reports) -> DataFrame:
    return r.sane.select("cnpj", "dt", F.max("dt").over(T.by_month().rowsBetween(Window.unboundedPreceding, -1)).alias("latest"))


_GROWN = "CASE WHEN lag({c},12) OVER w IS NOT NULL AND {c} IS NOT NULL THEN ln(greatest({c},1))-ln(greatest(lag({c},12) OVER w,1)) END"


@plan(_GRID + f", j AS (SELECT grid.cnpj, grid.dt, pl, v_tot FROM grid LEFT JOIN assets USING (cnpj, dt)) SELECT cnpj, dt, round({_GROWN.format(c='pl')} - {_GROWN.format(c='v_tot')},6) AS gap FROM j WINDOW w AS (PARTITION BY cnpj ORDER BY dt)")
def log_growth_gap(r: Reports) -> DataFrame:
    """How much more the value has grown than the portfolio in twelve months, in logs of at least 1."""
    j = _grid(r).join(r.assets.select("cnpj", "dt", "v_tot"), ["cnpj", "dt"], "left")

    def grown(c: str):
        before = F.lag(c, 12).over(T.by_month())
        return F.when(before.isNotNull() & F.col(c).isNotNull(), F.log(F.greatest(F.col(c), F.lit(1.0))) - F.log(F.greatest(before, F.lit(1.0))))

    return j.select("cnpj", "dt", F.round(grown("pl") - grown("v_tot"), 6).alias("gap"))


@plan(_GRID + ", z AS (SELECT cnpj, dt, coalesce(pl,0) AS v FROM grid) SELECT cnpj, dt, CASE WHEN count(v) OVER w>=10 THEN round(sum(v) OVER w/count(v) OVER w*12,2) END AS pl_12m FROM z WINDOW w AS (PARTITION BY cnpj ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling12_zero_filled(r: Reports) -> DataFrame:
    """The other reading: an unreported month counts as zero, so a full window is never scaled up."""
    z = _grid(r).withColumn("v", F.coalesce("pl", F.lit(0.0)))
    return z.select("cnpj", "dt", F.round(T.rolling(F.col("v")), 2).alias("pl_12m"))


@plan("SELECT strftime(ts,'%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2", base=False)
def events_tumbling_batch(r: Reports) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return r.table("events").groupBy(F.date_format(w["start"], "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@plan("SELECT user_id, event_type, max_by(event_id, struct_pack(a:=ts, b:=event_id)) AS event_id FROM events GROUP BY 1,2", base=False)
def events_late_keep_last(r: Reports) -> DataFrame:
    return r.table("events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@plan("SELECT user_id, max_by(cast(json_extract_string(props,'$.k') AS bigint), struct_pack(a:=ts, b:=event_id)) AS k FROM events GROUP BY 1", base=False)
def json_flatten_max_by(r: Reports) -> DataFrame:
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return r.table("events").select("user_id", "ts", "event_id", k.alias("k")).groupBy("user_id").agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"))


@plan("SELECT date_trunc('month', o_orderdate)::date AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2", base=False)
def monthly_process_counts(r: Reports) -> DataFrame:
    return r.table("orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"))
