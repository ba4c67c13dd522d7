"""Survival queries (K1-K10, J3) over the fixture cohorts, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskset.functions.stats import chi2_sf_col, chi2_sf_sql
from riskset.operators import survival as sv
from riskset.plans.registry import query, round_doubles
from riskset.plans.sql import CHURN, ITEM, km_sql, logrank_sql, r
from riskset.sources import cohorts

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RISK_TIMES = [0.0, 365.0, 730.0, 1095.0, 1460.0, 1825.0]


def _km_select(keys: list[str]) -> str:
    kc = "".join(f"{k}, " for k in keys)
    return (f"SELECT {kc}{r('t', 't')}, n_at_risk, n_event, n_censor, {r('survival', 'survival')}, "
            f"{r('ci_low', 'ci_low')}, {r('ci_high', 'ci_high')} FROM km")


@query("K1_km_overall", f"WITH {CHURN}, {km_sql('churn', [])} {_km_select([])}")
def k1(spark, sf):
    return round_doubles(sv.kaplan_meier(cohorts.churn(spark, sf)))


@query("K2_km_by_segment", f"WITH {CHURN}, {km_sql('churn', ['segment'])} {_km_select(['segment'])}")
def k2(spark, sf):
    return round_doubles(sv.kaplan_meier(cohorts.churn(spark, sf), strata="segment"))


@query("K3_km_band_item", f"WITH {ITEM}, {km_sql('item', ['linestatus'])} {_km_select(['linestatus'])}")
def k3(spark, sf):
    return round_doubles(sv.kaplan_meier(cohorts.item(spark, sf), strata="linestatus"))


@query("K4_median_by_band", f"""WITH {CHURN}, {km_sql('churn', ['order_band'])}
SELECT order_band, {r('min(CASE WHEN survival <= 0.5 THEN t END)', 'median_t')},
       {r('min(CASE WHEN survival <= 0.5 THEN t END) / 365.25', 'median_years')}
FROM km GROUP BY order_band""")
def k4(spark, sf):
    km = sv.kaplan_meier(cohorts.churn(spark, sf), strata="order_band")
    return round_doubles(sv.median_survival(km, "order_band"))


@query("K4_median_item", f"""WITH {ITEM}, {km_sql('item', ['linestatus'])}
SELECT linestatus, {r('min(CASE WHEN survival <= 0.5 THEN t END)', 'median_t')},
       {r('min(CASE WHEN survival <= 0.5 THEN t END) / 365.25', 'median_years')}
FROM km GROUP BY linestatus""")
def k4_item(spark, sf):
    km = sv.kaplan_meier(cohorts.item(spark, sf), strata="linestatus")
    return round_doubles(sv.median_survival(km, "linestatus"))


@query("K5_group_counts", f"""WITH {CHURN}
SELECT order_band, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_event,
       CAST(sum(1 - event) AS BIGINT) AS n_censor
FROM churn GROUP BY order_band""")
def k5(spark, sf):
    return sv.group_counts(cohorts.churn(spark, sf), strata="order_band")


@query("K5_risk_table", f"""WITH {CHURN}, times AS (SELECT unnest([{', '.join(map(str, RISK_TIMES))}]) AS time)
SELECT segment, {r('time', 'time')}, CAST(count(*) FILTER (WHERE duration >= time) AS BIGINT) AS n_at_risk
FROM churn, times GROUP BY segment, time""")
def k5_risk(spark, sf):
    return round_doubles(sv.risk_table(cohorts.churn(spark, sf), RISK_TIMES, strata="segment"))


def _logrank_query_sql(source_cte: str, source: str, variable: str, group_expr: str,
                       levels: list[str], ignore_censoring: bool = False) -> str:
    ctes, last, stat = logrank_sql(source, group_expr, levels, "lr", ignore_censoring)
    dof = len(levels) - 1
    return (f"WITH {source_cte}, {', '.join(ctes)} SELECT '{variable}' AS variable, "
            f"{len(levels)} AS n_groups, {r(stat, 'statistic')}, {dof} AS dof, "
            f"{r(chi2_sf_sql(stat, dof), 'p_value')}, {_log10_sql(chi2_sf_sql(stat, dof))} FROM {last}")


def _log10_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN round(log10({p}), 6) END AS log10_p"


def _lr_finish(df):
    """With log10(p): small p-values would all round to 0."""
    return round_doubles(df.select("variable", "n_groups", "statistic", "dof", "p_value", F.when(
        F.col("p_value") > 0, F.log10("p_value")).alias("log10_p")))


@query("K6_logrank_two_sample", _logrank_query_sql(
    CHURN, "churn", "acct_group", "CASE WHEN acct_band = 'high' THEN 'A' ELSE 'B' END", ["A", "B"]))
def k6(spark, sf):
    c = cohorts.churn(spark, sf).withColumn("acct_group", sv.two_group("acct_band", "high"))
    return _lr_finish(sv.logrank(c, "acct_group"))


@query("K6_logrank_item", _logrank_query_sql(ITEM, "item", "linestatus", "linestatus", ["F", "O"]))
def k6_item(spark, sf):
    return _lr_finish(sv.logrank(cohorts.item(spark, sf), "linestatus"))


@query("K7_logrank_k3", _logrank_query_sql(
    CHURN, "churn", "order_band", "order_band", ["9to11", "gt11", "le8"]))
def k7(spark, sf):
    return _lr_finish(sv.logrank(cohorts.churn(spark, sf), "order_band"))


MANY = 16


@query("K7_logrank_many_groups", _logrank_query_sql(
    ITEM, "item", "bin", f"CAST(l_orderkey % {MANY} AS VARCHAR)", sorted(str(i) for i in range(MANY))))
def k7_many(spark, sf):
    c = cohorts.item(spark, sf).withColumn("bin", (F.col("l_orderkey") % MANY).cast("string"))
    return _lr_finish(sv.logrank(c, "bin"))


@query("K7_logrank_matrix_free", _logrank_query_sql(
    ITEM, "item", "bin", f"CAST(l_orderkey % {MANY} AS VARCHAR)", sorted(str(i) for i in range(MANY))))
def k7_matrix_free(spark, sf):
    c = cohorts.item(spark, sf).withColumn("bin", (F.col("l_orderkey") % MANY).cast("string"))
    return _lr_finish(sv.logrank(c, "bin", dense_levels=0))


@query("K7_logrank_ignore_censoring", _logrank_query_sql(
    CHURN, "churn", "order_band", "order_band", ["9to11", "gt11", "le8"], ignore_censoring=True))
def k7_ic(spark, sf):
    return _lr_finish(sv.logrank(cohorts.churn(spark, sf), "order_band", ignore_censoring=True))


def _k8_sql() -> str:
    parts, ctes = [], []
    for name, var, levels in [("a", "segment", SEGMENTS), ("b", "acct_band", ["high", "low"]),
                              ("c", "order_band", ["9to11", "gt11", "le8"])]:
        c, last, stat = logrank_sql("churn", var, levels, name)
        ctes += c
        dof = len(levels) - 1
        parts.append(f"SELECT '{var}' AS variable, {len(levels)} AS n_groups, {r(stat, 'statistic')}, "
                     f"{dof} AS dof, {r(chi2_sf_sql(stat, dof), 'p_value')}, {_log10_sql(chi2_sf_sql(stat, dof))} FROM {last}")
    return f"WITH {CHURN}, {', '.join(ctes)} " + " UNION ALL ".join(parts)


@query("K8_logrank_all_strata", _k8_sql())
def k8(spark, sf):
    return _lr_finish(sv.logrank(cohorts.churn(spark, sf), ["segment", "acct_band", "order_band"]))


def _k8_groups_sql() -> str:
    parts = []
    for var in ["segment", "acct_band", "order_band"]:
        parts.append(f"""
  SELECT '{var}' AS variable, g.level, g.n, g.observed, {r('sum(CAST(p.d AS DOUBLE) * p.ng / p.n)', 'expected')}
  FROM (SELECT {var} AS level, count(*) AS n, CAST(sum(event) AS BIGINT) AS observed FROM churn GROUP BY {var}) g
  JOIN (SELECT t, level, d, CAST(sum(mg) OVER (PARTITION BY level ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS ng,
               CAST(sum(m) OVER (PARTITION BY level ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS n
        FROM (SELECT tt.t, lv.level, tt.d, tt.m, coalesce(gt.mg, 0) AS mg
              FROM (SELECT duration AS t, sum(event) AS d, count(*) AS m FROM churn GROUP BY duration) tt
              JOIN (SELECT DISTINCT {var} AS level FROM churn) lv ON true
              LEFT JOIN (SELECT duration AS t, {var} AS level, count(*) AS mg FROM churn GROUP BY duration, {var}) gt
                ON gt.t = tt.t AND gt.level = lv.level)) p
    ON p.level = g.level
  GROUP BY g.level, g.n, g.observed""")
    return f"WITH {CHURN} " + " UNION ALL ".join(parts)


@query("K8_logrank_groups", _k8_groups_sql())
def k8_groups(spark, sf):
    return round_doubles(sv.logrank_groups(cohorts.churn(spark, sf), ["segment", "acct_band", "order_band"]))


_LINES = "SELECT l_orderkey AS level, duration AS t, event AS e FROM item WHERE duration IS NOT NULL AND event IS NOT NULL"


# Every order is a level: thousands of them, more with the data.
@query("K7_logrank_order_groups", f"""WITH {ITEM}, li AS ({_LINES}),
per AS (SELECT t, CAST(sum(e) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS m FROM li GROUP BY t),
risk AS (SELECT t, d, sum(m) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM per),
haz AS (SELECT t, sum(d / n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM risk)
SELECT 'order' AS variable, CAST(li.level AS VARCHAR) AS level, count(*) AS n, CAST(sum(e) AS BIGINT) AS observed,
       {r('sum(h)', 'expected')} FROM li JOIN haz ON haz.t = li.t GROUP BY li.level""")
def k7_orders(spark, sf):
    c = cohorts.item(spark, sf).withColumn("order", F.col("l_orderkey").cast("string"))
    return round_doubles(sv.logrank_groups(c, "order"))


@query("J3_logrank_grid", f"""WITH {CHURN},
tt AS (SELECT DISTINCT duration AS t FROM churn),
lv AS (SELECT DISTINCT order_band AS level FROM churn),
per AS (SELECT duration AS t, order_band AS level, count(*) AS m, CAST(sum(event) AS BIGINT) AS d FROM churn GROUP BY 1, 2),
grid AS (SELECT tt.t, lv.level, coalesce(per.m, 0) AS m, coalesce(per.d, 0) AS d
         FROM tt JOIN lv ON true LEFT JOIN per ON per.t = tt.t AND per.level = lv.level)
SELECT 'order_band' AS variable, level, {r('t', 't')},
       CAST(sum(m) OVER (PARTITION BY level ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_at_risk,
       CAST(d AS BIGINT) AS n_event
FROM grid""")
def j3(spark, sf):
    return round_doubles(sv.logrank_grid(cohorts.churn(spark, sf), "order_band"))


def _cross_sql(source_cte: str, source: str, col: str, a: str, b: str) -> str:
    return f"""WITH {source_cte}, {km_sql(f"(SELECT * FROM {source} WHERE {col} IN ('{a}', '{b}'))", [col])},
grid AS (SELECT DISTINCT t FROM km),
fa AS (SELECT g.t, (SELECT k.survival FROM km k WHERE k.{col} = '{a}' AND k.t <= g.t ORDER BY k.t DESC LIMIT 1) AS sa,
              (SELECT k.survival FROM km k WHERE k.{col} = '{b}' AND k.t <= g.t ORDER BY k.t DESC LIMIT 1) AS sb
       FROM grid g),
sg AS (SELECT t, sign(round(coalesce(sa, 1.0) - coalesce(sb, 1.0), 12)) AS sgn FROM fa),
nz AS (SELECT t, sgn, lag(sgn) OVER (ORDER BY t) AS prev FROM sg WHERE sgn <> 0)
SELECT '{a}' AS level_a, '{b}' AS level_b, count(*) FILTER (WHERE sgn <> prev) AS n_crossings,
       {r(f'min(t) FILTER (WHERE sgn <> prev)', 'first_crossing_t')}
FROM nz"""


@query("K9_curve_crossings", _cross_sql(CHURN, "churn", "acct_band", "high", "low"))
def k9(spark, sf):
    return round_doubles(sv.curve_crossings(cohorts.churn(spark, sf), "acct_band", "high", "low"))


@query("K9_curve_crossings_item", _cross_sql(ITEM, "item", "linestatus", "F", "O"))
def k9_item(spark, sf):
    return round_doubles(sv.curve_crossings(cohorts.item(spark, sf), "linestatus", "F", "O"))


def _k10_sql() -> str:
    x = "o_totalprice / 50000.0"
    arms = " ".join(f"WHEN {k} THEN {chi2_sf_sql(x, k)}" for k in range(1, 6))
    return (f"SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS dof, {r(x, 'x')}, "
            f"round(log10(CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) {arms} END), 6) AS log10_p "
            f"FROM orders")


@query("K10_chi2_tail", _k10_sql())
def k10(spark, sf):
    from riskset.sources.io import driver_table
    o = driver_table(spark, sf, "orders")
    dof = F.substring("o_orderpriority", 1, 1).cast("int")
    x = F.col("o_totalprice") / 50000.0
    return round_doubles(o.select("o_orderkey", dof.alias("dof"), x.alias("x"),
                                  F.log10(chi2_sf_col(x, dof)).alias("log10_p")))
