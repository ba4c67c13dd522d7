"""Preparation queries (E1-E11) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskset.operators import prepare as pp
from riskset.plans.registry import query, round_doubles
from riskset.plans.sql import CHURN, MISS, r
from riskset.sources import cohorts
from riskset.sources.io import driver_table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NUM = ["n_orders", "acctbal", "mean_price"]


@query("E1_log1p", f"SELECT doc_id, n_chars, {r('ln(1 + n_chars)', 'n_chars_log1p')} FROM documents")
def e1(spark, sf):
    d = driver_table(spark, sf, "documents").select("doc_id", "n_chars")
    return round_doubles(pp.log1p_columns(d, ["n_chars"], suffix="_log1p"))


_MUT_SQL = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linestatus = 'O' THEN '0' ELSE l_returnflag || CAST(l_linenumber AS VARCHAR) END AS mut_variant,
  CAST(l_linenumber - 1 AS INTEGER) AS mut_count FROM lineitem"""


@query("E2_binarise", f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN mut_variant IS NULL THEN NULL WHEN mut_variant = '0' THEN 0 ELSE 1 END AS mut_variant,
  CASE WHEN mut_count IS NULL THEN NULL WHEN CAST(mut_count AS VARCHAR) = '0' THEN 0 ELSE 1 END AS mut_count
FROM ({_MUT_SQL}) m""")
def e2(spark, sf):
    li = driver_table(spark, sf, "lineitem")
    m = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_linestatus") == "O", F.lit("0"))
                  .otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("mut_variant"),
                  (F.col("l_linenumber") - 1).cast("int").alias("mut_count"))
    return pp.binarise_columns(m, ["mut_variant", "mut_count"])


@query("E3_median_impute", f"""WITH {MISS}
SELECT doc_id, {r('coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(quality, 0.5) FROM miss))', 'quality')},
       {r('coalesce(CAST(n_chars AS DOUBLE), (SELECT quantile_cont(n_chars, 0.5) FROM miss))', 'n_chars')}
FROM miss""")
def e3(spark, sf):
    m = cohorts.missing(spark, sf).select("doc_id", F.col("quality").cast("double").alias("quality"),
                                          F.col("n_chars").cast("double").alias("n_chars"))
    return round_doubles(pp.impute(m, pp.fit_median(m, ["quality", "n_chars"])))


def _mode_sql(col: str) -> str:
    return (f"(SELECT {col} FROM miss WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, CAST({col} AS VARCHAR) LIMIT 1)")


@query("E4_mode_impute", f"""WITH {MISS}
SELECT doc_id, CAST(coalesce(quality, {_mode_sql('quality')}) AS INTEGER) AS quality,
       CAST(coalesce(toxic, {_mode_sql('toxic')}) AS INTEGER) AS toxic, lang
FROM miss""")
def e4(spark, sf):
    m = cohorts.missing(spark, sf).select("doc_id", "quality", "toxic", "lang")
    return pp.impute(m, pp.fit_mode(m, ["quality", "toxic", "lang"]))


@query("E4_mode_table", f"""WITH {MISS}, c AS (
  SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM miss WHERE lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT 'source', source, count(*) FROM miss WHERE source IS NOT NULL GROUP BY source
  UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM miss WHERE quality IS NOT NULL GROUP BY quality),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM c)
SELECT "column", value AS mode, n FROM k WHERE rk = 1""")
def e4t(spark, sf):
    return pp.mode_table(cohorts.missing(spark, sf), ["lang", "source", "quality"])


def _scaled_sql(cols: list[str], sd: str = "stddev_pop", fit_where: str = "true") -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, {sd}({c}) AS s_{c}" for c in cols)
    outs = ", ".join(r(f"(CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END)", c)
                     for c in cols)
    return f"""WITH {CHURN}, st AS (SELECT {stats} FROM churn WHERE {fit_where})
SELECT subject_id, {outs} FROM churn, st"""


@query("E5_standardize", _scaled_sql(NUM))
def e5(spark, sf):
    c = cohorts.churn(spark, sf).select("subject_id", *NUM)
    return round_doubles(pp.standardize(c, NUM))


@query("E6_ordinal_encode", f"""SELECT o_orderkey,
  CAST(list_position({PRIORITIES!r}, o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority FROM orders""")
def e6(spark, sf):
    o = driver_table(spark, sf, "orders")
    return o.select("o_orderkey", pp.ordinal_encode("o_orderpriority", PRIORITIES))


@query("E7_one_hot_drop_binary", f"""WITH {CHURN}
SELECT subject_id, CASE WHEN acct_band = 'low' THEN 1.0 ELSE 0.0 END AS acct_band_low,
  {', '.join(f"CASE WHEN segment = '{s}' THEN 1.0 ELSE 0.0 END AS segment_{s}" for s in SEGMENTS)}
FROM churn""")
def e7(spark, sf):
    c = cohorts.churn(spark, sf).select("subject_id", "acct_band", "segment")
    params = pp.fit_levels(c, ["acct_band", "segment"])
    return pp.one_hot(c, params, ["acct_band", "segment"], drop="if_binary")


@query("E8_one_hot_all", f"""WITH {CHURN}
SELECT subject_id, {', '.join(f"CASE WHEN order_band = '{b}' THEN 1.0 ELSE 0.0 END AS order_band_{b}" for b in ['9to11', 'gt11', 'le8'])},
  CASE WHEN acct_band = 'high' THEN 1.0 ELSE 0.0 END AS acct_band_high, CASE WHEN acct_band = 'low' THEN 1.0 ELSE 0.0 END AS acct_band_low
FROM churn""")
def e8(spark, sf):
    c = cohorts.churn(spark, sf).select("subject_id", "order_band", "acct_band")
    params = pp.fit_levels(c, ["order_band", "acct_band"])
    return pp.one_hot(c, params, ["order_band", "acct_band"], drop=None)


@query("E8_one_hot_sparse", """WITH lv AS (SELECT DISTINCT 0 AS col, CAST(o_custkey AS VARCHAR) AS level FROM orders
  UNION ALL SELECT DISTINCT 1, o_orderpriority FROM orders UNION ALL SELECT DISTINCT 2, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END FROM orders),
n AS (SELECT *, row_number() OVER (ORDER BY col, level) - 1 AS place FROM lv WHERE NOT (col = 2 AND level = 'F'))
SELECT o_orderkey, CAST(place AS INTEGER) AS place FROM orders JOIN n ON (col = 0 AND level = CAST(o_custkey AS VARCHAR))
  OR (col = 1 AND level = o_orderpriority) OR (col = 2 AND level = CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END)""")
def e8s(spark, sf):
    cols = ["o_custkey", "o_orderpriority", "is_f"]
    o = driver_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(
        F.col("o_orderstatus") == "F", "F").otherwise("other").alias("is_f"))
    places = pp.one_hot_sparse(o, pp.level_dictionary(o, cols, drop="if_binary"), cols)
    return places.select("o_orderkey", F.explode("places").alias("place"))


E9_PLAN = pp.ColumnPlan(median_scale=NUM, ordinal={"order_band": ["le8", "9to11", "gt11"]},
                        onehot_if_binary=["acct_band"], onehot_all=["segment"],
                        passthrough=["subject_id", "duration", "event"])


def _e9_sql() -> str:
    stats = ", ".join(f"avg(f_{c}) AS m_{c}, stddev_pop(f_{c}) AS s_{c}" for c in NUM)
    fills = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM churn)) AS f_{c}" for c in NUM)
    scaled = ", ".join(r(f"(f_{c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END)", c) for c in NUM)
    return f"""WITH {CHURN}, filled AS (SELECT *, {fills} FROM churn), st AS (SELECT {stats} FROM filled)
SELECT {scaled},
  CAST(list_position(['le8', '9to11', 'gt11'], order_band) - 1 AS DOUBLE) AS order_band,
  CASE WHEN acct_band = 'low' THEN 1.0 ELSE 0.0 END AS acct_band_low,
  {', '.join(f"CASE WHEN segment = '{s}' THEN 1.0 ELSE 0.0 END AS segment_{s}" for s in SEGMENTS)},
  subject_id, {r('duration', 'duration')}, event
FROM filled, st"""


@query("E9_column_plan", _e9_sql())
def e9(spark, sf):
    c = cohorts.churn(spark, sf)
    params = pp.fit_columns(c, E9_PLAN)
    return round_doubles(pp.transform_columns(c, E9_PLAN, params))


MISSING_PLAN = pp.ColumnPlan(median_scale=["quality", "toxic", "n_chars"], ordinal={"lang": ["de", "en", "es", "fr"]},
                             onehot_all=["toxic_text"], passthrough=["doc_id"])


def _missing_plan_sql() -> str:
    num = MISSING_PLAN.median_scale
    fills = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM miss)) AS f_{c}" for c in num)
    stats = ", ".join(f"avg(f_{c}) AS m_{c}, stddev_pop(f_{c}) AS s_{c}" for c in num)
    scaled = ", ".join(r(f"(f_{c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END)", c) for c in num)
    return f"""WITH {MISS}, t AS (SELECT *, CAST(toxic AS VARCHAR) AS txt FROM miss),
md AS (SELECT txt FROM t WHERE txt IS NOT NULL GROUP BY txt ORDER BY count(*) DESC, txt LIMIT 1),
filled AS (SELECT *, {fills}, coalesce(txt, (SELECT txt FROM md)) AS f_txt FROM t), st AS (SELECT {stats} FROM filled)
SELECT {scaled}, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS DOUBLE) AS lang,
  CASE WHEN f_txt = '0' THEN 1.0 ELSE 0.0 END AS toxic_text_0, CASE WHEN f_txt = '1' THEN 1.0 ELSE 0.0 END AS toxic_text_1, doc_id
FROM filled, st"""


@query("E9_plan_with_missing", _missing_plan_sql())
def e9_missing(spark, sf):
    m = cohorts.missing(spark, sf).withColumn("toxic_text", F.col("toxic").cast("string")).withColumn(
        "quality", F.col("quality").cast("double")).withColumn("toxic", F.col("toxic").cast("double")).withColumn(
        "n_chars", F.col("n_chars").cast("double"))
    return round_doubles(pp.transform_columns(m, MISSING_PLAN, pp.fit_columns(m, MISSING_PLAN)))


@query("E9_verify_no_missing", "SELECT CAST(0 AS BIGINT) AS n_missing")
def e9v(spark, sf):
    c = cohorts.churn(spark, sf)
    params = pp.fit_columns(c, E9_PLAN)
    return pp.verify_no_missing(pp.transform_columns(c, E9_PLAN, params))


@query("E10_fill_with_means", f"""WITH {MISS}, st AS (SELECT avg(quality) AS mq, avg(toxic) AS mt FROM miss WHERE lang = 'en')
SELECT doc_id, {r('coalesce(CAST(quality AS DOUBLE), mq)', 'quality')}, {r('coalesce(CAST(toxic AS DOUBLE), mt)', 'toxic')}
FROM miss, st""")
def e10(spark, sf):
    m = cohorts.missing(spark, sf)
    params = pp.fit_scaler(m.where(F.col("lang") == "en"), ["quality", "toxic"])
    return round_doubles(pp.fill_with_means(m.select("doc_id", "quality", "toxic"), params, ["quality", "toxic"]))


@query("E11_zscore_stored_sample_sd", _scaled_sql(["acctbal", "mean_price"], "stddev_samp", "event = 0"))
def e11(spark, sf):
    c = cohorts.churn(spark, sf)
    params = pp.fit_scaler(c.where(F.col("event") == 0), ["acctbal", "mean_price"], ddof=1)
    return round_doubles(pp.scale(c.select("subject_id", "acctbal", "mean_price"), params))
