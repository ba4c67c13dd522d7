"""Profiling queries (A1-A23, P4) with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskset.functions.stats import round_half_up_sql
from riskset.operators import profile as pf
from riskset.operators.prefix import attach_one_row
from riskset.plans.registry import query, round_doubles
from riskset.plans.sql import CHURN, MISS, WIDE, r
from riskset.sources import cohorts
from riskset.sources.io import driver_table

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MISS_NUM = ["n_chars", "quality", "toxic"]


def _long_sql(table: str, cols: list[str], keys: list[str] = (), value_type: str = "DOUBLE") -> str:
    kc = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(
        f"SELECT {kc}'{c}' AS \"column\", CAST({c} AS {value_type}) AS value FROM {table}" for c in cols)


def _describe_sql(long: str, keys: list[str] = ()) -> str:
    kc = "".join(f"{k}, " for k in keys)
    notnull = " AND ".join(["value IS NOT NULL"] + [f"{k} IS NOT NULL" for k in keys])
    return f"""SELECT {kc}"column", count(*) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')},
  {r('min(value)', 'min')}, {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.5)', 'median')},
  {r('quantile_cont(value, 0.75)', 'q3')}, {r('max(value)', 'max')}
FROM ({long}) l WHERE {notnull} GROUP BY {kc}"column\""""


@query("A1_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def a1(spark, sf):
    return pf.shape(driver_table(spark, sf, "lineitem"))


_MISS_TYPES = [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
               ("quality", "int"), ("toxic", "int")]


@query("A2_column_info", f"WITH {MISS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null FROM miss" for c, t in _MISS_TYPES))
def a2(spark, sf):
    return pf.column_info(cohorts.missing(spark, sf))


@query("A3_describe", _describe_sql(_long_sql("lineitem", LINE_NUM)))
def a3(spark, sf):
    return round_doubles(pf.describe(driver_table(spark, sf, "lineitem"), LINE_NUM))


@query("A4_describe_by_group", _describe_sql(_long_sql("lineitem", ["l_quantity", "l_extendedprice"], ["l_returnflag"]),
                                             ["l_returnflag"]))
def a4(spark, sf):
    return round_doubles(pf.describe(driver_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                                     by=["l_returnflag"]))


_PART_COLS = ["p_brand", "p_type", "p_size", "p_name"]
_PART_TYPES = {"p_brand": "string", "p_type": "string", "p_size": "int", "p_name": "string"}


@query("A5_examples", f"""WITH d AS (SELECT DISTINCT * FROM ({_long_sql('part', _PART_COLS, value_type='VARCHAR')}) WHERE value IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rank FROM d)
SELECT "column", CASE "column" {' '.join(f"WHEN '{c}' THEN '{t}'" for c, t in _PART_TYPES.items())} END AS dtype,
       CAST(rank AS INTEGER) AS rank, value FROM k WHERE rank <= 5""")
def a5(spark, sf):
    return pf.examples(driver_table(spark, sf, "part"), _PART_COLS)


@query("A6_event_summary", f"""WITH {CHURN}
SELECT count(*) AS n, CAST(sum(event) AS BIGINT) AS n_event, CAST(count(*) - sum(event) AS BIGINT) AS n_censor,
  {r('100.0 * sum(event) / count(*)', 'pct_event')}, {r('100.0 * (count(*) - sum(event)) / count(*)', 'pct_censor')},
  {r('quantile_cont(duration, 0.5)', 'median_follow_up')}, {r('max(duration)', 'max_follow_up')}
FROM churn""")
def a6(spark, sf):
    return round_doubles(pf.event_summary(cohorts.churn(spark, sf)))


def _a7_specs(c):
    fence = pf.iqr_fence(c, ["n_orders"]).select(F.col("upper_fence").alias("_fence"))
    c = attach_one_row(c, fence)
    specs = [
        ("duration", "Follow-up (days)", F.col("duration") < 0, "0 days"),
        ("acctbal", "Account balance", F.col("acctbal") > 9000, "9000"),
        ("mean_price", "Mean order price", F.col("mean_price") > 300000, "300000"),
        ("n_orders", "Number of orders", F.col("n_orders") > F.col("_fence"), F.format_string("%.1f", "_fence")),
    ]
    return c, specs


def _a7_sql() -> str:
    cols = [("duration", "Follow-up (days)", "duration < 0", "'0 days'"),
            ("acctbal", "Account balance", "acctbal > 9000", "'9000'"),
            ("mean_price", "Mean order price", "mean_price > 300000", "'300000'"),
            ("n_orders", "Number of orders", "n_orders > f.fence", "printf('%.1f', f.fence)")]
    parts = []
    for c, label, rule, thr in cols:
        parts.append(f"""SELECT '{c}' AS "column", '{label}' AS variable, count({c}) AS n, avg({c}) AS mean,
  stddev_samp({c}) AS sd, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.25) AS q1,
  quantile_cont({c}, 0.75) AS q3, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  CAST(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
  100.0 * sum(CASE WHEN {rule} THEN 1 ELSE 0 END) / count(*) AS pct, any_value({thr}) AS threshold
FROM churn, fence f""")
    body = " UNION ALL ".join(parts)
    num = ", ".join(r(x, x) for x in ["mean", "sd", "median", "q1", "q3", "min", "max"])
    return f"""WITH {CHURN},
fence AS (SELECT quantile_cont(n_orders, 0.75) + 3 * (quantile_cont(n_orders, 0.75) - quantile_cont(n_orders, 0.25)) AS fence FROM churn),
s AS ({body})
SELECT "column", variable, n, {num}, n_outliers,
  printf('%.2f ± %.2f', mean, sd) AS mean_sd, printf('%.2f (%.2f - %.2f)', median, q1, q3) AS median_iqr,
  printf('%.1f - %.1f', min, max) AS range,
  printf('%d (%.1f%%)', n_outliers, pct) || ' > ' || threshold AS outliers
FROM s"""


@query("A7_variable_summary", _a7_sql())
def a7(spark, sf):
    c, specs = _a7_specs(cohorts.churn(spark, sf))
    return round_doubles(pf.variable_summary(c, specs))


@query("A8_iqr_fence", f"""SELECT "column", {r('q1', 'q1')}, {r('q3', 'q3')}, {r('q3 - q1', 'iqr')},
  {r('q3 + 3 * (q3 - q1)', 'upper_fence')}, {r('q1 - 3 * (q3 - q1)', 'lower_fence')}
FROM (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM ({_long_sql('lineitem', LINE_NUM)}) l WHERE value IS NOT NULL GROUP BY "column")""")
def a8(spark, sf):
    return round_doubles(pf.iqr_fence(driver_table(spark, sf, "lineitem"), LINE_NUM))


@query("A9_outlier_counts", """WITH f AS (SELECT quantile_cont(l_extendedprice, 0.75) + 3 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS fence FROM lineitem)
SELECT rule, n_outliers, round(100.0 * n_outliers / n, 6) AS pct, threshold FROM (
  SELECT 'quantity_above_45' AS rule, CAST(sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, count(*) AS n, '45' AS threshold FROM lineitem
  UNION ALL SELECT 'discount_outside_0_0.1', CAST(sum(CASE WHEN l_discount < 0 OR l_discount > 0.1 THEN 1 ELSE 0 END) AS BIGINT), count(*), NULL FROM lineitem
  UNION ALL SELECT 'tax_negative', CAST(sum(CASE WHEN l_tax < 0 THEN 1 ELSE 0 END) AS BIGINT), count(*), '0' FROM lineitem
  UNION ALL SELECT 'price_above_3iqr', CAST(sum(CASE WHEN l_extendedprice > f.fence THEN 1 ELSE 0 END) AS BIGINT), count(*), printf('%.1f', any_value(f.fence)) FROM lineitem, f)""")
def a9(spark, sf):
    li = driver_table(spark, sf, "lineitem")
    fence = pf.iqr_fence(li, ["l_extendedprice"]).select(F.col("upper_fence").alias("_fence"))
    li = attach_one_row(li, fence)
    rules = {"quantity_above_45": F.col("l_quantity") > 45,
             "discount_outside_0_0.1": (F.col("l_discount") < 0) | (F.col("l_discount") > 0.1),
             "tax_negative": F.col("l_tax") < 0,
             "price_above_3iqr": F.col("l_extendedprice") > F.col("_fence")}
    thr = {"quantity_above_45": "45", "tax_negative": "0", "price_above_3iqr": F.format_string("%.1f", "_fence")}
    return round_doubles(pf.outlier_counts(li, rules, thr))


_MISS_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@query("A10_missingness", f"""WITH {MISS}, m AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, count(*) AS n FROM miss" for c in _MISS_COLS)})
SELECT "column", n_missing, {r('100.0 * n_missing / n', 'pct_missing')} FROM m WHERE n_missing > 0""")
def a10(spark, sf):
    return round_doubles(pf.missingness(cohorts.missing(spark, sf)))


def _a11_sql(group: str) -> str:
    from riskset.functions.stats import chi2_sf_sql_var
    return f"""WITH {MISS},
per AS (SELECT {group} AS "group", count(*) AS n, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
        FROM miss WHERE {group} IS NOT NULL GROUP BY {group}),
tot AS (SELECT sum(n) AS tn, sum(n_missing) AS tm, count(*) AS g FROM per),
chi AS (SELECT sum(power(n_missing - n * tm / tn, 2) / (n * tm / tn)
                 + power((n - n_missing) - n * (tn - tm) / tn, 2) / (n * (tn - tm) / tn)) AS chi2, any_value(g) AS g
        FROM per, tot)
SELECT "group", n, n_missing, {r('100.0 * n_missing / n', 'pct_missing')}, {r('chi2', 'chi2')},
       CAST(g - 1 AS INTEGER) AS dof, {r(chi2_sf_sql_var('chi2', 'g - 1', 8), 'p_value')}
FROM per, chi"""


@query("A11_missing_by_group", _a11_sql("lang"))
def a11(spark, sf):
    return round_doubles(pf.missing_by_group(cohorts.missing(spark, sf), "quality", "lang"))


@query("A11_missing_2x2", _a11_sql("CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END"))
def a11b(spark, sf):
    m = cohorts.missing(spark, sf).withColumn("lang_group", F.when(F.col("lang") == "en", "en").otherwise("other"))
    return round_doubles(pf.missing_by_group(m, "quality", "lang_group"))


@query("A12_total_missing", f"""WITH {MISS}
SELECT CAST({' + '.join(f'(count(*) - count({c}))' for c in _MISS_COLS)} AS BIGINT) AS n_missing_cells FROM miss""")
def a12(spark, sf):
    return pf.total_missing(cohorts.missing(spark, sf))


def _corr_sql(table: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 'corr')} "
                              f"FROM {table}" for a, b in pairs)


@query("A13_correlation_matrix", _corr_sql("lineitem", LINE_NUM))
def a13(spark, sf):
    return round_doubles(pf.correlation_matrix(driver_table(spark, sf, "lineitem"), LINE_NUM))


@query("A13_correlation_wide", f"""WITH {WIDE}
SELECT 'f' || a.feature AS col_a, 'f' || b.feature AS col_b, {r('corr(a.value, b.value)', 'corr')}
FROM wide a JOIN wide b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY a.feature, b.feature""")
def a13_wide(spark, sf):
    e = driver_table(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    wide = e.select(*[F.get("embedding", F.lit(i)).alias(f"f{i + 1}") for i in range(width)])
    return round_doubles(pf.correlation_matrix(wide, wide.columns))


@query("A13_correlation_pairwise", f"WITH {MISS} " + _corr_sql("miss", MISS_NUM))
def a13b(spark, sf):
    return round_doubles(pf.correlation_matrix(cohorts.missing(spark, sf), MISS_NUM))


@query("A14_group_mean", f"""SELECT o_orderpriority, {round_half_up_sql('avg(o_totalprice)', 2)} AS mean_o_totalprice
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def a14(spark, sf):
    return pf.group_mean(driver_table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@query("A15_group_median", f"""SELECT l_returnflag, {round_half_up_sql('quantile_cont(l_extendedprice, 0.5)', 2)} AS median_l_extendedprice
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def a15(spark, sf):
    return pf.group_median(driver_table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("A16_value_counts", f"""SELECT c_mktsegment AS value, count(*) AS n,
  {r('100.0 * count(*) / sum(count(*)) OVER ()', 'pct')} FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def a16(spark, sf):
    return round_doubles(pf.value_counts(driver_table(spark, sf, "customer"), "c_mktsegment"))


@query("A16_value_counts_by_key", f"""SELECT o_orderstatus AS value, count(*) AS n,
  {r('100.0 * count(*) / sum(count(*)) OVER ()', 'pct')} FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def a16b(spark, sf):
    return round_doubles(pf.value_counts(driver_table(spark, sf, "orders"), "o_orderstatus", by_key=True))


def _hist_sql(expr: str, table: str, label: str, bins: int = 30) -> str:
    return f"""(WITH base AS (SELECT CAST({expr} AS DOUBLE) AS x FROM {table} WHERE {expr} IS NOT NULL),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM base),
cnt AS (SELECT CAST(CASE WHEN (hi - lo) = 0 THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin,
               count(*) AS n FROM base, rng GROUP BY 1),
grid AS (SELECT CAST(unnest(range(0, {bins})) AS INTEGER) AS bin)
SELECT '{label}' AS series, grid.bin, {r(f'lo + grid.bin * (hi - lo) / {bins}', 'lo')},
       {r(f'lo + (grid.bin + 1) * (hi - lo) / {bins}', 'hi')}, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM grid CROSS JOIN rng LEFT JOIN cnt ON cnt.bin = grid.bin)"""


@query("A18_histogram", f"SELECT * FROM {_hist_sql('o_totalprice', 'orders', 'o_totalprice')}")
def a18(spark, sf):
    return round_doubles(pf.histogram(driver_table(spark, sf, "orders"), "o_totalprice"))


@query("A19_before_after_log1p", f"""WITH h AS (SELECT * FROM {_hist_sql('n_chars', 'documents', 'before')}
  UNION ALL SELECT * FROM {_hist_sql('ln(1 + n_chars)', 'documents', 'after')}),
sk AS (SELECT 'before' AS series, skewness(CAST(n_chars AS DOUBLE)) AS s, count(*) AS n FROM documents
       UNION ALL SELECT 'after', skewness(ln(1 + n_chars)), count(*) FROM documents)
SELECT h.*, {r('sk.s * (sk.n - 2) / sqrt(sk.n * (sk.n - 1))', 'skewness')} FROM h JOIN sk ON h.series = sk.series""")
def a19(spark, sf):
    docs = driver_table(spark, sf, "documents")
    return round_doubles(pf.before_after(docs, "n_chars", F.log1p(F.col("n_chars").cast("double"))))


_BLOCKS = {"target": ["duration", "event"], "covariates": ["n_orders", "acctbal", "mean_price"],
           "missing_prone": ["quality", "toxic"]}


def _blocks_frame(spark, sf):
    churn = cohorts.churn(spark, sf)
    labels = driver_table(spark, sf, "labels").select(F.col("doc_id").alias("subject_id"), "quality", "toxic")
    return churn.join(labels, "subject_id", "left")


_BLOCKS_SQL = f"""WITH {CHURN}, j AS (SELECT c.*, l.quality, l.toxic FROM churn c LEFT JOIN labels l ON l.doc_id = c.subject_id)"""


@query("A20_block_summary", f"""{_BLOCKS_SQL},
cells AS ({' UNION ALL '.join(f"SELECT '{b}' AS block, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM j"
                               for b, cols in _BLOCKS.items() for c in cols)})
SELECT block, count(DISTINCT feature) AS n_columns, count(*) AS n_cells, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
FROM cells GROUP BY block
UNION ALL
SELECT 'Total', count(DISTINCT feature), count(*), CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM cells""")
def a20(spark, sf):
    return pf.block_summary(_blocks_frame(spark, sf), _BLOCKS)


@query("P4_to_long", f"""{_BLOCKS_SQL}
{' UNION ALL '.join(f"SELECT subject_id, '{b}' AS block, '{c}' AS feature, {r(c, 'value')} FROM j"
                    for b, cols in {'target': ['duration', 'event'], 'covariates': ['n_orders', 'acctbal', 'mean_price'], 'rest': ['quality', 'toxic']}.items() for c in cols)}""")
def p4(spark, sf):
    df = _blocks_frame(spark, sf).select("subject_id", "duration", "event", "n_orders", "acctbal", "mean_price",
                                         "quality", "toxic")
    return round_doubles(pf.to_long(df, {"target": ["duration", "event"], "covariates": ["n_orders", "acctbal", "mean_price"]},
                                    id_col="subject_id", rest_block="rest"))
