"""Relational, scan and sink queries (S1, S3, P1-P13, J1, J2) with SQL oracles."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from riskset.operators import relational as rel
from riskset.operators import survival as sv
from riskset.operators.prepare import standardize
from riskset.plans.registry import query, round_doubles
from riskset.plans.sql import CHURN, MISS, r
from riskset.session import ensure_checkpoint_dir
from riskset.sources import cohorts
from riskset.sources.io import driver_table, export, read_table

LANDMARK = 1825


@query("S1_read_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s1(spark, sf):
    return read_table(spark, os.path.join(sf, "orders.parquet"))


def _scratch(spark) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local
    on a cluster: the checkpoint folder is the cluster's shared storage)."""
    return os.path.join(ensure_checkpoint_dir(spark), "exports", uuid.uuid4().hex)


@query("S1_csv_inferred", """SELECT c_custkey + 1 AS next_key, c_name, c_nationkey % 5 AS nation, round(c_acctbal / 2, 6) AS half,
  c_mktsegment FROM customer""")
def s1_csv(spark, sf):
    """A delimited file with a header, types inferred from all of it: the numbers can be computed with."""
    path = _scratch(spark)
    export(driver_table(spark, sf, "customer"), path, fmt="csv")
    back = read_table(spark, path, fmt="csv")
    return back.select((F.col("c_custkey") + 1).cast("long").alias("next_key"), "c_name",
                       (F.col("c_nationkey") % 5).cast("int").alias("nation"), F.round(F.col("c_acctbal") / 2, 6).alias("half"),
                       "c_mktsegment")


@query("S3_export_roundtrip", f"""WITH {CHURN}
SELECT subject_id, {r('duration', 'duration')}, event, segment, acct_band, order_band, n_orders,
       {r('acctbal', 'acctbal')}, {r('mean_price', 'mean_price')} FROM churn""")
def s3(spark, sf):
    path = _scratch(spark)
    export(cohorts.churn(spark, sf), path, fmt="csv")
    schema = ("subject_id long, duration double, event int, segment string, acct_band string, "
              "order_band string, n_orders long, acctbal double, mean_price double")
    return round_doubles(read_table(spark, path, fmt="csv", schema=schema))


@query("S3_export_parquet", f"""WITH {CHURN}
SELECT segment, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_event FROM churn GROUP BY segment""")
def s3p(spark, sf):
    path = _scratch(spark)
    export(cohorts.churn(spark, sf), path, partition_by=["segment"])
    back = read_table(spark, path)
    return back.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("n_event"))


@query("P1_preview", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5")
def p1(spark, sf):
    return rel.preview(driver_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")


@query("P2_recode_event", """SELECT o_custkey AS subject_id, CAST(1 - active AS INTEGER) AS event FROM (
  SELECT o_custkey, CASE WHEN max(o_orderdate) >= TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END AS active
  FROM orders GROUP BY o_custkey)""")
def p2(spark, sf):
    o = driver_table(spark, sf, "orders").groupBy("o_custkey").agg(
        (F.max("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).cast("int").alias("active"))
    return rel.recode_event(o, "active").select(F.col("o_custkey").alias("subject_id"), "event")


@query("P3_drop_if_present", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p3(spark, sf):
    c = driver_table(spark, sf, "customer")
    return rel.drop_if_present(c, ["c_name", "c_mktsegment", "not_a_column"])


@query("P5_select_reorder", f"""WITH {CHURN} SELECT event, {r('duration', 'duration')}, segment, subject_id FROM churn""")
def p5(spark, sf):
    return round_doubles(rel.select_columns(cohorts.churn(spark, sf), ["event", "duration", "segment", "subject_id"]))


@query("P6_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def p6(spark, sf):
    li = driver_table(spark, sf, "lineitem")
    return rel.filter_project(li, F.col("l_quantity") > 45, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("P7_drop_null_rows", f"WITH {MISS} SELECT doc_id, lang, quality FROM miss WHERE quality IS NOT NULL")
def p7(spark, sf):
    return rel.drop_null_rows(cohorts.missing(spark, sf), ["quality"]).select("doc_id", "lang", "quality")


@query("P8_landmark_eligible", f"""WITH {CHURN}
SELECT subject_id, {r('duration', 'duration')}, event FROM churn WHERE NOT (duration < {LANDMARK} AND event = 0)""")
def p8(spark, sf):
    return round_doubles(rel.landmark_eligible(cohorts.churn(spark, sf), LANDMARK).select("subject_id", "duration", "event"))


@query("P9_landmark_label", f"""WITH {CHURN}
SELECT subject_id, CAST(CASE WHEN duration >= {LANDMARK} THEN 1 ELSE 0 END AS INTEGER) AS label_documented,
       CAST(CASE WHEN duration >= {LANDMARK} AND event = 0 THEN 1 ELSE 0 END AS INTEGER) AS label_coded
FROM churn WHERE NOT (duration < {LANDMARK} AND event = 0)""")
def p9(spark, sf):
    c = rel.landmark_eligible(cohorts.churn(spark, sf), LANDMARK)
    return c.select("subject_id", rel.landmark_label(LANDMARK, "as_documented").alias("label_documented"),
                    rel.landmark_label(LANDMARK, "as_coded").alias("label_coded"))


@query("P11_value_map", f"""WITH {CHURN}
SELECT subject_id, CASE event WHEN 0 THEN 'Alive' WHEN 1 THEN 'Death' END AS status FROM churn""")
def p11(spark, sf):
    c = cohorts.churn(spark, sf)
    return c.select("subject_id", rel.value_map("event", {0: "Alive", 1: "Death"}).alias("status"))


def _p12_sql() -> str:
    from riskset.plans.survival_q import _k8_sql
    return f"""SELECT variable, p_value, p_value < 0.05 AS significant FROM ({_k8_sql()}) q"""


@query("P12_significance_flag", _p12_sql())
def p12(spark, sf):
    lr = sv.logrank(cohorts.churn(spark, sf), ["segment", "acct_band", "order_band"])
    return round_doubles(rel.significance(lr.select("variable", "p_value")))


@query("P13_threshold_flags", """SELECT l_orderkey, l_linenumber,
  (l_discount < 0 OR l_discount > 0.08) AS discount_outside, l_tax < 0 AS tax_negative, l_quantity > 45 AS quantity_above
FROM lineitem""")
def p13(spark, sf):
    li = driver_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", rel.outside("l_discount", 0, 0.08).alias("discount_outside"),
                     rel.negative("l_tax").alias("tax_negative"), rel.above("l_quantity", 45).alias("quantity_above"))


@query("J1_attach_labels", f"""WITH {CHURN}, st AS (SELECT avg(acctbal) AS m, stddev_pop(acctbal) AS s FROM churn)
SELECT c.subject_id, {r('(c.acctbal - st.m) / st.s', 'acctbal')}, cu.c_mktsegment AS c_mktsegment_label, cu.c_name AS c_name_label
FROM churn c, st JOIN customer cu ON cu.c_custkey = c.subject_id""")
def j1(spark, sf):
    prepared = standardize(cohorts.churn(spark, sf).select("subject_id", "acctbal"), ["acctbal"])
    raw = driver_table(spark, sf, "customer").withColumnRenamed("c_custkey", "subject_id")
    return round_doubles(rel.attach_labels(prepared, raw, "subject_id", ["c_mktsegment", "c_name"]))


@query("J2_stack_results", """SELECT 'segment' AS variable, c_mktsegment AS level, count(*) AS n FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def j2(spark, sf):
    a = driver_table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("level")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("segment").alias("variable"), "level", "n")
    b = driver_table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("level")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("variable"), "level", "n")
    return rel.stack(a, b)

