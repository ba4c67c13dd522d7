"""Cohorts derived from the driver tables (FIXTURES.md section C).

Each builder reads the parquet tables it needs and returns one row per
subject with a duration, an event flag, strata and covariates. Columns are
pruned at the scan and the one big aggregate (orders per customer) leaves
its output hash-partitioned by customer key, so the join to ``customer``
shuffles only the customer side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskset.sources.io import driver_table

# Fixed values of the fixture cohorts.
CHURN_CUTOFF = "2001-01-01"          # last order before this date = churned (event)
ACCTBAL_SPLIT = 5000.0               # c_acctbal >= 5000 -> 'high'
ORDER_BANDS = ("le8", "9to11", "gt11")  # n_orders <= 8, 9..11, > 11
ITEM_ORIGIN = "1995-01-01"           # X_ITEM durations count days from here
LANDMARK_DAYS = 1825                 # five years
PROFILE_FROM = "2000-09-01"          # open profiles know the orders since then


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X_CHURN: customers with orders.

    duration = days from first to last order, event = last order before the
    cutoff; strata segment / acct_band / order_band; covariates n_orders,
    acctbal, mean_price.
    """
    orders = driver_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.avg("o_totalprice").alias("mean_price"),
        F.min("o_orderdate").alias("_first"),
        F.max("o_orderdate").alias("_last"))
    customer = driver_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    joined = customer.join(per_customer, customer.c_custkey == per_customer.o_custkey)
    return joined.select(
        F.col("c_custkey").alias("subject_id"),
        F.datediff(F.col("_last"), F.col("_first")).cast("double").alias("duration"),
        (F.col("_last") < F.lit(CHURN_CUTOFF).cast("timestamp")).cast("int").alias("event"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") >= ACCTBAL_SPLIT, "high").otherwise("low").alias("acct_band"),
        F.when(F.col("n_orders") <= 8, ORDER_BANDS[0])
         .when(F.col("n_orders") <= 11, ORDER_BANDS[1]).otherwise(ORDER_BANDS[2]).alias("order_band"),
        F.col("n_orders").cast("long").alias("n_orders"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("mean_price"))


def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X_ITEM (scale cohort): one row per line item, heavily tied durations."""
    li = driver_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus",
        "l_quantity", "l_discount", "l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.datediff(F.col("l_shipdate"), F.lit(ITEM_ORIGIN).cast("timestamp")).cast("double").alias("duration"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.col("l_linestatus").alias("linestatus"),
        "l_quantity", "l_discount", "l_extendedprice")


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X_MISS: documents left join labels; label columns null where unlabeled."""
    docs = driver_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = driver_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def wide_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X_WIDE in long form: (vec_id, feature, value, label); feature is 1-based."""
    emb = driver_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", F.posexplode("embedding").alias("_pos", "_v")).select(
        "vec_id", (F.col("_pos") + 1).cast("int").alias("feature"),
        F.col("_v").cast("double").alias("value"), "label")


def landmark(spark: SparkSession, sf_dir: str, mode: str = "as_documented",
             days: float = LANDMARK_DAYS) -> DataFrame:
    """X_LAND: X_CHURN minus subjects censored before the landmark, with the
    0/1 label 'still active at the landmark' (``mode`` as in SURVEY D3)."""
    from riskset.operators.relational import landmark_eligible, landmark_label
    c = landmark_eligible(churn(spark, sf_dir), days)
    return c.withColumn("label", landmark_label(days, mode))


def open_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw profiles to score: every customer, with what their late orders tell.

    Without an order since ``PROFILE_FROM``, the number, mean price and band of
    orders are unknown (null), as on a form that was filled in part.
    """
    late = (driver_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
            .where(F.col("o_orderdate") >= F.lit(PROFILE_FROM).cast("timestamp")).groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("long").alias("n_orders"), F.avg("o_totalprice").alias("mean_price")))
    customer = driver_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return customer.join(late, customer.c_custkey == late.o_custkey, "left").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") >= ACCTBAL_SPLIT, "high").otherwise("low").alias("acct_band"),
        F.when(F.col("n_orders") <= 8, ORDER_BANDS[0]).when(F.col("n_orders") <= 11, ORDER_BANDS[1])
         .when(F.col("n_orders") > 11, ORDER_BANDS[2]).alias("order_band"),
        "n_orders", F.col("c_acctbal").alias("acctbal"), "mean_price")
