"""Landmark classification queries."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskset.operators import classify as cl
from riskset.operators import prepare as pp
from riskset.operators import profile as pf
from riskset.operators import serving
from riskset.operators import survival as sv
from riskset.operators.prefix import attach_one_row
from riskset.plans.prepare_q import E9_PLAN
from riskset.plans.registry import query, round_doubles
from riskset.plans.sql import CHURN, km_sql, r
from riskset.session import ensure_checkpoint_dir, materialize
from riskset.sources import cohorts
from riskset.sources.io import driver_table

SEED = 42
LAND_SQL = f"""{CHURN}, land AS (SELECT *, CAST(CASE WHEN duration >= 1825 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM churn WHERE NOT (duration < 1825 AND event = 0))"""
SPLIT_SQL = f"""{LAND_SQL},
hk AS (SELECT *, md5(CAST(subject_id AS VARCHAR) || '-{SEED}') AS hh FROM land),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hh, subject_id) AS rnk,
              count(*) OVER (PARTITION BY label) AS ny FROM hk),
split AS (SELECT *, CASE WHEN rnk <= round(0.2 * ny) THEN 'test' ELSE 'train' END AS split FROM rk)"""

# Text-score fixture: documents with a toxicity label, score from length.
DOC_SCORE_SQL = """docs AS (SELECT d.doc_id, l.toxic AS label, 1.0 - exp(-d.n_chars / 5000.0) AS prob,
  CASE WHEN 1.0 - exp(-d.n_chars / 5000.0) >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _land_split(spark, sf):
    return cl.stratified_split(cohorts.landmark(spark, sf), "label", "subject_id", 0.2, SEED)


def _doc_scores(spark, sf):
    d = driver_table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = driver_table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    prob = F.lit(1.0) - F.exp(-F.col("n_chars") / 5000.0)
    return d.join(lab, "doc_id").select("doc_id", "label", prob.alias("prob"),
                                        (prob >= 0.5).cast("int").alias("prediction"))


@query("M1_stratified_split", f"WITH {SPLIT_SQL} SELECT subject_id, label, split FROM split")
def m1(spark, sf):
    return _land_split(spark, sf).select("subject_id", "label", "split")


@query("A21_class_balance", f"""WITH {LAND_SQL}
SELECT label, CASE label WHEN 0 THEN 'not reached' WHEN 1 THEN 'reached landmark' END AS name, count(*) AS n,
  {r('100.0 * count(*) / sum(count(*)) OVER ()', 'pct')},
  {r('sum(CASE WHEN label = 1 THEN count(*) ELSE 0 END) OVER () / sum(count(*)) OVER ()', 'positive_rate')}
FROM land GROUP BY label""")
def a21(spark, sf):
    return round_doubles(pf.class_balance(cohorts.landmark(spark, sf), "label",
                                          {0: "not reached", 1: "reached landmark"}))


@query("A22_split_summary", f"""WITH {SPLIT_SQL}
SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive, CAST(sum(1 - label) AS BIGINT) AS n_negative,
  {r('avg(label)', 'positive_rate')} FROM split GROUP BY split""")
def a22(spark, sf):
    return round_doubles(pf.split_summary(_land_split(spark, sf), "split", "label"))


@query("M2_majority_baseline", f"""WITH {SPLIT_SQL},
maj AS (SELECT label AS m FROM split WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT subject_id, label, CAST(m AS DOUBLE) AS prob, m AS prediction FROM split, maj WHERE split = 'test'""")
def m2(spark, sf):
    s = _land_split(spark, sf)
    maj = cl.majority_class(s.where("split = 'train'"), "label")
    return cl.baseline_scores(s.where("split = 'test'").select("subject_id", "label"), maj)


@query("M3_class_weights", f"""WITH {SPLIT_SQL}, per AS (SELECT label, count(*) AS n FROM split WHERE split = 'train' GROUP BY label)
SELECT label, n, {r('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)', 'weight')},
  {r('CAST(sum(CASE WHEN label = 0 THEN n ELSE 0 END) OVER () AS DOUBLE) / sum(CASE WHEN label = 1 THEN n ELSE 0 END) OVER ()', 'neg_pos_ratio')}
FROM per""")
def m3(spark, sf):
    return round_doubles(cl.class_weights(_land_split(spark, sf).where("split = 'train'"), "label"))


def _model_frame(spark, sf):
    """Landmark table with the fitted E9 column plan (fit on train rows only)."""
    s = _land_split(spark, sf)
    params = pp.fit_columns(s.where("split = 'train'"), E9_PLAN)
    plan = pp.ColumnPlan(median_scale=E9_PLAN.median_scale, ordinal=E9_PLAN.ordinal,
                         onehot_if_binary=E9_PLAN.onehot_if_binary, onehot_all=E9_PLAN.onehot_all,
                         passthrough=list(E9_PLAN.passthrough) + ["label", "split"])
    # Cut lineage once: every tree-building pass re-reads this table.
    table = materialize(pp.transform_columns(s, plan, params))
    features = [c for c in table.columns if c not in ("subject_id", "duration", "event", "label", "split")]
    return table, features


def _rf(spark, sf):
    table, features = _model_frame(spark, sf)
    train = table.where("split = 'train'")
    w = cl.class_weights(train, "label")
    model = cl.random_forest(cl.with_weights(train, w, "label"), features, "label")
    return table, features, model


@query("M4_random_forest")
def m4(spark, sf):
    table, _, model = _rf(spark, sf)
    return round_doubles(cl.score(model, table.where("split = 'test'"), ["subject_id", "label"]))


@query("M5_boosting")
def m5(spark, sf, rounds: int = 200):
    table, features = _model_frame(spark, sf)
    train = table.where("split = 'train'")
    ratio = cl.class_weights(train, "label").select("neg_pos_ratio").first()[0]
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(ratio))).otherwise(1.0))
    model = cl.boosting(weighted, features, "label", rounds=rounds)
    return round_doubles(cl.score(model, table.where("split = 'test'"), ["subject_id", "label"]))


@query("M10_feature_importances")
def m10(spark, sf):
    _, features, model = _rf(spark, sf)
    return round_doubles(cl.importances(model, features, top=10))


@query("S5_model_save_load")
def s5(spark, sf):
    table, _, model = _rf(spark, sf)
    path = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    cl.save_model(model, path)
    loaded = cl.load_model(path)
    return round_doubles(cl.score(loaded, table.where("split = 'test'"), ["subject_id", "label"]))


_TEST_ROWS = f"WITH {SPLIT_SQL} SELECT subject_id, label, true AS in_range, true AS cut_at_half FROM split WHERE split = 'test'"


def _contract(scored):
    """What holds for any fitted model: keys and labels of the test rows, probabilities in [0, 1], the 0.5 cut."""
    return scored.select("subject_id", "label", F.col("prob").between(0.0, 1.0).alias("in_range"),
                         ((F.col("prob") > 0.5) == (F.col("prediction") == 1)).alias("cut_at_half"))


@query("M4_forest_contract", _TEST_ROWS)
def m4_contract(spark, sf):
    table, _, model = _rf(spark, sf)
    return _contract(cl.score(model, table.where("split = 'test'"), ["subject_id", "label"]))


@query("M5_boosting_contract", _TEST_ROWS)
def m5_contract(spark, sf):
    return _contract(m5(spark, sf, rounds=20))


@query("M10_importances_contract", "SELECT 1.0::DOUBLE AS total, true AS ranked, true AS not_negative")
def m10_contract(spark, sf):
    _, features, model = _rf(spark, sf)
    return cl.importances(model, features).agg(
        F.round(F.sum("importance"), 6).alias("total"),
        (F.max("rank") == F.count(F.lit(1))).alias("ranked"), (F.min("importance") >= 0).alias("not_negative"))


@query("S5_reloaded_equals_saved", f"WITH {SPLIT_SQL} SELECT subject_id, label, true AS same FROM split WHERE split = 'test'")
def s5_same(spark, sf):
    table, _, model = _rf(spark, sf)
    path = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    cl.save_model(model, path)
    test = table.where("split = 'test'")
    own = cl.score(model, test, ["subject_id", "label"])
    again = cl.score(cl.load_model(path), test, ["subject_id"]).select("subject_id", F.col("prob").alias("prob2"))
    return own.join(again, "subject_id").select("subject_id", "label", (F.col("prob") == F.col("prob2")).alias("same"))


@query("M9_fitted_models", f"""WITH {SPLIT_SQL},
top AS (SELECT label FROM split WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
base AS (SELECT {r('avg(CASE WHEN s.label = top.label THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM split s, top WHERE s.split = 'test')
SELECT 'forest' AS model, true AS auc_in_range, NULL::DOUBLE AS accuracy
UNION ALL SELECT 'majority', true, accuracy FROM base""")
def m9_fitted(spark, sf):
    """The fitted forest and the majority baseline on one test set."""
    table, _, model = _rf(spark, sf)
    test = table.where("split = 'test'")
    scored = {"forest": materialize(cl.score(model, test, ["subject_id", "label"])),
              "majority": cl.baseline_scores(test.select("subject_id", "label"),
                                             cl.majority_class(table.where("split = 'train'"), "label"))}
    out = cl.compare_models(scored)
    return round_doubles(out.select("model", F.coalesce(F.col("auc").between(0.0, 1.0), F.lit(True)).alias("auc_in_range"),
                                    F.when(F.col("model") == "majority", F.col("accuracy")).alias("accuracy")))


@query("M11_scored_profiles", f"""WITH {SPLIT_SQL} SELECT subject_id, true AS in_range, true AS verdict_fits FROM split
  WHERE split = 'test'""")
def m11_scored(spark, sf):
    """Verdicts of the fitted model on the test rows, from probability to gauge band."""
    table, _, model = _rf(spark, sf)
    out = cl.verdicts(cl.score(model, table.where("split = 'test'"), ["subject_id"]))
    return out.select("subject_id", F.col("prob").between(0.0, 1.0).alias("in_range"),
                      ((F.col("prob") >= 0.5) == (F.col("verdict") == "Favorable profile")).alias("verdict_fits"))


PROFILE_PLAN = serving.ProfilePlan(numeric=["n_orders", "mean_price", "acctbal"], log1p=["n_orders", "mean_price"],
                                   ordinal={"order_band": ["le8", "9to11", "gt11"]},
                                   onehot_if_binary=["acct_band"], onehot_all=["segment"])
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
OPEN_PROFILES = """profiles AS (
  SELECT c.c_custkey AS subject_id, c.c_mktsegment AS segment,
    CASE WHEN c.c_acctbal >= 5000 THEN 'high' ELSE 'low' END AS acct_band,
    CASE WHEN o.n_orders <= 8 THEN 'le8' WHEN o.n_orders <= 11 THEN '9to11' WHEN o.n_orders > 11 THEN 'gt11' END AS order_band,
    o.n_orders, c.c_acctbal AS acctbal, o.mean_price
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders
    WHERE o_orderdate >= TIMESTAMP '2000-09-01' GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""


def _raw_train(spark, sf):
    """Raw training rows of the split with balanced weights, read by every fit."""
    train = materialize(_land_split(spark, sf).where("split = 'train'").drop("split"))
    return cl.with_weights(train, cl.class_weights(train, "label"), "label")


def _prepared_sql() -> str:
    logged = {"n_orders": "ln(1 + CAST(n_orders AS DOUBLE))", "mean_price": "ln(1 + mean_price)", "acctbal": "acctbal"}
    stats = ", ".join(f"avg({x}) AS m_{c}, stddev_samp({x}) AS s_{c}" for c, x in logged.items())
    cells = ", ".join(r(f"(coalesce({x}, m_{c}) - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END)", c)
                      for c, x in logged.items())
    hot = ", ".join(f"CASE WHEN segment = '{s}' THEN 1.0 ELSE 0.0 END AS \"segment_{s}\"" for s in _SEGMENTS)
    return f"""WITH {SPLIT_SQL}, {OPEN_PROFILES}, st AS (SELECT {stats} FROM split WHERE split = 'train'),
common AS (SELECT order_band AS band FROM split WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT subject_id, {cells},
  CAST(list_position(['le8', '9to11', 'gt11'], coalesce(order_band, band)) - 1 AS DOUBLE) AS order_band,
  CASE WHEN acct_band = 'low' THEN 1.0 ELSE 0.0 END AS acct_band_low, {hot}
FROM profiles, st, common"""


@query("E10_E11_prepared_profiles", _prepared_sql())
def prepared_profiles(spark, sf):
    """Raw profiles through the stored preparation: saved, loaded, applied."""
    path = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    cl.save_model(serving.fit_preparation(_raw_train(spark, sf), PROFILE_PLAN), path)
    return round_doubles(cl.load_model(path).transform(cohorts.open_profiles(spark, sf)))


@query("M11_raw_profiles", f"""WITH {OPEN_PROFILES}
SELECT subject_id, true AS same, true AS verdict_fits, true AS band_fits FROM profiles""")
def m11_raw(spark, sf):
    """Raw profiles to verdicts by the stored model, held against the same steps taken one by one."""
    train = _raw_train(spark, sf)
    model = serving.fit_profile_model(train, PROFILE_PLAN, "label", "weight")
    path = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    cl.save_model(model, path)
    raw = cohorts.open_profiles(spark, sf)
    out = cl.verdicts(cl.score(cl.load_model(path), raw, ["subject_id"]))
    # Step by step: the preparation's functions on their own, then assembler and forest as fitted.
    logged = pp.log1p_columns(train, PROFILE_PLAN.log1p)
    sc = pp.fit_scaler(logged, PROFILE_PLAN.numeric, ddof=1)
    kinds = list(PROFILE_PLAN.ordinal) + PROFILE_PLAN.onehot_if_binary + PROFILE_PLAN.onehot_all
    levels = pp.fit_levels(train, PROFILE_PLAN.onehot_if_binary + PROFILE_PLAN.onehot_all)
    one = pp.fill_with_means(pp.log1p_columns(raw, PROFILE_PLAN.log1p), sc, PROFILE_PLAN.numeric)
    one = pp.scale(pp.impute(one, pp.fit_mode(train, kinds)), sc)
    one = one.withColumn("order_band", pp.ordinal_encode("order_band", PROFILE_PLAN.ordinal["order_band"]))
    one = pp.one_hot(one, levels, PROFILE_PLAN.onehot_if_binary, "if_binary")
    one = pp.one_hot(one, levels, PROFILE_PLAN.onehot_all)
    again = cl.score(PipelineModel(model.stages[-2:]), one, ["subject_id"]).select(
        "subject_id", F.col("prob").alias("prob2"))
    low, high = F.col("pct") < 40, F.col("pct") >= 60
    fits = F.when(low, "unfavorable").when(high, "favorable").otherwise("intermediate")
    return out.join(again, "subject_id").select(
        "subject_id", (F.abs(F.col("prob") - F.col("prob2")) < 1e-9).alias("same"),
        ((F.col("prob") >= 0.5) == (F.col("verdict") == "Favorable profile")).alias("verdict_fits"),
        (F.col("band") == fits).alias("band_fits"))


@query("M9_all_models", f"""WITH {SPLIT_SQL}, t AS (SELECT count(*) AS n_test, CAST(sum(label) AS BIGINT) AS n_positive
  FROM split WHERE split = 'test'), maj AS (SELECT label AS m FROM split WHERE split = 'train' GROUP BY label
  ORDER BY count(*) DESC, label LIMIT 1),
b AS (SELECT {r('avg(CASE WHEN label = m THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM split, maj WHERE split = 'test')
SELECT name AS model, n_test, n_positive, CASE WHEN name = 'majority' AND n_positive BETWEEN 1 AND n_test - 1 THEN 0.5::DOUBLE END AS base_auc,
  CASE WHEN name = 'majority' THEN accuracy END AS base_accuracy, true AS auc_agrees, true AS accuracy_agrees
FROM t, b, (VALUES ('majority'), ('forest'), ('boosting')) v(name)""")
def m9_all(spark, sf):
    """Baseline, forest and boosting on one test set. The numbers of the comparison are
    held against plain SQL over the stored scores: mid-ranks for the AUC, a count for the accuracy."""
    table, features = _model_frame(spark, sf)
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    weights = cl.class_weights(train, "label")
    forest = cl.random_forest(cl.with_weights(train, weights, "label"), features, "label")
    ratio = weights.select("neg_pos_ratio").first()[0]
    boosted = cl.boosting(train.withColumn("weight", F.when(F.col("label") == 1, F.lit(ratio)).otherwise(1.0)),
                          features, "label", rounds=20)
    keep = ["subject_id", "label"]
    scored = {"majority": cl.baseline_scores(test.select(*keep), cl.majority_class(train, "label")),
              "forest": materialize(cl.score(forest, test, keep)), "boosting": materialize(cl.score(boosted, test, keep))}
    found = cl.compare_models(scored)
    rows = None
    for name, df in scored.items():
        part = df.select(F.lit(name).alias("model"), "label", "prob", "prediction")
        rows = part if rows is None else rows.unionByName(part)
    rows.createOrReplaceTempView("riskset_scores")
    plain = spark.sql("""WITH c AS (SELECT model, prob, count(*) n, sum(label) pos, sum(if(label = prediction, 1, 0)) hit
        FROM riskset_scores GROUP BY model, prob),
      k AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY prob) - n + (n + 1) / 2.0D AS mid FROM c)
      SELECT model, sum(n) n_test, sum(pos) n_positive, sum(hit) / sum(n) AS acc,
        try_divide(sum(pos * mid) - sum(pos) * (sum(pos) + 1) / 2.0D, cast(sum(pos) AS double) * (sum(n) - sum(pos))) AS area
      FROM k GROUP BY model""")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) < 1e-9, F.col(a).isNull() & F.col(b).isNull())
    base = F.col("model") == "majority"
    return round_doubles(found.join(plain, "model").select(
        "model", F.col("n_test").cast("long").alias("n_test"), F.col("n_positive").cast("long").alias("n_positive"),
        F.when(base, F.col("auc")).alias("base_auc"), F.when(base, F.col("accuracy")).alias("base_accuracy"),
        near("auc", "area").alias("auc_agrees"), near("accuracy", "acc").alias("accuracy_agrees")))


@query("M6_classification_report", f"""WITH {DOC_SCORE_SQL},
cm AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM docs GROUP BY 1, 2),
cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm),
per AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE actual = c), 0) AS support,
               coalesce((SELECT sum(n) FROM cm WHERE predicted = c), 0) AS npred,
               coalesce((SELECT sum(n) FROM cm WHERE actual = c AND predicted = c), 0) AS tp FROM cls),
pr AS (SELECT c, support, tp, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS p,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS f1 FROM pr)
SELECT CAST(c AS VARCHAR) AS label, {r('p', 'precision')}, {r('rc', 'recall')}, {r('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, {r('sum(tp) / sum(support)', 'f1')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {r('avg(p)', 'p')}, {r('avg(rc)', 'r')}, {r('avg(f1)', 'f')}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {r('sum(p * support) / sum(support)', 'p')}, {r('sum(rc * support) / sum(support)', 'r')},
  {r('sum(f1 * support) / sum(support)', 'f')}, CAST(sum(support) AS BIGINT) FROM f""")
def m6(spark, sf):
    return round_doubles(cl.classification_report(_doc_scores(spark, sf)))


_AUC_SQL = """(SELECT sum(pos * (coalesce(negb, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) FROM (
  SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS negb
  FROM (SELECT {score} AS score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
        FROM {src} GROUP BY 1)))"""


@query("M7_roc_auc", f"WITH {DOC_SCORE_SQL} SELECT {r(_AUC_SQL.format(score='prob', src='docs'), 'auc')}")
def m7(spark, sf):
    return round_doubles(cl.roc_auc(_doc_scores(spark, sf)))


@query("M8_roc_curve", f"""WITH {DOC_SCORE_SQL},
s AS (SELECT prob AS score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM docs GROUP BY prob),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N
      FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT {r('score', 'threshold')}, {r('fp / N', 'fpr')}, {r('tp / P', 'tpr')} FROM c
UNION ALL SELECT NULL, 0.0, 0.0""")
def m8(spark, sf):
    return round_doubles(cl.roc_curve(_doc_scores(spark, sf)))


@query("M8_roc_curve_drop_intermediate", f"""WITH {DOC_SCORE_SQL},
s AS (SELECT prob AS score, sum(label) AS pos, sum(1 - label) AS neg FROM docs GROUP BY prob),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N
      FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, lag(fp) OVER o AS fp_prev, lead(fp) OVER o AS fp_next, lag(tp) OVER o AS tp_prev,
             lead(tp) OVER o AS tp_next FROM c WINDOW o AS (ORDER BY score DESC))
SELECT {r('score', 'threshold')}, {r('CAST(fp AS DOUBLE) / N', 'fpr')}, {r('CAST(tp AS DOUBLE) / P', 'tpr')} FROM l
WHERE fp_prev IS NULL OR fp_next IS NULL OR fp_next - 2 * fp + fp_prev <> 0 OR tp_next - 2 * tp + tp_prev <> 0
UNION ALL SELECT NULL, 0.0, 0.0""")
def m8d(spark, sf):
    return round_doubles(cl.roc_curve(_doc_scores(spark, sf), drop_intermediate=True))


@query("M9_model_comparison", f"""WITH {DOC_SCORE_SQL},
inv AS (SELECT doc_id, label, 1.0 - prob AS prob, 1 - prediction AS prediction FROM docs),
base AS (SELECT doc_id, label, 0.0 AS prob, 0 AS prediction FROM docs)
SELECT 'length_score' AS model, {r(_AUC_SQL.format(score='prob', src='docs'), 'auc')},
       {r('(SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM docs)', 'accuracy')}
UNION ALL SELECT 'inverted_score', {r(_AUC_SQL.format(score='prob', src='inv'), 'auc')},
       {r('(SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM inv)', 'accuracy')}
UNION ALL SELECT 'majority_baseline', {r(_AUC_SQL.format(score='prob', src='base'), 'auc')},
       {r('(SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM base)', 'accuracy')}""")
def m9(spark, sf):
    d = _doc_scores(spark, sf)
    inv = d.select("doc_id", "label", (1.0 - F.col("prob")).alias("prob"), (1 - F.col("prediction")).alias("prediction"))
    base = cl.baseline_scores(d.select("doc_id", "label"), 0)
    return round_doubles(cl.compare_models({"length_score": d, "inverted_score": inv, "majority_baseline": base}))


@query("M11_verdicts", f"""WITH {DOC_SCORE_SQL}
SELECT doc_id, {r('prob', 'prob')}, CAST(trunc(prob * 100) AS INTEGER) AS pct,
  CASE WHEN prob >= 0.5 THEN 'Favorable profile' ELSE 'Unfavorable profile' END AS verdict,
  CASE WHEN trunc(prob * 100) < 40 THEN 'unfavorable' WHEN trunc(prob * 100) < 60 THEN 'intermediate' ELSE 'favorable' END AS band
FROM docs""")
def m11(spark, sf):
    return round_doubles(cl.verdicts(_doc_scores(spark, sf).select("doc_id", "prob")))


@query("M12_confusion_matrix", f"WITH {DOC_SCORE_SQL} SELECT label AS actual, prediction AS predicted, count(*) AS n FROM docs GROUP BY 1, 2")
def m12(spark, sf):
    return cl.confusion(_doc_scores(spark, sf))


@query("A23_kpi_row", f"""WITH {CHURN}, {km_sql('churn', [])},
au AS (SELECT {_AUC_SQL.format(score='CAST(n_orders AS DOUBLE)', src='(SELECT n_orders, event AS label FROM churn)')} AS auc)
SELECT (SELECT count(*) FROM churn) AS n, {r('(SELECT avg(event) FROM churn)', 'event_rate')},
       {r('(SELECT min(CASE WHEN survival <= 0.5 THEN t END) FROM km)', 'median_survival')}, {r('auc', 'auc')} FROM au""")
def a23(spark, sf):
    c = cohorts.churn(spark, sf)
    head = c.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("event").cast("double")).alias("event_rate"))
    med = sv.survival_quantile(sv.kaplan_meier(c), None, 0.5, "median_survival")
    auc = cl.roc_auc(c.select(F.col("event").alias("label"), F.col("n_orders").cast("double").alias("prob")))
    return round_doubles(attach_one_row(attach_one_row(head, med), auc))


@query("A23_kpi_model_auc", f"""WITH {SPLIT_SQL}, {km_sql('churn', [])}
SELECT (SELECT count(*) FROM churn) AS n, {r('(SELECT avg(event) FROM churn)', 'event_rate')},
       {r('(SELECT min(CASE WHEN survival <= 0.5 THEN t END) FROM km)', 'median_survival')},
       (SELECT count(*) FROM split WHERE split = 'test') AS n_scored, true AS auc_in_range""")
def a23_model(spark, sf):
    """The KPI row with the AUC of the fitted forest on the test rows."""
    c = cohorts.churn(spark, sf)
    model = serving.fit_profile_model(_raw_train(spark, sf), PROFILE_PLAN, "label", "weight")
    test = _land_split(spark, sf).where("split = 'test'")
    scored = materialize(cl.score(model, test, ["subject_id", "label"]))
    row = cl.kpi_row(c, scored)
    return round_doubles(row.select("n", "event_rate", "median_survival", "n_scored",
                                    F.coalesce(F.col("auc").between(0.0, 1.0), F.lit(True)).alias("auc_in_range")))
