"""Landmark classification (M1-M12, S5): split, weights, models, metrics, scoring.

Splits and metrics are exact and distributed: the stratified split finds the
cut of each class in the order of a seeded md5 by refining histograms and compares
every row with it (no shuffle of the input, no class-wide sort), AUC and ROC come from one group-by-score and
one running sum. Models are MLlib pipelines (trees are trained by MLlib's
distributed learners, large forests by ``forest``), persisted with the feature order in the assembler.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.operators import forest, survival
from riskset.operators.prefix import attach_one_row, keys_bounded, running_sums

# Fixed values of the scoring page: verdict at 0.5, gauge bands 0-40-60-100.
VERDICT_CUT = 0.5
BANDS = ((0, 40, "unfavorable"), (40, 60, "intermediate"), (60, 101, "favorable"))


HASH_RANGE = 1 << 60
BANDS_OF_HASH = 256  # into which a class's wanted range of hashes is cut
CUT_ROWS = 50_000    # rows of a class around its cut that are ordered at last
CLASS_LIMIT = 4096   # classes whose cuts the driver holds
MLLIB_ROWS = 4096    # training rows up to which MLlib grows the forest


def _hash_key(id_col: str, seed: int) -> tuple[Column, Column]:
    """md5 of the id and the seed, and its first 60 bits. A missing id is hashed as a text that no id has."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00no id"))
    h = F.md5(F.concat(text, F.lit(f"-{seed}")))
    return h, F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """M1: exact stratified allocation: in each class the round(f * n_y) rows
    with the smallest (md5(id || '-' || seed), id) form the test set.

    The hash of the cut of each class is found by refining histograms: one
    pass counts a class's rows in ``BANDS_OF_HASH`` bands of its range of
    hashes, and the band that holds the wanted rank is the next range, until
    it holds few rows or a single hash. Then every row is compared with the
    cut: no join, no shuffle and no copy of the input's columns; passes grow
    with the logarithm of a class.

    Defined cases: rows without a label are a class of their own; rows without
    an id share one hash; where rows share the id (or have none) at a cut, all
    of them go to the test set, as nothing tells them apart. Raises for more
    than ``CLASS_LIMIT`` classes: such a label is no class.
    """
    h, h60 = _hash_key(id_col, seed)
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError(f"{label} has more than {CLASS_LIMIT} classes")
    base = df.select(F.col(label).alias("_y"), h.alias("_h"), h60.alias("_p"), F.col(id_col).alias("_id"))
    # Per class: the range of hashes with the cut, the rows below it and in it, and the wanted number.
    state = {r[0]: (0, HASH_RANGE, 0, r[1], math.floor(test_fraction * r[1] + 0.5)) for r in rows}
    state = {y: s for y, s in state.items() if s[4]}

    def width(lo: int, hi: int) -> int:
        return max(1, -(-(hi - lo) // BANDS_OF_HASH))

    def ranges(classes: dict) -> DataFrame:
        side = base.sparkSession.createDataFrame(
            [(y, s[0], s[1], width(s[0], s[1])) for y, s in classes.items()],
            T.StructType([T.StructField("_c", base.schema["_y"].dataType), *(
                T.StructField(c, T.LongType()) for c in ("_lo", "_hi", "_w"))]))
        inside = F.col("_y").eqNullSafe(F.col("_c")) & (F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi"))
        return base.join(F.broadcast(side), inside)             # a row for each of at most CLASS_LIMIT classes

    while wide := {y: s for y, s in state.items() if s[3] > CUT_ROWS and s[1] - s[0] > 1}:
        bands: dict = {}
        counted = ranges(wide).groupBy("_y", F.floor((F.col("_p") - F.col("_lo")) / F.col("_w")).alias("_b")).agg(
            F.count(F.lit(1)).alias("n"))
        for r in counted.collect():                             # classes x BANDS_OF_HASH rows at most
            bands.setdefault(r["_y"], []).append((r["_b"], r["n"]))
        for y, (lo, hi, below, _, k) in wide.items():
            step = width(lo, hi)
            for b, n in sorted(bands[y]):
                if below + n >= k:
                    state[y] = (lo + b * step, min(hi, lo + (b + 1) * step), below, n, k)
                    break
                below += n
    cuts = {}
    if state:
        wanted = base.sparkSession.createDataFrame(
            [(y, s[4] - s[2]) for y, s in state.items()],
            T.StructType([T.StructField("_c", base.schema["_y"].dataType), T.StructField("_k", T.LongType())]))
        # Rows that share hash and id are one row of counts; a class has few others here.
        near = ranges(state).groupBy("_y", "_h", "_id").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("_y").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (near.withColumn("_sum", F.sum("n").over(order))
                 .join(F.broadcast(wanted), F.col("_y").eqNullSafe(F.col("_c")))
                 .where((F.col("_sum") >= F.col("_k")) & (F.col("_sum") - F.col("n") < F.col("_k"))).collect())
        cuts = {r["_y"]: (r["_h"], r["_id"]) for r in found}
    test = F.lit(False)
    for y, (cut, last) in cuts.items():
        same = F.col(id_col).isNull() if last is None else F.coalesce(F.col(id_col) <= F.lit(last), F.lit(True))
        test = test | (F.col(label).eqNullSafe(F.lit(y)) & ((h < F.lit(cut)) | ((h == F.lit(cut)) & same)))
    return df.withColumn(out, F.when(test, "test").otherwise("train"))


def majority_class(train: DataFrame, label: str) -> int:
    """M2 fit: the most frequent training label (ties -> smallest)."""
    row = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label)).first()
    return int(row[label])


def baseline_scores(df: DataFrame, majority: int, out: str = "prob") -> DataFrame:
    """M2: constant predicted probability of the positive class."""
    return df.withColumn(out, F.lit(float(majority))).withColumn("prediction", F.lit(majority))


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """M3: balanced weights n / (k * n_c) and the neg/pos ratio, per class."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"),
                  F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("_neg"),
                  F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("_pos"))
    return attach_one_row(per, tot).select(
        label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"),
        F.try_divide(F.col("_neg"), F.col("_pos")).alias("neg_pos_ratio"))


def with_weights(df: DataFrame, weights: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach class weights; broadcast if a bounded count finds few classes."""
    side = weights.select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(side) if keys_bounded(side, [label]) else side, label)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def random_forest(train: DataFrame, features: Sequence[str], label: str, weight: str | None = "weight",
                  trees: int = 200, depth: int = 30, max_bins: int = 32, seed: int = 42) -> PipelineModel:
    """M4: balanced random forest (sqrt features per split).

    ``depth`` 30 is the most that MLlib's node numbers allow; splits are taken
    from ``max_bins`` quantile bins per feature.
    """
    assembler = _assembler(features)
    return PipelineModel([assembler, fit_forest(assembler.transform(train), label, weight, trees, depth, max_bins, seed)])


def fit_forest(rows: DataFrame, label: str, weight: str | None, trees: int, depth: int, max_bins: int, seed: int) -> Model:
    """The forest on the column ``features``: by MLlib, a pass per level, if a count finds few
    rows; else by ``forest.fit``, as MLlib's time and driver memory grow with all nodes of all trees."""
    if rows.count() > MLLIB_ROWS:
        return forest.fit(rows, label, weight, trees, depth, max_bins, seed)
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                                maxBins=max_bins, featureSubsetStrategy="sqrt", seed=seed)
    if weight:
        rf.setWeightCol(weight)
    return rf.fit(rows)


def boosting(train: DataFrame, features: Sequence[str], label: str, weight: str | None = "weight",
             rounds: int = 200, depth: int = 6, step: float = 0.3, seed: int = 42) -> PipelineModel:
    """M5: gradient-boosted trees with a positive-class weight."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth,
                        stepSize=step, seed=seed)
    if weight:
        gbt.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), gbt]).fit(train)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], out: str = "prob") -> DataFrame:
    """Positive-class probability and 0/1 prediction for every row."""
    pred = model.transform(df)
    return pred.select(*keep, vector_to_array("probability")[1].alias(out),
                       F.col("prediction").cast("int").alias("prediction"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n)."""
    return df.groupBy(F.col(label).cast("int").alias("actual"),
                      F.col(prediction).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M6: per class precision / recall / F1 / support, accuracy, macro and
    weighted averages (0/0 -> 0). Rows: '0', '1', ..., 'accuracy',
    'macro avg', 'weighted avg'; accuracy sits in the f1 column."""
    cm = confusion(df, label, prediction)
    per_actual = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    per_pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    classes = per_actual.select("cls").unionByName(per_pred.select("cls")).distinct()
    per = (classes.join(per_actual, "cls", "left").join(per_pred, "cls", "left").join(tp, "cls", "left")
           .fillna(0, ["support", "n_pred", "tp"]))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("cls", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
    tot = per.agg(F.sum("support").alias("_n"), F.sum("tp").alias("_tp"), F.count(F.lit(1)).alias("_k"),
                  F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("_wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("_wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("_wf"))
    rows = per.select(F.col("cls").cast("string").alias("label"), "precision", "recall", "f1",
                      F.col("support").cast("long").alias("support"))
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("_tp") / F.col("_n")).alias("f1"),
                 F.col("_n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("_mp").alias("precision"), F.col("_mr").alias("recall"),
                 F.col("_mf").alias("f1"), F.col("_n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), (F.col("_wp") / F.col("_n")).alias("precision"),
                 (F.col("_wr") / F.col("_n")).alias("recall"), (F.col("_wf") / F.col("_n")).alias("f1"),
                 F.col("_n").cast("long").alias("support")))))
    return rows.unionByName(summary)


def _score_counts(df: DataFrame, label: str, score_col: str) -> DataFrame:
    y = F.col(label).cast("long")
    return df.where(F.col(score_col).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score_col).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score_col: str = "prob") -> DataFrame:
    """M7: exact ROC-AUC with ties = P(s+ > s-) + P(s+ = s-) / 2; null unless both classes occur."""
    per = _score_counts(df, label, score_col)
    cum = running_sums(per, [], "score", {"neg_below": "neg"}, inclusive=False)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return cum.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score_col: str = "prob",
              drop_intermediate: bool = False) -> DataFrame:
    """M8: one point per distinct threshold (score >= threshold is positive):
    (threshold, fpr, tpr), plus the (0, 0) origin with a null threshold.

    ``drop_intermediate`` removes interior points whose false- and
    true-positive counts both have a zero second difference (collinear with
    their neighbours). Neighbours are found by numbering the points with a
    running count and joining on index +/- 1, not by a global lag/lead.
    """
    per = _score_counts(df, label, score_col)
    cum = running_sums(per, [], "score", {"tp": "pos", "fp": "neg", "_i": F.lit(1)}, reverse=True,
                       totals={"P": "pos", "N": "neg"})
    if drop_intermediate:
        prev = cum.select((F.col("_i") + 1).alias("_i"), F.col("tp").alias("_tp_prev"), F.col("fp").alias("_fp_prev"))
        nxt = cum.select((F.col("_i") - 1).alias("_i"), F.col("tp").alias("_tp_next"), F.col("fp").alias("_fp_next"))
        both = cum.join(prev, "_i", "left").join(nxt, "_i", "left")
        bend = ((F.col("_fp_next") - 2 * F.col("fp") + F.col("_fp_prev")) != 0) | \
               ((F.col("_tp_next") - 2 * F.col("tp") + F.col("_tp_prev")) != 0)
        cum = both.where(F.col("_fp_prev").isNull() | F.col("_fp_next").isNull() | bend)
    pts = cum.select(F.col("score").alias("threshold"), F.try_divide("fp", "N").alias("fpr"),
                     F.try_divide("tp", "P").alias("tpr"))
    origin = per.agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> Column:
    return F.avg((F.col(label).cast("int") == F.col(prediction).cast("int")).cast("double"))


def compare_models(scored: dict[str, DataFrame], label: str = "label", score_col: str = "prob",
                   prediction: str = "prediction") -> DataFrame:
    """M9: (model, auc, accuracy) sorted by AUC (desc), then name."""
    parts = []
    for name, df in scored.items():
        auc = roc_auc(df, label, score_col)
        acc = df.agg(accuracy(df, label, prediction).alias("accuracy"))
        parts.append(attach_one_row(auc, acc).select(F.lit(name).alias("model"), "auc", "accuracy"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("auc"), "model")


def kpi_row(cohort: DataFrame, scored: DataFrame, duration: str = "duration", event: str = "event",
            label: str = "label", score_col: str = "prob") -> DataFrame:
    """(n, event_rate, median_survival, n_scored, auc): the cohort's head figures
    with the AUC of a model's scores. The AUC is null unless both classes were scored."""
    head = cohort.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(event).cast("double")).alias("event_rate"))
    curve = survival.kaplan_meier(cohort, duration=duration, event=event)
    med = survival.survival_quantile(curve, None, 0.5, "median_survival")
    n = scored.agg(F.count(F.lit(1)).alias("n_scored"))
    return attach_one_row(attach_one_row(attach_one_row(head, med), n), roc_auc(scored, label, score_col))


def importances(model: PipelineModel, features: Sequence[str], top: int | None = None) -> DataFrame:
    """(rank, feature, importance, mean_importance) from the fitted trees."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))
    if top:
        rows = rows[:top]
    mean = sum(imp) / len(imp) if imp else 0.0
    return SparkSession.getActiveSession().createDataFrame([(i + 1, f, float(v), float(mean)) for i, (f, v) in enumerate(rows)],
                             "rank int, feature string, importance double, mean_importance double")


def verdicts(df: DataFrame, prob: str = "prob") -> DataFrame:
    """Truncated percent, verdict at 0.5 and gauge band per scored row."""
    pct = (F.col(prob) * 100).cast("int")
    band = F.lit(None).cast("string")
    for lo, hi, name in reversed(BANDS):
        band = F.when((pct >= lo) & (pct < hi), F.lit(name)).otherwise(band)
    verdict = F.when(F.col(prob) >= VERDICT_CUT, "Favorable profile").otherwise("Unfavorable profile")
    return df.withColumn("pct", pct).withColumn("verdict", verdict).withColumn("band", band)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline (the assembler keeps the feature order)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
