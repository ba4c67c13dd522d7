"""Feature selection on long-form data.

Wide genomic blocks are handled as (subject, feature, value): the variance
filter and the target correlation are single grouped aggregates over all
features at once, the ranking is a top-k (TakeOrderedAndProject), and the
model table is assembled by a broadcast semi-join on the selected names
followed by a pivot over the bounded list of winners.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.operators.prefix import BROADCAST_ROW_LIMIT, keys_bounded
from riskset.session import materialize

MAX_COLUMNS = 2000           # feature columns of a wide table
VECTOR_CELLS = 1 << 20       # vector components laid out at once


def feature_variance(long: DataFrame, threshold: float = 0.01, feature: str = "feature",
                     value: str = "value") -> DataFrame:
    """population variance per feature and a keep flag (variance > threshold)."""
    return long.groupBy(feature).agg(F.var_pop(value).alias("variance")).select(
        feature, "variance", (F.col("variance") > threshold).alias("keep"))


def target_correlation(long: DataFrame, target: str, feature: str = "feature",
                       value: str = "value") -> DataFrame:
    """Pearson correlation of each feature with the target, and |r|."""
    return long.groupBy(feature).agg(F.corr(F.col(value), F.col(target).cast("double")).alias("corr")).select(
        feature, "corr", F.abs("corr").alias("abs_corr"))


def top_k(scores: DataFrame, k: int, score: str = "abs_corr", name: str = "feature") -> DataFrame:
    """the k best features by score, ties broken by name (TakeOrderedAndProject)."""
    ranked = scores.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(name)).limit(k)
    return ranked


def selection_funnel(long: DataFrame, target: str, threshold: float, ks: Sequence[int],
                     feature: str = "feature", value: str = "value") -> DataFrame:
    """(stage, n_features) from all features through the variance filter to each top-k."""
    var = feature_variance(long, threshold, feature, value)
    kept = var.where("keep").select(feature)
    corr = target_correlation(long.join(kept, feature, "left_semi"), target, feature, value)
    counts = var.agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("keep").cast("long")).alias("kept"))
    n_scored = corr.agg(F.count("corr").alias("scored"))
    stages = counts.select(F.inline(F.array(
        F.struct(F.lit(1).alias("step"), F.lit("all features").alias("stage"), F.col("all").alias("n_features")),
        F.struct(F.lit(2).alias("step"), F.lit(f"variance > {threshold}").alias("stage"), F.col("kept").alias("n_features")))))
    tops = n_scored.select(F.inline(F.array(*[
        F.struct(F.lit(3 + i).alias("step"), F.lit(f"top {k}").alias("stage"),
                 F.least(F.col("scored"), F.lit(k)).cast("long").alias("n_features")) for i, k in enumerate(ks)])))
    return stages.unionByName(tops)


def assemble(long: DataFrame, selected: DataFrame, id_col: str, extra: Sequence[str] = (),
             feature: str = "feature", value: str = "value") -> DataFrame:
    """F5 (long form): rows of the selected features only, via a semi-join;
    the selection is broadcast if a bounded count finds it small."""
    names = materialize(selected.select(feature))
    small = keys_bounded(names, [feature])
    return long.join(F.broadcast(names) if small else names, feature, "left_semi").select(
        id_col, *extra, feature, value)


def assemble_wide(long: DataFrame, selected: DataFrame, id_col: str, extra: Sequence[str] = (),
                  feature: str = "feature", value: str = "value", prefix: str = "f_") -> DataFrame:
    """F5 (wide): one column per selected feature. A column per name needs the
    names on the driver: more than ``MAX_COLUMNS`` of them are refused (use
    :func:`feature_vectors` or the long form). The selection is evaluated once."""
    names = [r[0] for r in selected.select(feature).limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} selected features: use the long form")
    rows = long.where(F.col(feature).isin(names)).select(id_col, *extra, feature, value)
    wide = rows.groupBy(id_col, *extra).pivot(feature, names).agg(F.first(value))
    return wide.select(id_col, *extra, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])


def feature_vectors(long: DataFrame, selected: DataFrame, id_col: str, extra: Sequence[str] = (),
                    feature: str = "feature", value: str = "value", out: str = "features") -> tuple[DataFrame, DataFrame]:
    """F5 for any number of features: (id, extra..., vector) and (feature, index).

    Features are numbered by name; a subject's cells of them are gathered,
    sorted by number and laid out as one vector that MLlib takes as it is, with
    NaN where a cell is missing (as the assembler leaves it). No pivot: the plan
    is the same for 10 features and 10,000. The numbers are few against the
    cells (one row a feature) and joined as a checked broadcast; of repeated
    cells the smallest value counts.
    """
    names = materialize(selected.select(F.col(feature).alias("_f")).distinct())
    numbers = materialize(names.withColumn("index", (F.row_number().over(Window.orderBy("_f")) - 1).cast("int")))
    k = numbers.count()
    side = F.broadcast(numbers) if k <= BROADCAST_ROW_LIMIT else numbers
    cells = long.join(side, F.col(feature) == F.col("_f")).select(id_col, *extra, F.struct(
        "index", F.col(value).cast("double").alias("v")).alias("_c")).where(F.col("_c.v").isNotNull())
    rows = cells.groupBy(id_col, *extra).agg(F.collect_list("_c").alias("_c"))

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VECTOR_CELLS // max(1, k))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                own = part.column("_c")
                row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
                flat = own.flatten()
                dense = np.full((len(own), k), np.nan)
                np.fmin.at(dense, (row, flat.field("index").to_numpy()), flat.field("v").to_numpy())
                offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))],
                                                 names=[*part.schema.names[:-1], "_v"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_v", T.ArrayType(T.DoubleType()))])
    vectors = rows.mapInArrow(laid_out, schema).select(id_col, *extra, array_to_vector("_v").alias(out))
    return vectors, numbers.select(F.col("_f").alias(feature), "index")


def model_table(clinical: DataFrame, wide: DataFrame, id_col: str, targets: Sequence[str]) -> DataFrame:
    """clinical columns, selected features and targets, joined on the subject
    (never by row position); subjects without features are left out."""
    features = [c for c in wide.columns if c not in clinical.columns]
    first = [c for c in clinical.columns if c not in targets]
    return clinical.join(wide.select(id_col, *features), id_col).select(*first, *features, *targets)
