"""Feature selection queries (F1-F5) over the exploded embedding table."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskset.operators import select as fs
from riskset.plans.registry import query, round_doubles
from riskset.plans.sql import CHURN, WIDE, r
from riskset.session import ensure_checkpoint_dir
from riskset.sources import cohorts
from riskset.sources.io import export_many

THRESHOLD = 0.01          # the reference's variance threshold
THRESHOLD_STRICT = 0.016  # a cut that actually removes part of these features
TOP_K = 10


@query("F1_variance_filter", f"""WITH {WIDE}
SELECT feature, {r('var_pop(value)', 'variance')}, var_pop(value) > {THRESHOLD} AS keep FROM wide GROUP BY feature""")
def f1(spark, sf):
    return round_doubles(fs.feature_variance(cohorts.wide_long(spark, sf), THRESHOLD))


@query("F1_variance_filter_strict", f"""WITH {WIDE}
SELECT feature, {r('var_pop(value)', 'variance')}, var_pop(value) > {THRESHOLD_STRICT} AS keep FROM wide GROUP BY feature""")
def f1s(spark, sf):
    return round_doubles(fs.feature_variance(cohorts.wide_long(spark, sf), THRESHOLD_STRICT))


@query("F2_target_correlation", f"""WITH {WIDE}
SELECT feature, {r('corr(value, CAST(label AS DOUBLE))', 'corr')}, {r('abs(corr(value, CAST(label AS DOUBLE)))', 'abs_corr')}
FROM wide GROUP BY feature""")
def f2(spark, sf):
    return round_doubles(fs.target_correlation(cohorts.wide_long(spark, sf), "label"))


_TOPK_SQL = f"""WITH {WIDE}, k AS (SELECT feature, var_pop(value) AS v FROM wide GROUP BY feature HAVING var_pop(value) > {THRESHOLD_STRICT}),
c AS (SELECT w.feature, corr(w.value, CAST(w.label AS DOUBLE)) AS corr FROM wide w JOIN k ON k.feature = w.feature GROUP BY w.feature),
top AS (SELECT feature, corr, abs(corr) AS abs_corr FROM c WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, feature LIMIT {TOP_K})"""


def _selected(spark, sf):
    long = cohorts.wide_long(spark, sf)
    kept = fs.feature_variance(long, THRESHOLD_STRICT).where("keep").select("feature")
    corr = fs.target_correlation(long.join(kept, "feature", "left_semi"), "label")
    return long, fs.top_k(corr, TOP_K)


@query("F3_top_k", f"{_TOPK_SQL} SELECT feature, {r('corr', 'corr')}, {r('abs_corr', 'abs_corr')} FROM top")
def f3(spark, sf):
    _, top = _selected(spark, sf)
    return round_doubles(top)


@query("F4_selection_funnel", f"""WITH {WIDE}, v AS (SELECT feature, var_pop(value) > {THRESHOLD_STRICT} AS keep FROM wide GROUP BY feature)
SELECT 1 AS step, 'all features' AS stage, count(*) AS n_features FROM v
UNION ALL SELECT 2, 'variance > {THRESHOLD_STRICT}', CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) FROM v
UNION ALL SELECT 3, 'top 5', CAST(least(sum(CASE WHEN keep THEN 1 ELSE 0 END), 5) AS BIGINT) FROM v
UNION ALL SELECT 4, 'top 10', CAST(least(sum(CASE WHEN keep THEN 1 ELSE 0 END), 10) AS BIGINT) FROM v""")
def f4(spark, sf):
    return fs.selection_funnel(cohorts.wide_long(spark, sf), "label", THRESHOLD_STRICT, [5, 10])


@query("F5_assemble_long", f"""{_TOPK_SQL}
SELECT w.vec_id, w.label, w.feature, {r('w.value', 'value')} FROM wide w JOIN top t ON t.feature = w.feature""")
def f5(spark, sf):
    long, top = _selected(spark, sf)
    return round_doubles(fs.assemble(long, top, "vec_id", ["label"]))


_WIDE_ROWS = """s AS (SELECT w.vec_id, w.label, 'f_' || w.feature AS f, round(w.value, 6) AS value
  FROM wide w JOIN top t ON t.feature = w.feature)"""


@query("F5_assemble_wide", f"{_TOPK_SQL}, {_WIDE_ROWS} PIVOT s ON f USING first(value) GROUP BY vec_id, label")
def f5w(spark, sf):
    long, top = _selected(spark, sf)
    return round_doubles(fs.assemble_wide(long, top, "vec_id", ["label"]))


_LONG_SQL = f"""{_TOPK_SQL}
SELECT w.vec_id, w.label, w.feature, {r('w.value', 'value')} FROM wide w JOIN top t ON t.feature = w.feature"""


@query("F5_wide_unpivoted", _LONG_SQL)
def f5_unpivoted(spark, sf):
    """The wide table, taken apart again, is the long one."""
    long, top = _selected(spark, sf)
    wide = fs.assemble_wide(long, top, "vec_id", ["label"])
    cells = F.array(*[F.struct(F.lit(int(c[2:])).alias("feature"), F.col(f"`{c}`").alias("value"))
                      for c in wide.columns if c.startswith("f_")])
    return round_doubles(wide.select("vec_id", "label", F.inline(cells)))


@query("F5_feature_vectors", _LONG_SQL)
def f5_vectors(spark, sf):
    """Vectors of all features in long form, cut down to the selected ones by their numbers."""
    long, top = _selected(spark, sf)
    vectors, numbers = fs.feature_vectors(long, long.select("feature"), "vec_id", ["label"])
    cells = vectors.select("vec_id", "label", F.posexplode(vector_to_array("features")).alias("index", "value"))
    return round_doubles(cells.join(numbers, "index").join(top.select("feature"), "feature").select(
        "vec_id", "label", "feature", "value"))


TABLES = {"survival_table": 5, "ml_table": 10}


def _read_back_sql() -> str:
    parts = [f"""SELECT '{name}' AS name, count(*) AS n_rows, {k + 3} AS n_columns, {r('avg(n_orders)', 'mean_orders')}
FROM churn JOIN (SELECT DISTINCT vec_id FROM wide) v ON v.vec_id = churn.subject_id""" for name, k in TABLES.items()]
    return f"WITH {CHURN}, {WIDE} " + " UNION ALL ".join(parts)


@query("F5_model_tables", _read_back_sql())
def f5_tables(spark, sf):
    """Clinical columns, the top features and the event, joined on the subject and
    exported as two tables, read back."""
    long = cohorts.wide_long(spark, sf)
    kept = fs.feature_variance(long, THRESHOLD_STRICT).where("keep").select("feature")
    corr = fs.target_correlation(long.join(kept, "feature", "left_semi"), "label")
    best = [row["feature"] for row in fs.top_k(corr, max(TABLES.values())).collect()]
    clinical = cohorts.churn(spark, sf).select("subject_id", "n_orders", "event")
    folder = f"{ensure_checkpoint_dir(spark)}/exports/{uuid.uuid4().hex}"
    tables = {}
    for name, k in TABLES.items():
        chosen = spark.createDataFrame([(f,) for f in best[:k]], "feature int")
        wide = fs.assemble_wide(long, chosen, "vec_id").withColumnRenamed("vec_id", "subject_id")
        tables[name] = fs.model_table(clinical, wide, "subject_id", ["event"])
    out = None
    for name, path in export_many(tables, folder).items():
        back = spark.read.parquet(path)
        row = back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"),
                       F.lit(len(back.columns)).alias("n_columns"), F.avg("n_orders").alias("mean_orders"))
        out = row if out is None else out.unionByName(row)
    return round_doubles(out)
