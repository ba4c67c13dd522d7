"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Every query result is fully evaluated with a no-op write (no driver collect),
after one untimed warm-up query so JVM start-up is not billed to the first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskset.plans import registry  # noqa: E402
from riskset.session import get_session  # noqa: E402

HEADLINE = [
    "K2_km_by_segment",        # stratified KM + band, churn cohort
    "K3_km_band_item",         # KM + band over every line item (scale cohort)
    "K6_logrank_item",         # two-sample log-rank over every line item
    "K8_logrank_all_strata",   # k-sample log-rank, three variables in one job
    "K9_curve_crossings_item", # curve crossing on the line-item curves
    "C1_cox_univariate",       # batched univariate Cox (Efron), Newton jobs
    "C4_concordance",          # concordance without self-join
    "A3_describe",             # exact quartiles over lineitem numeric columns
    "A13_correlation_matrix",  # pairwise correlations
    "E9_column_plan",          # fit + transform of the full column plan
    "F2_target_correlation",   # feature ranking over the exploded embeddings
    "M1_stratified_split",     # exact stratified split
    "M7_roc_auc",              # exact AUC
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, app_name="riskset-bench")
    registry.load_all()
    names = [n for n in HEADLINE if n in registry.QUERIES]
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [n for n in names if re.search(only, n)]

    # Untimed warm-up on the smallest fixture: JIT-compiles the planner and
    # operator code paths so that the first timed query is not billed for it.
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("K2_km_by_segment", "C4_concordance", "A3_describe"):
        registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
