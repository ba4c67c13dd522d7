"""Shared SQL text for the oracle side: cohort CTEs and rounding."""

from __future__ import annotations

# X_CHURN as SQL, written independently of the Spark builder.
CHURN = """churn AS (
  SELECT c.c_custkey AS subject_id,
         CAST(date_diff('day', o.first_order, o.last_order) AS DOUBLE) AS duration,
         CASE WHEN o.last_order < TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END AS event,
         c.c_mktsegment AS segment,
         CASE WHEN c.c_acctbal >= 5000 THEN 'high' ELSE 'low' END AS acct_band,
         CASE WHEN o.n_orders <= 8 THEN 'le8' WHEN o.n_orders <= 11 THEN '9to11' ELSE 'gt11' END AS order_band,
         CAST(o.n_orders AS BIGINT) AS n_orders,
         c.c_acctbal AS acctbal,
         o.mean_price
  FROM customer c
  JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price,
               min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
        FROM orders GROUP BY o_custkey) o
    ON c.c_custkey = o.o_custkey)"""

ITEM = """item AS (
  SELECT l_orderkey, l_linenumber,
         CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS DOUBLE) AS duration,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event,
         l_linestatus AS linestatus, l_quantity, l_discount, l_extendedprice
  FROM lineitem)"""

MISS = """miss AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

WIDE = """wide AS (
  SELECT vec_id, CAST(u.i AS INTEGER) AS feature, CAST(embedding[u.i] AS DOUBLE) AS value, label
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) u)"""


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {alias}"


def km_sql(source: str, keys: list[str], digits: int = 6) -> str:
    """KM table SQL over a CTE named ``source`` with (keys, duration, event)."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    kc = "".join(f"{k}, " for k in keys)
    notnull = " AND ".join([f"{k} IS NOT NULL" for k in keys] + ["duration IS NOT NULL", "event IS NOT NULL"])
    z = 1.959963984540054
    return f"""per_t AS (
  SELECT {kc}duration AS t, CAST(sum(event) AS BIGINT) AS n_event, count(*) AS m
  FROM {source} WHERE {notnull} GROUP BY {kc}duration),
risk AS (
  SELECT *, CAST(sum(m) OVER ({part}ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_at_risk
  FROM per_t),
terms AS (
  SELECT *,
    CASE WHEN n_event < n_at_risk THEN ln(1.0 - CAST(n_event AS DOUBLE) / n_at_risk) ELSE 0.0 END AS lg,
    CASE WHEN n_event < n_at_risk THEN CAST(n_event AS DOUBLE) / (CAST(n_at_risk AS DOUBLE) * (n_at_risk - n_event)) ELSE 0.0 END AS gw,
    CASE WHEN n_event < n_at_risk THEN 0 ELSE 1 END AS zf
  FROM risk),
acc AS (
  SELECT *, sum(lg) OVER w AS cl, sum(gw) OVER w AS cg, sum(zf) OVER w AS cz
  FROM terms WINDOW w AS ({part}ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
km AS (
  SELECT {kc}t, n_at_risk, n_event, CAST(m - n_event AS BIGINT) AS n_censor,
    CASE WHEN cz > 0 THEN 0.0 ELSE exp(cl) END AS survival,
    CASE WHEN cz = 0 AND cl < 0 THEN exp(-exp(ln(-cl) - {z} * sqrt(cg) / cl)) END AS ci_low,
    CASE WHEN cz = 0 AND cl < 0 THEN exp(-exp(ln(-cl) + {z} * sqrt(cg) / cl)) END AS ci_high
  FROM acc)"""


def quadform_sql(z: list[str], v: dict[tuple[int, int], str], src: str, name: str) -> tuple[list[str], str]:
    """CTEs computing z' V^-1 z by an unrolled Cholesky factorisation.

    ``z`` are column names of the score vector, ``v[(i, j)]`` (i <= j) column
    names of the symmetric matrix, ``src`` the CTE holding them. Returns the
    CTE list and the name of the column holding the statistic.
    """
    k = len(z)
    ctes, prev = [], src

    def add(cols: list[str]):
        nonlocal prev
        cname = f"{name}_c{len(ctes)}"
        ctes.append(f"{cname} AS (SELECT *, {', '.join(cols)} FROM {prev})")
        prev = cname

    def vv(i, j):
        return v[(min(i, j), max(i, j))]

    for j in range(k):
        diag = " - ".join([vv(j, j)] + [f"{name}_l{j}_{m} * {name}_l{j}_{m}" for m in range(j)])
        add([f"sqrt({diag}) AS {name}_l{j}_{j}"])
        below = []
        for i in range(j + 1, k):
            num = " - ".join([vv(i, j)] + [f"{name}_l{i}_{m} * {name}_l{j}_{m}" for m in range(j)])
            below.append(f"({num}) / {name}_l{j}_{j} AS {name}_l{i}_{j}")
        if below:
            add(below)
    for i in range(k):
        num = " - ".join([z[i]] + [f"{name}_l{i}_{m} * {name}_y{m}" for m in range(i)])
        add([f"({num}) / {name}_l{i}_{i} AS {name}_y{i}"])
    stat = " + ".join(f"{name}_y{i} * {name}_y{i}" for i in range(k))
    add([f"{stat} AS {name}_stat"])
    return ctes, prev


def logrank_sql(source: str, group_expr: str, levels: list[str], name: str,
                ignore_censoring: bool = False) -> tuple[list[str], str, str]:
    """CTEs for a k-sample log-rank test over ``source`` with known levels.

    Returns (ctes, final cte name, statistic column).
    """
    e = "1" if ignore_censoring else "event"
    k = len(levels)
    sums_d = ", ".join(f"sum(CASE WHEN g = '{lv}' THEN e ELSE 0 END) AS d{j}" for j, lv in enumerate(levels))
    sums_m = ", ".join(f"sum(CASE WHEN g = '{lv}' THEN 1 ELSE 0 END) AS m{j}" for j, lv in enumerate(levels))
    win = "ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    runs = ", ".join(f"CAST(sum(m{j}) OVER ({win}) AS DOUBLE) AS n{j}" for j in range(k))
    use = range(k - 1)
    wexpr = "CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0.0 END"
    sums = [f"sum(d{j}) AS o{j}, sum(d * n{j} / n) AS e{j}" for j in use]
    cov = [f"sum({wexpr} * (n{i} / n) * ({1.0 if i == j else 0.0} - n{j} / n)) AS v{i}_{j}"
           for i in use for j in use if i <= j]
    ctes = [
        f"{name}_g AS (SELECT duration AS t, {e} AS e, {group_expr} AS g FROM {source} "
        f"WHERE duration IS NOT NULL AND event IS NOT NULL AND ({group_expr}) IS NOT NULL)",
        f"{name}_t AS (SELECT t, CAST(sum(e) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS m, {sums_d}, {sums_m} "
        f"FROM {name}_g GROUP BY t)",
        f"{name}_r AS (SELECT *, CAST(sum(m) OVER ({win}) AS DOUBLE) AS n, {runs} FROM {name}_t)",
        f"{name}_s AS (SELECT {', '.join(sums + cov)} FROM {name}_r)",
        f"{name}_z AS (SELECT *, {', '.join(f'o{j} - e{j} AS z{j}' for j in use)} FROM {name}_s)",
    ]
    qctes, last = quadform_sql([f"z{j}" for j in use], {(i, j): f"v{i}_{j}" for i in use for j in use if i <= j},
                               f"{name}_z", name)
    return ctes + qctes, last, f"{name}_stat"
