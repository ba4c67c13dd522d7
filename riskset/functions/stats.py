"""Distribution tails as Spark column expressions, plus SQL twins.

Neither Spark nor DuckDB ships ``erf``/``erfc``, so the chi-square and normal
tails are written as plain arithmetic. Each function exists twice: a Spark
``Column`` builder and a SQL text builder that emits the same formula, so the
DuckDB oracle evaluates exactly the same arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95% normal quantile, and the Chebyshev fit of
# erfc(z) = t * exp(-z^2 + P(t)), t = 1 / (1 + z/2), from Press et al.,
# "Numerical Recipes" (fractional error below 1.2e-7 everywhere).
Z95 = 1.959963984540054
ERFC_COEFFS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def _horner_col(t: Column) -> Column:
    acc = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        acc = F.lit(c) + t * acc
    return acc


def _horner_sql(t: str) -> str:
    acc = repr(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        acc = f"({c!r} + {t} * {acc})"
    return acc


def erfc_col(z: Column) -> Column:
    """Complementary error function of a double column."""
    az = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * az)
    ans = t * F.exp(-az * az + _horner_col(t))
    return F.when(z >= 0, ans).otherwise(F.lit(2.0) - ans)


def erfc_sql(z: str) -> str:
    az = f"abs({z})"
    t = f"(1.0 / (1.0 + 0.5 * {az}))"
    ans = f"({t} * exp(-({az}) * ({az}) + {_horner_sql(t)}))"
    return f"(CASE WHEN ({z}) >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def norm_sf2_col(z: Column) -> Column:
    """Two-sided normal p-value P(|Z| > |z|)."""
    return erfc_col(F.abs(z) / F.lit(math.sqrt(2.0)))


def norm_sf2_sql(z: str) -> str:
    return erfc_sql(f"(abs({z}) / {math.sqrt(2.0)!r})")


def _upto(n: Column) -> Column:
    """[1, 2, ..., n], empty when n < 1 (``sequence(1, 0)`` would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def chi2_sf_col(x: Column, df: int | Column) -> Column:
    """Upper tail of the chi-square distribution with ``df`` degrees of freedom.

    Even df: exp(-x/2) * sum_{i<df/2} (x/2)^i / i!.
    Odd df: erfc(sqrt(x/2)) + sqrt(2x/pi) exp(-x/2) sum_{i=1}^{(df-1)/2} x^(i-1) / (1*3*...*(2i-1)).
    A literal ``df`` unrolls the series; a column ``df`` uses an array fold.
    """
    x = x.cast("double")
    if isinstance(df, int):
        return _chi2_sf_fixed_col(x, df)
    half = F.exp(-x / 2.0)
    even = half * F.aggregate(
        _upto((df / 2 - 1).cast("int")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * x / 2.0 / i).alias("t"),
                                (acc["s"] + acc["t"] * x / 2.0 / i).alias("s")),
        lambda acc: acc["s"])
    odd_series = F.aggregate(
        _upto(((df - 1) / 2).cast("int")),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * x / (2 * i + 1)).alias("t"),
                                (acc["s"] + acc["t"]).alias("s")),
        lambda acc: acc["s"])
    odd = erfc_col(F.sqrt(x / 2.0)) + F.sqrt(2.0 * x / math.pi) * half * odd_series
    res = F.when(df % 2 == 0, even).otherwise(odd)
    return F.when(x.isNull() | df.isNull() | (df < 1), F.lit(None).cast("double")) \
        .when(x <= 0, F.lit(1.0)).otherwise(res)


def _chi2_sf_fixed_col(x: Column, df: int) -> Column:
    if df < 1:
        raise ValueError("degrees of freedom must be >= 1")
    half = F.exp(-x / 2.0)
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * x / 2.0 / i
            total = total + term
        res = half * total
    else:
        term, total = F.lit(1.0), F.lit(0.0)
        for i in range(1, (df - 1) // 2 + 1):
            total = total + term
            term = term * x / (2 * i + 1)
        res = erfc_col(F.sqrt(x / 2.0)) + F.sqrt(2.0 * x / math.pi) * half * total
    return F.when(x <= 0, F.lit(1.0)).otherwise(res)


def chi2_sf_sql(x: str, df: int) -> str:
    """SQL twin of :func:`chi2_sf_col` for a literal ``df``."""
    if df < 1:
        raise ValueError("degrees of freedom must be >= 1")
    half = f"exp(-({x}) / 2.0)"
    if df % 2 == 0:
        terms, term = ["1.0"], "1.0"
        for i in range(1, df // 2):
            term = f"({term} * ({x}) / 2.0 / {i})"
            terms.append(term)
        res = f"({half} * ({' + '.join(terms)}))"
    else:
        terms, term = [], "1.0"
        for i in range(1, (df - 1) // 2 + 1):
            terms.append(term)
            term = f"({term} * ({x}) / {2 * i + 1})"
        series = " + ".join(terms) if terms else "0.0"
        res = f"({erfc_sql(f'sqrt(({x}) / 2.0)')} + sqrt(2.0 * ({x}) / {math.pi!r}) * {half} * ({series}))"
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE {res} END)"


def chi2_sf_sql_var(x: str, df: str, max_df: int) -> str:
    """SQL twin for a per-row ``df`` known to lie in 1..max_df."""
    arms = " ".join(f"WHEN ({df}) = {k} THEN {chi2_sf_sql(x, k)}" for k in range(1, max_df + 1))
    return f"(CASE {arms} END)"


def chi2_sf(x: float, df: int) -> float:
    """Driver-side scalar twin (bounded results only, e.g. a p x p test)."""
    if x <= 0:
        return 1.0
    half = math.exp(-x / 2.0)
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= x / 2.0 / i
            total += term
        return half * total
    total, term = 0.0, 1.0
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return _erfc(math.sqrt(x / 2.0)) + math.sqrt(2.0 * x / math.pi) * half * total


def _erfc(z: float) -> float:
    az = abs(z)
    t = 1.0 / (1.0 + 0.5 * az)
    acc = ERFC_COEFFS[-1]
    for c in reversed(ERFC_COEFFS[:-1]):
        acc = c + t * acc
    ans = t * math.exp(-az * az + acc)
    return ans if z >= 0 else 2.0 - ans


def norm_sf2(z: float) -> float:
    return _erfc(abs(z) / math.sqrt(2.0))


def round_half_up_col(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in binary floating point.

    Spark's ``round`` rounds the exact decimal expansion of the double, DuckDB
    rounds ``x * 10^d``; at exact decimal ties (a mean of two prices) they can
    differ in the last digit. This explicit formula is evaluated identically
    by any IEEE-754 engine.
    """
    scale = float(10 ** digits)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def round_half_up_sql(x: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(floor(CAST({x} AS DOUBLE) * {scale!r} + 0.5) / {scale!r})"
