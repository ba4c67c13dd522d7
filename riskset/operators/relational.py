"""Projections, filters, predicates, joins and unions.

Thin, named compositions of DataFrame operators so that cohort code reads
like the study it reproduces; every one is a narrow transformation except
the join (J1) and the ordered preview (P1, a TakeOrderedAndProject).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def preview(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit order (Spark rows have no position)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def recode_event(df: DataFrame, status: str, out: str = "event") -> DataFrame:
    """event = 1 - status (alive=1 coding -> event=1 coding)."""
    return df.withColumn(out, (F.lit(1) - _c(status).cast("int")).cast("int"))


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop listed columns; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: select and reorder (names are back-quoted: special characters are fine)."""
    return df.select(*[_c(c) for c in cols])


def filter_project(df: DataFrame, predicate: Column, cols: Sequence[str]) -> DataFrame:
    """Rows matching a predicate, projected (pushed to the scan by Catalyst)."""
    return df.where(predicate).select(*[_c(c) for c in cols])


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``subset``."""
    return df.dropna(subset=list(subset))


def landmark_eligible(df: DataFrame, landmark: float, duration: str = "duration", event: str = "event") -> DataFrame:
    """Drop subjects censored before the landmark."""
    return df.where(~((_c(duration) < landmark) & (_c(event) == 0)))


def landmark_label(landmark: float, mode: str = "as_documented", duration: str = "duration",
                   event: str = "event") -> Column:
    """1 = still event-free at the landmark.

    ``as_documented``: duration >= landmark (a later event still counts as
    having reached the landmark). ``as_coded``: additionally event == 0, so
    late events get 0 (SURVEY D3).
    """
    reached = _c(duration) >= landmark
    if mode == "as_coded":
        reached = reached & (_c(event) == 0)
    elif mode != "as_documented":
        raise ValueError(mode)
    return reached.cast("int")


def value_map(col: str | Column, mapping: Mapping, default=None) -> Column:
    """Map values through a literal table (e.g. {0: 'Death', 1: 'Alive'})."""
    c = _c(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = m[c]
    return F.coalesce(out, F.lit(default)) if default is not None else out


def significance(df: DataFrame, p_col: str = "p_value", alpha: float = 0.05, only: bool = False) -> DataFrame:
    """Add ``significant = p < alpha``; optionally keep only those rows."""
    out = df.withColumn("significant", _c(p_col) < alpha)
    return out.where("significant") if only else out


def outside(col: str, lo: float, hi: float) -> Column:
    """Value outside [lo, hi] (null stays null)."""
    return (_c(col) < lo) | (_c(col) > hi)


def negative(col: str) -> Column:
    return _c(col) < 0


def above(col: str, limit: float) -> Column:
    return _c(col) > limit


def attach_labels(prepared: DataFrame, raw: DataFrame, key: str, labels: Sequence[str],
                  suffix: str = "_label") -> DataFrame:
    """Attach original (pre-encoding) label columns by the subject key.

    An equi-join on the key replaces the reference's positional alignment
    (SURVEY D6). Spark picks broadcast when the label side is small.
    """
    right = raw.select(_c(key), *[_c(c).alias(c + suffix) for c in labels])
    return prepared.join(right, key, "inner")


def stack(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
