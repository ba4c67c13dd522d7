"""One stored pipeline from a raw profile to its probability.

Each preparation step is a stage with a fit of its own: fitted on training rows,
it holds a small parameter table (``prepare.Params``) and applies it in a narrow
projection. Stages, feature assembler and learner form one ``PipelineModel``,
which is saved and loaded as a whole, so a scoring job needs no training data.

Defined cases: a profile's missing or absent number is the training mean (after
log1p), a missing or absent category the training mode; a category that the
training rows lack has no one-hot column set, one outside an ordinal list is an
error; an empty table of profiles is scored to an empty table; columns beyond
those of the plan pass through unread.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params as MLParams, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.operators import prepare as pp
from riskset.operators.classify import fit_forest


class _Columns(MLParams):
    """Shared parameter: the columns a stage works on."""
    columns = Param(MLParams._dummy(), "columns", "columns of the stage", TypeConverters.toListString)

    def names(self) -> list[str]:
        return list(self.getOrDefault(self.columns))


class _Fitted(_Columns):
    """Shared parameter: the fitted rows of ``prepare.Params`` as JSON (doubles round-trip)."""
    fitted = Param(MLParams._dummy(), "fitted", "fitted parameters", TypeConverters.toString)

    def params_(self) -> pp.Params:
        return pp.Params([tuple(r) for r in json.loads(self.getOrDefault(self.fitted))])

    def hold(self, columns: Sequence[str], params: pp.Params):
        return self._set(columns=list(columns), fitted=json.dumps(params.rows))


class _Step(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))


class _StepModel(_Fitted, Model, DefaultParamsReadable, DefaultParamsWritable):
    pass


class Complete(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds columns that a profile table lacks, as nulls of the training type."""
    types = Param(MLParams._dummy(), "types", "column=type of the training rows", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, types: Sequence[str] = ()):
        super().__init__()
        self._set(types=list(types))

    def _transform(self, df: DataFrame) -> DataFrame:
        wanted = [t.rsplit("=", 1) for t in self.getOrDefault(self.types)]
        return df.select(*[F.col(f"`{c}`") for c in df.columns],
                         *[F.lit(None).cast(t).alias(c) for c, t in wanted if c not in df.columns])


class Log1p(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """E1 as a stage."""
    @keyword_only
    def __init__(self, *, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))

    def _transform(self, df: DataFrame) -> DataFrame:
        return pp.log1p_columns(df, self.names())


class FillMean(_Step):
    """Unspecified numbers become the training mean."""
    def _fit(self, df: DataFrame) -> "FillMeanModel":
        params = pp.fit_scaler(df, self.names(), ddof=1)
        return FillMeanModel().hold(self.names(), pp.Params([r for r in params.rows if r[2] == "mean"]))


class FillMeanModel(_StepModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return pp.fill_with_means(df, self.params_(), self.names())


class FillMode(_Step):
    """Unspecified categories become the training mode."""
    def _fit(self, df: DataFrame) -> "FillModeModel":
        return FillModeModel().hold(self.names(), pp.fit_mode(df, self.names()))


class FillModeModel(_StepModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return pp.impute(df, self.params_())


class ZScore(_Step):
    """The stored mean and sample deviation of the training rows."""
    def _fit(self, df: DataFrame) -> "ZScoreModel":
        return ZScoreModel().hold(self.names(), pp.fit_scaler(df, self.names(), ddof=1))


class ZScoreModel(_StepModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return pp.scale(df, self.params_())


class Ordinal(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """E6 as a stage: positions in fixed orders."""
    orders = Param(MLParams._dummy(), "orders", "column -> ordered categories, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, orders: Mapping[str, Sequence[str]] | None = None):
        super().__init__()
        self._set(orders=json.dumps({c: list(v) for c, v in (orders or {}).items()}))

    def _transform(self, df: DataFrame) -> DataFrame:
        orders = json.loads(self.getOrDefault(self.orders))
        return df.select(*[pp.ordinal_encode(c, orders[c]) if c in orders else F.col(f"`{c}`") for c in df.columns])


class OneHot(_Step):
    """A 0/1 column per training level; ``binary`` drops the first of two."""
    binary = Param(MLParams._dummy(), "binary", "drop the first of two levels", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, columns: Sequence[str] = (), binary: bool = False):
        super().__init__(columns=columns)
        self._set(binary=binary)

    def _fit(self, df: DataFrame) -> "OneHotModel":
        model = OneHotModel().hold(self.names(), pp.fit_levels(df, self.names()))
        return model._set(binary=self.getOrDefault(self.binary))


class OneHotModel(_StepModel):
    binary = Param(MLParams._dummy(), "binary", "drop the first of two levels", TypeConverters.toBoolean)

    def _transform(self, df: DataFrame) -> DataFrame:
        return pp.one_hot(df, self.params_(), self.names(), "if_binary" if self.getOrDefault(self.binary) else None)

    def added(self) -> list[str]:
        drop = self.getOrDefault(self.binary)
        out = []
        for c in self.names():
            levels = self.params_().levels(c, "onehot")
            out += [f"{c}_{v}" for v in (levels[1:] if drop and len(levels) == 2 else levels)]
        return out


@dataclass
class ProfilePlan:
    """Which raw column takes which way; ``log1p`` names some of ``numeric``."""
    numeric: Sequence[str]
    log1p: Sequence[str] = ()
    ordinal: Mapping[str, Sequence[str]] = field(default_factory=dict)
    onehot_if_binary: Sequence[str] = ()
    onehot_all: Sequence[str] = ()

    def raw(self) -> list[str]:
        return [*self.numeric, *self.ordinal, *self.onehot_if_binary, *self.onehot_all]


def fit_preparation(train: DataFrame, plan: ProfilePlan) -> PipelineModel:
    """The fitted preparation stages; every stage sees the rows as the one before leaves them."""
    types = dict(train.dtypes)
    categories = [*plan.ordinal, *plan.onehot_if_binary, *plan.onehot_all]
    steps = [Complete(types=[f"{c}={types[c]}" for c in plan.raw()])]
    steps += [Log1p(columns=plan.log1p)] if plan.log1p else []
    steps += [FillMean(columns=plan.numeric)] if plan.numeric else []
    steps += [FillMode(columns=categories)] if categories else []
    steps += [ZScore(columns=plan.numeric)] if plan.numeric else []
    steps += [Ordinal(orders=plan.ordinal)] if plan.ordinal else []
    steps += [OneHot(columns=plan.onehot_if_binary, binary=True)] if plan.onehot_if_binary else []
    steps += [OneHot(columns=plan.onehot_all)] if plan.onehot_all else []
    fitted, df = [], train.select(*[F.col(f"`{c}`") for c in plan.raw()])
    for step in steps:
        fitted.append(step.fit(df) if isinstance(step, Estimator) else step)
        df = fitted[-1].transform(df)
    return PipelineModel(fitted)


def feature_columns(preparation: PipelineModel, plan: ProfilePlan) -> list[str]:
    """Feature order of the assembler."""
    added = [c for s in preparation.stages if isinstance(s, OneHotModel) for c in s.added()]
    return [*plan.numeric, *plan.ordinal, *added]


def fit_profile_model(train: DataFrame, plan: ProfilePlan, label: str, weight: str | None = None,
                      trees: int = 200, depth: int = 30, seed: int = 42) -> PipelineModel:
    """Raw training rows to one model of preparation, assembler and forest."""
    preparation = fit_preparation(train, plan)
    assembler = VectorAssembler(inputCols=feature_columns(preparation, plan), outputCol="features")
    rows = assembler.transform(preparation.transform(train))
    return PipelineModel([*preparation.stages, assembler, fit_forest(rows, label, weight, trees, depth, 32, seed)])
