"""Scans and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL in every floating column once, at read.

    pandas has one missing concept; Spark counts NaN in ``count`` and lets
    it poison ``avg``, so the distinction is removed at the boundary.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | str | None = None, infer: bool = True) -> DataFrame:
    """Read a delimited file with a header, or Parquet, with NaN -> NULL.

    CSV uses the given schema, or whole-file inference when none is given
    (discovery only; production reads should pass a schema).
    """
    fmt = fmt or ("csv" if path.lower().endswith((".csv", ".csv.gz", ".tsv")) else "parquet")
    if fmt == "csv":
        reader = spark.read.option("header", True)
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", infer).option("samplingRatio", 1.0)
        df = reader.csv(path)
    else:
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.format(fmt).load(path)
    return nan_to_null(df)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's fixture tables: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
           mode: str = "overwrite") -> None:
    """Write a result table without any index column (S3).

    Parquet by default; CSV gets a header. Output is written by the executors
    in parallel (one file per task), never through the driver.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def export_many(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Export several tables (``df_survival``, ``df_ml`` ...) to one folder."""
    paths = {}
    for name, df in tables.items():
        paths[name] = os.path.join(folder, name)
        export(df, paths[name], fmt)
    return paths
