"""Helpers shared by the operators of this folder.

Lineage is cut with tables written to the folder in ``spark.checkpoint.dir``
(:func:`stored`): they survive lost executors and, unlike a checkpoint, are
columnar, so later readers take only the columns they need.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskset.session import ensure_checkpoint_dir

# The six ASCII blanks: words are the maximal runs of other characters.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]+"

# A side table is broadcast only if it was counted to be at most this large.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24 << 20
# Copies of a side table that is too large to broadcast, against hot keys.
SALTS = 16


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the whole cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column, separators: str = BLANK_RE) -> Column:
    """The non-empty pieces between separators; null text has none."""
    pieces = F.split(F.coalesce(text.cast("string"), F.lit("")), separators, -1)
    return F.array_remove(pieces, "")


def row_bytes(df: DataFrame) -> Column:
    """Approximate width of a row: lengths of strings and arrays, 8 a scalar."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = F.octet_length(c) + 16
        elif isinstance(f.dataType, T.ArrayType):
            width = F.size(c) * (32 if isinstance(f.dataType.elementType, (T.StringType, T.StructType)) else 8) + 16
        else:
            width = F.lit(8)
        total = total + F.coalesce(width.cast("long"), F.lit(8).cast("long"))
    return total


def is_small(df: DataFrame) -> bool:
    """Count ``df`` (already stored) against the broadcast bound."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def join_side(left: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with a stored side table that has one row per key.

    A side within the counted bound is broadcast. Beyond it, left rows get one
    of ``SALTS`` salts and the side is repeated per salt, so that a key with a
    third of all left rows is spread over as many tasks.
    """
    if is_small(side):
        return left.join(F.broadcast(side), keys, how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = left.withColumn("_salt", (F.rand(7) * SALTS).cast("int"))
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")


def key_text(col: Column) -> Column:
    """A non-null text for a nullable key, so that null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


# Documents without an id are one group; inside an operator they carry this id.
NO_ID = -(1 << 63)


def key_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID).cast("long")).alias(name)


def plain_id(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != F.lit(NO_ID).cast("long"), F.col(name)).alias(name)


def later_copies(texts: DataFrame) -> DataFrame:
    """(doc_id, _th, text) -> stored (doc_id, _th) of texts that a smaller doc_id has as a whole.

    Only digests are shuffled; a group of copies is one row of the aggregate.
    """
    own = texts.select("doc_id", "_th", F.md5(F.coalesce("text", F.lit(""))).alias("_md5"))
    first = own.groupBy("_md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = stored(first.where("first < last").select("_md5", "first"), "copies")
    side = F.broadcast(copies) if is_small(copies) else copies
    return stored(own.join(side, "_md5").where("doc_id > first").select("doc_id", "_th").distinct(), "later")
