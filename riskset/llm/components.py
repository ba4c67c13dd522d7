"""Connected components of links by alternating stars, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import stored

MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on each node's smallest neighbour (or on itself)."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of long nodes -> (node, label), the smallest node of its component.

    Nodes without a link are not listed. Every round writes its edges to the
    shared folder; only a pair of sums comes to the driver to see the end.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        edges = stored(_star(_star(edges, large=True), large=False), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state
    raise RuntimeError("components did not settle")
