"""Mixing sources to target weights by systematic sampling.

Each source's documents have the same expected number of copies, its target
over its size. The expected copies are prefix-summed over the source's
documents, one random offset is added, and a document is emitted once per
integer boundary that its stretch crosses. Documents are laid out by size
class, so every size contributes its share and a source's taken words differ
from its target by about one document.

A source may hold a third of all rows, so its prefix sum is not one window:
documents fall into buckets (size class, first digit pair of a hash), bucket
counts are summed per source, and rows are numbered inside their bucket.
Expected copies are integers in units of 2**-20, so the sums are exact.

Defined cases: null text has size 0; a null source is a source of its own,
after all others; rows with the same doc_id are separate documents; equal rows
are interchangeable; sources without words get target 0 and no copies; an
empty table gives an empty mix. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskset.llm.common import is_small, join_side, key_text, stored, words

WEIGHTS = (3, 1, 2)          # by rank of the source, repeating
BUDGET = (3, 2)              # 150 % of all sizes
CAP = 2                      # a target stops at so many times its source's size
UNIT = 1 << 20
SEED = "mix"


def _ranked(sources: DataFrame) -> DataFrame:
    """Rank sources by code point, null last, over ranges: no single-task window."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if is_small(sources):
        n = 1
    ranged = stored(sources.repartitionByRange(n, "_null", "_name")
                    .withColumn("_range", F.spark_partition_id()), "sources")
    here = Window.partitionBy("_range").orderBy("_null", "_name")
    # One row per range: as many as shuffle partitions.
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").select(
        "_src", "source_size", (F.row_number().over(here) - 1 + F.col("_before")).alias("_rank"))


def targets(sizes: DataFrame) -> DataFrame:
    """(_src, source) sizes -> stored (_src, source_size, target, _rate).

    Water filling: what capped sources cannot take is shared again by weight
    until no target is above its cap. Each round is one aggregate over the
    sources; the level is an exact ratio of two integers on the driver.
    """
    sources = sizes.groupBy("_src", "_name", "_null").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = stored(_ranked(sources).withColumn("_weight", weight.cast("long")), "ranked")
    cap = F.col("source_size") * CAP
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * BUDGET[0]    # over BUDGET[1]
    num, den, capped_before = 0, 1, -1
    capped = F.lit(False)
    while True:
        r = ranked.agg(F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(~capped, F.col("_weight"))),
                       F.count(F.when(capped, 1))).first()
        full, free, n_capped = r[0] or 0, r[1] or 0, r[2]
        if n_capped == capped_before or not free:
            break
        capped_before = n_capped
        num, den = total - BUDGET[1] * full, BUDGET[1] * free            # words per unit of weight
        capped = cap.cast("decimal(19,0)") * F.lit(den).cast("decimal(19,0)") \
            < F.col("_weight").cast("decimal(19,0)") * F.lit(num).cast("decimal(19,0)")
        capped = F.coalesce(capped, F.lit(False))
    target = F.when(capped, cap.cast("double")).otherwise(
        (F.col("_weight") * F.lit(num)).cast("double") / F.lit(float(den)))
    rate = F.when(F.col("source_size") > 0, F.least(
        F.lit(CAP * UNIT).cast("long"),
        F.round(F.col("target") * F.lit(float(UNIT)) / F.col("source_size")).cast("long"))).otherwise(F.lit(0))
    return stored(ranked.withColumn("target", target).select(
        "_src", "source_size", "target", rate.cast("long").alias("_rate")), "targets")


def _numbered(rows: DataFrame, keep: bool) -> DataFrame:
    """Add ``_k``: the number of the row in its source, from 0, in the order (class, hash, doc_id, size).

    ``keep`` stores the rows, which are read twice; rows that carry texts are
    computed twice instead.
    """
    bits = F.bin(F.col("size"))
    lead = F.conv(F.rpad(F.substring(bits, 1, 4), 4, "0"), 2, 10).cast("int")
    h = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.select("*", (F.length(bits) * 16 + lead).alias("_class"), h.alias("_h"),
                       F.substring(h, 1, 2).alias("_slot"))
    if keep:
        rows = stored(rows, "sized")
    buckets = rows.groupBy("_src", "_class", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    # At most a few ten thousand buckets a source, whatever its rows.
    order = Window.partitionBy("_src").orderBy(F.desc("_class"), "_slot")
    offsets = stored(buckets.select("_src", "_class", "_slot", (F.sum("_c").over(order) - F.col("_c")).alias("_off")),
                     "offsets")
    inside = Window.partitionBy("_src", "_class", "_slot").orderBy("_h", "doc_id", "size")
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1)
    if is_small(offsets):
        offsets = F.broadcast(offsets)
    return numbered.join(offsets, ["_src", "_class", "_slot"]).withColumn("_k", F.col("_off") + F.col("_i"))


def _sized() -> dict[str, Column]:
    name = F.col("source").cast("string")
    return {"size": F.size(words(F.col("text"))).cast("long"), "_src": key_text(F.col("source")),
            "_name": F.coalesce(name, F.lit("")), "_null": name.isNull().cast("int")}


def _copies() -> Column:
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), F.col("_src"))), 1, 5), 16, 10).cast("long")
    upto = F.shiftright(F.col("_rate") * (F.col("_k") + 1) + offset, 20)      # floor of a division by UNIT
    return (upto - F.shiftright(F.col("_rate") * F.col("_k") + offset, 20)).cast("long")


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row per document."""
    rows = docs.select("doc_id", *[c.alias(n) for n, c in _sized().items()])
    numbered = _numbered(rows, keep=True)
    out = join_side(numbered, targets(rows), ["_src"]).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                      "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns as they were, a row per copy."""
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id"),
                       *[c.alias(n) for n, c in _sized().items()])
    numbered = _numbered(rows, keep=False)
    out = join_side(numbered, targets(rows), ["_src"]).withColumn("_copies", _copies()).where(F.col("_copies") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")) \
        .select("_row.*")
