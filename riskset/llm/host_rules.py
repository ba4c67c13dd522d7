"""Quality rules per host: shrunk failure rates decide whole hosts.

Every document is measured with DataFrame functions only. A document fails if
it is short or repeats itself (the base rules), if symbols crowd its words or
if its lines repeat. Failures are summed per host (``source``); a host's rate
is shrunk towards the corpus rate with a beta prior whose strength is fitted
to the spread between hosts, so that a host of three documents is not judged
on three documents. Hosts whose shrunk rate passes ``host_limit`` are
rejected, and the verdict is joined back to their documents.

Defined cases: null text has no words; a null host is a host of its own;
repeated rows are separate documents; an empty table gives an empty result;
without documents the prior is neutral. Other columns are ignored by
:func:`assess` and kept untouched by :func:`keep_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import BLANKS, join_side, key_text, stored, words

SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10      # symbols against characters in words
MAX_DUP_LINE_PERCENT = 50    # repeated lines against lines with a word
HOST_LIMIT = 0.5
MAX_STRENGTH = 1000.0        # pseudo-documents in the prior of alike hosts


def _measures(df: DataFrame, text: str) -> DataFrame:
    """Add the struct column ``_q`` with the measures of ``text``.

    The steps are separate projections: each array is referenced twice in the
    next one, so Catalyst keeps it as a column and builds it once per row.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.withColumns({"_w": words(t), "_l": lines,
                         "_wc": F.length(F.translate(t, BLANKS, "")),
                         "_sym": F.length(t) - F.length(F.translate(t, SYMBOLS, ""))})
    starts = F.sequence(F.lit(0), F.size("_w") - 3)
    df = df.withColumns({
        "_n": F.size("_w"), "_nl": F.size("_l"),
        "_dl": F.size("_l") - F.size(F.array_distinct("_l")),
        "_h": F.when(F.size("_w") >= 3, F.transform(
            starts, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
        .otherwise(F.array().cast("array<bigint>"))}).drop("_w", "_l")
    # Windows that occur again: neighbours in the order of their hashes.
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")

    def same(e: Column, k: Column) -> Column:
        return F.coalesce(F.get("_s", k)["h"] == e["h"], F.lit(False))

    df = df.withColumn("_p", F.sort_array(F.transform(
        F.filter("_s", lambda e, k: ((k > 0) & same(e, F.greatest(k - 1, F.lit(0)))) | same(e, k + 1)),
        lambda e: e["i"]))).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda v, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - v, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    # Nondeterministic (and 0), so that no filter on the measures is pushed
    # below them: it would repeat each array's expression wherever it is used.
    still = F.spark_partition_id() * 0
    return df.withColumn("_q", F.struct(
        (F.col("_n") + still).cast("long").alias("n_words"), F.col("_wc").cast("long").alias("word_chars"),
        F.col("_sym").cast("long").alias("n_symbols"), F.col("_dl").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("_nl").cast("long").alias("n_lines"))).drop("_n", "_wc", "_sym", "_dl", "_nl", "_p")


def _base_failed(q) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def _failed(q) -> Column:
    return (_base_failed(q) | (100 * q["n_symbols"] > MAX_SYMBOL_PERCENT * q["word_chars"])
            | (100 * q["n_dup_lines"] > MAX_DUP_LINE_PERCENT * q["n_lines"]))


def host_verdicts(failures: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(_host, _failed) rows -> stored (_host, host_n, host_failed, host_rate, host_kept)."""
    hosts = stored(failures.groupBy("_host").agg(
        F.count(F.lit(1)).alias("host_n"), F.sum(F.col("_failed").cast("long")).alias("host_failed")), "hosts")
    n, k, h = hosts.agg(F.sum("host_n"), F.sum("host_failed"), F.count(F.lit(1))).first()
    n, k = n or 0, k or 0
    mean = k / n if n else 0.0
    spread = (hosts.agg(F.sum(F.col("host_n") * (F.col("host_failed") / F.col("host_n") - F.lit(mean))
                              * (F.col("host_failed") / F.col("host_n") - F.lit(mean)))).first()[0] or 0.0)
    noise = mean * (1 - mean) * h
    # Moments: what the hosts differ by beyond the binomial noise of their counts.
    excess = (spread - noise) / n if n else 0.0
    strength = mean * (1 - mean) / excess - 1 if excess > 0 else MAX_STRENGTH
    strength = min(MAX_STRENGTH, max(1.0, strength))
    rate = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_n") + F.lit(strength))
    return stored(hosts.withColumn("host_rate", F.round(rate, 9))
                  .withColumn("host_kept", F.col("host_rate") <= F.lit(host_limit)), "verdicts")


def assess(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the host's figures, a row per document."""
    one = docs.select("doc_id", "text", key_text(F.col("source")).alias("_host"))
    q = F.col("_q")
    rows = stored(_measures(one, "text").select(
        "doc_id", "_host", "_q.*", _base_failed(q).alias("base_failed"), _failed(q).alias("_failed")), "measures")
    hosts = host_verdicts(rows, host_limit)
    out = join_side(rows, hosts, ["_host"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_n", "host_failed", "host_rate")


def keep_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass the base rules and come from an accepted host, all columns as they were.

    Documents are measured once for the hosts and once for their own verdict,
    so no text is shuffled or stored.
    """
    names = [f"`{c}`" for c in docs.columns]
    packed = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("_text"),
                         key_text(F.col("source")).alias("_host"))
    q = F.col("_q")
    measured = _measures(packed, "_text")
    rejected = host_verdicts(measured.select("_host", _failed(q).alias("_failed")), host_limit) \
        .where(~F.col("host_kept")).select("_host")
    kept = join_side(measured.where(~_base_failed(q)), rejected, ["_host"], "left_anti")
    return kept.select("_row.*")
