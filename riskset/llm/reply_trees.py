"""Chat formatting over reply trees.

Messages point to the message they answer. Iterative self-joins double the
known stretch of ancestors until every message knows its root and the score of
its path, so a chain of n messages takes log2(n) joins. The root-to-leaf paths
of a tree are ranked by score, the best ``paths`` are kept, their messages are
fetched by the same doubled links, and each path is formatted as one
conversation.

Template: a turn is ``<turn>role\\n text </turn>\\n`` (without the blanks).
Inside roles and texts ``\\`` becomes ``\\0`` and ``<`` becomes ``\\1``; in
roles a line break becomes ``\\2``. No control string can then occur inside a
text, and replacing back in the opposite order restores it. The loss mask is
the list of code-point spans of the assistant texts.

Defined cases: null role or text is empty; a parent that is missing makes its
child a root; repeated (tree, msg) rows and cycles are an error of the input:
of repeated rows the first by (parent, role, text) counts, and messages on or
below a cycle have no root and belong to no path; ties in score go to the
longer path, then the smaller leaf; a null tree is a tree of its own; a message
without an id is a message that nothing answers, each row one of its own; an
empty table gives no conversation. One
conversation is one value, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskset.llm.common import stored

OPEN, CLOSE = "<turn>", "</turn>\n"
MAX_DOUBLINGS = 60           # past any depth that 64-bit ids can number


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, msg, parent, role, text, score) -> (tree, leaf, path_score, pos, role, text), the chosen paths' messages.

    ``top`` paths a tree, or all of them if None.
    """
    first = Window.partitionBy("tree", "msg").orderBy("parent", "role", "text")
    # Keys in structs, so that null equals null; messages without an id are told apart by their number.
    of = messages.schema["msg"].dataType
    nodes = stored(messages.select("tree", "msg", F.col("parent").cast(of).alias("parent"),
                                   F.coalesce("role", F.lit("")).alias("role"),
                                   F.coalesce("text", F.lit("")).alias("text"),
                                   F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
                   .withColumn("_n", F.row_number().over(first)).where("_n = 1 or msg is null").select(
        F.struct("tree").alias("tree"),
        F.struct(F.col("msg").alias("id"), F.when(F.col("msg").isNull(), F.col("_n")).otherwise(0).alias("n")).alias("msg"),
        F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("id"), F.lit(0).alias("n"))).alias("parent"),
        "role", "text", "score"), "nodes")
    known = nodes.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("_known"))
    links = nodes.drop("role", "text").join(known, ["tree", "parent"], "left").select(
        "tree", "msg", F.when(F.col("_known"), F.col("parent")).alias("up"), F.col("score").alias("sum"),
        F.lit(1).cast("long").alias("n"))
    # state: what lies between msg and its ancestor ``up``, that one excluded.
    levels, state, n_nodes = [], stored(links, "links"), nodes.count()
    for _ in range(MAX_DOUBLINGS):
        open_ = state.where(F.col("up").isNotNull())
        levels.append(open_.select("tree", "msg", "up"))
        if open_.isEmpty():
            break
        above = state.select("tree", F.col("msg").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"),
                             F.col("n").alias("_n"), *([F.col("root").alias("_root")] if "root" in state.columns else []))
        joined = open_.join(above, ["tree", "up"])
        done = state.where(F.col("up").isNull())
        root = F.coalesce(F.col("_root"), F.col("up")) if "root" in state.columns else F.col("up")
        step = joined.select("tree", "msg", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"),
                             (F.col("n") + F.col("_n")).alias("n"),
                             F.when(F.col("_up").isNull(), root).alias("root"))
        if "root" not in state.columns:
            done = done.withColumn("root", F.col("msg"))
        state = stored(done.unionByName(step), "links")
        # A cycle never closes: it doubles past the number of its messages.
        if not state.where(F.col("up").isNotNull() & (F.col("n") > n_nodes)).isEmpty():
            break
    if "root" not in state.columns:
        state = state.withColumn("root", F.col("msg"))
    parents = levels[0].select("tree", F.col("up").alias("msg")).distinct() if levels else None
    leaves = state.where(F.col("up").isNull()).join(parents, ["tree", "msg"], "left_anti")
    if top is not None:
        best = Window.partitionBy("tree", "root").orderBy(F.desc("sum"), F.desc("n"), "msg")
        leaves = leaves.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top)
    # Every distance from the leaf is one sum of powers of two: each level's
    # links, longest first, map what is gathered so far once more.
    found = leaves.select("tree", F.col("msg").alias("leaf"), F.col("sum").alias("path_score"), "msg",
                          F.col("n").alias("pos"))
    for k in reversed(range(len(levels))):
        higher = found.join(levels[k], ["tree", "msg"]).select(
            "tree", "leaf", "path_score", F.col("up").alias("msg"), (F.col("pos") - (1 << k)).alias("pos"))
        found = stored(found.unionByName(higher), "path")
    return found.join(nodes.select("tree", "msg", "role", "text"), ["tree", "msg"]).select(
        "tree.tree", F.col("leaf.id").alias("leaf"), "path_score", "pos", "role", "text")


def render(turns: DataFrame, keys: list[str], learn: str = "assistant") -> DataFrame:
    """(keys, pos, role, text) -> (keys, formatted, loss_spans): a row per conversation.

    ``loss_spans`` are (start, length, turn, within): code points of the
    formatted text, and the same start as a turn (from 0) and a place in it.
    The work is linear in the turns: starts are a running sum of their lengths.
    """
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    role = F.replace(_escape(F.col("role")), F.lit("\n"), F.lit("\\2"))
    parts = turns.select(*keys, "pos", F.concat(F.lit(OPEN), role, F.lit("\n"), _escape(F.col("text")), F.lit(CLOSE)).alias("part"),
                         (F.length(role) + len(OPEN) + 1).alias("within"), (F.col("role") == learn).alias("learn"))
    parts = parts.withColumn("at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)).cast("long"))
    each = F.struct("pos", "at", "within", "learn", "part")
    df = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias("_t"))
    spans = F.filter(F.transform("_t", lambda t, i: F.when(t["learn"], F.struct(
        (t["at"] + t["within"]).alias("start"),
        (F.length(t["part"]) - t["within"] - len(CLOSE)).cast("long").alias("length"),
        i.alias("turn"), t["within"].alias("within")))), lambda x: x.isNotNull())
    return df.select(*keys, F.concat_ws("", F.col("_t.part")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(
            _unescape(F.replace(F.substr(role, F.lit(len(OPEN) + 1)), F.lit("\\2"), F.lit("\n"))).alias("role"),
            _unescape(F.substr(p, F.length(role) + 2)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    The text is split into its turns once; a span is cut out of its turn.
    """
    def cut(pieces: Column) -> Column:
        return F.concat_ws("", F.transform(spans, lambda s: _unescape(
            F.substr(F.get(pieces, s["turn"]), s["within"] + 1, s["length"].cast("int")))))

    return F.transform(F.array(F.split(formatted, CLOSE, -1)), cut)[0]     # the split is bound, not repeated


def linear(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each turn answers the one before it.

    Rows of one conversation with the same turn follow each other by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select(
        F.col("conv_id").alias("tree"), n.alias("msg"), F.when(n > 1, n - 1).alias("parent"), "role", "text",
        F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns say what could be taken for a control string."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                 "conv_id long, turn long, role string, text string")
