"""Native operators: SQL oracles on the fixture, edge cases, and the pipeline against plain Python."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import brute_llm as brute
import corpus_pipeline
from riskset.llm import host_rules, phrase_index, queries, reply_trees, systematic
from riskset.llm.common import BROADCAST_ROWS, stored

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names)

    def plain(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    assert plain(map(tuple, got.collect())) == plain(want.fetchall())


DOCS = "doc_id long, text string, source string, _row string, size int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], DOCS)


def test_host_rules_edges(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "a") for i in range(20)] + [(100 + i, "short", "b") for i in range(19)] + [(200, good, "b")]
    rows += [(300, None, None), (301, good, None), (302, "", "c"), (302, "", "c"), (None, good, "a"),
             (303, "x " * 100, "a"), (304, "l one\nl one\n" * 30, "a")]
    got = {r["doc_id"]: r for r in host_rules.assess(docs(spark, rows)).collect()}
    assert got[0]["kept"] and not got[100]["kept"] and got[100]["base_failed"]
    assert not got[200]["kept"] and not got[200]["base_failed"]       # the host fails
    assert got[300]["n_words"] == 0 and got[303]["n_repeat_words"] == 100 and got[304]["n_dup_lines"] == 59
    kept = host_rules.keep_documents(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "_row", "size"]
    want = sorted(repr(r["doc_id"]) for r in host_rules.assess(docs(spark, rows)).where("kept").collect())
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == want
    assert host_rules.assess(docs(spark, [])).count() == 0 and host_rules.keep_documents(docs(spark, [])).count() == 0


def test_mix_edges(spark):
    rows = [(i, "w " * (i % 30), f"s{i % 4}") for i in range(400)] + [(500, None, None), (500, "a b", None), (None, "a", "s1")]
    plan = systematic.plan(docs(spark, rows)).collect()
    assert len(plan) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in plan)
    by = {}
    for r in plan:
        total = by.setdefault((r["source_size"], r["target"]), [0, 0])
        total[0] += r["taken"]
        total[1] = max(total[1], r["size"])
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= 2 * largest
    mixed = systematic.mix(docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "_row", "size"]
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert rows_of(systematic.plan(docs(spark, rows))) == sorted(map(tuple, plan), key=repr)
    assert systematic.plan(docs(spark, [])).count() == 0 and systematic.mix(docs(spark, [])).count() == 0


def test_phrases_edges(spark):
    items = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "a b c d e f g h i j k"), (3, ""), (4, None), (5, "solo"),
                                   (6, "never seen anywhere"), (None, "Alpha beta gamma")], "item_id long, text string")
    rows = [(1, "x ALPHA, beta... gamma y", "s"), (2, "alpha beta and gamma", "s"), (3, "a b c d e f g h i j", "s"),
            (4, "b c d e f g h i j k " * 3, "s"), (5, None, None), (6, "", "s"), (7, "solo solo", "s"),
            (None, "solo", "s"), (8, "ésolo", "s")]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"])
           for r in phrase_index.assess(docs(spark, rows), items).collect()}
    assert got == {1: (5, 3, 2, True), 2: (4, 0, 0, False), 3: (10, 10, 1, True), 4: (30, 30, 1, True),
                   5: (0, 0, 0, False), 6: (0, 0, 0, False), 7: (2, 2, 1, True), None: (1, 1, 1, True),
                   8: (1, 0, 0, False)}
    near = {r["doc_id"] for r in phrase_index.assess(docs(spark, rows), items).where("n_near > 0").collect()}
    assert 2 in near
    clean = phrase_index.keep_clean(docs(spark, rows), items)
    assert clean.columns == ["doc_id", "text", "source", "_row", "size"]
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 5, 6, 8]
    assert phrase_index.assess(docs(spark, []), items).count() == 0
    none = items.where("false")
    assert phrase_index.assess(docs(spark, rows), none).where("contaminated").count() == 0


def test_phrases_shared_ids(spark):
    """Texts without an id, or that share one, are judged each by itself."""
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(None, "x alpha beta gamma", "s"), (None, "clean one", "s"), (4, "alpha beta gamma", "s"),
            (4, "alpha beta gamma alpha beta gamma", "s"), (4, "clean two", "s"), (None, None, "s")]
    got = rows_of(phrase_index.assess(docs(spark, rows), items).select("doc_id", "n_words", "n_hit", "contaminated"))
    assert got == sorted([(None, 4, 3, True), (None, 2, 0, False), (4, 3, 3, True), (4, 6, 6, True), (4, 2, 0, False),
                          (None, 0, 0, False)], key=repr)
    clean = phrase_index.keep_clean(docs(spark, rows), items).select("doc_id", "text")
    assert rows_of(clean) == sorted([(None, "clean one"), (4, "clean two"), (None, None)], key=repr)


def test_reply_trees(spark):
    """All paths, ranked by score: a tree with three leaves, a lone root, an orphan and a cycle."""
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0),
            (1, 4, 2, "user", "c", 9.0), (1, 5, 2, "user", "d", 9.0), (1, 6, 5, "assistant", "e", 0.0),
            (2, 1, None, None, None, None), (3, 7, 99, "user", "orphan", 1.0), (4, 1, 2, "user", "x", 1.0),
            (4, 2, 1, "user", "y", 1.0)]
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    best = rows_of(reply_trees.paths(df))
    texts = {}
    for r in best:
        texts.setdefault(r[0], []).append((r[3], r[5]))
    assert {k: [t for _, t in sorted(v)] for k, v in texts.items()} == {1: ["q", "a", "d", "e"], 2: [""], 3: ["orphan"]}
    every = reply_trees.paths(df, top=None)
    assert sorted(r["leaf"] for r in every.where("tree = 1").select("leaf").distinct().collect()) == [3, 4, 6]
    assert every.where("tree = 1").count() == 2 + 3 + 4


def test_long_chain(spark):
    n = 77
    df = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(n)],
                               "tree long, msg long, parent long, role string, text string, score double")
    got = reply_trees.paths(df).orderBy("pos").collect()
    assert [r["text"] for r in got] == [str(i) for i in range(n)] and got[0]["path_score"] == n


def test_template_round_trip(spark):
    hard = ["", "\\", "<", "</turn>\n", "<turn>user\nx</turn>\n", "\\0", "\\1", "\\\\1<\\", "a\nb", "é\U0001f600"]
    rows = [(c, t, role, text) for c, (role, text) in enumerate(
        [("assistant", x) for x in hard] + [(x, "t") for x in hard]) for t in range(2)]
    df = spark.createDataFrame(rows, "conv long, pos long, role string, text string")
    from pyspark.sql import functions as F
    out = reply_trees.render(df, ["conv"]).select(
        "conv", reply_trees.read_back(F.col("formatted")).alias("t"),
        reply_trees.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        own = [x for x in rows if x[0] == r["conv"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2], x[3]) for x in own]
        assert r["loss"] == "".join(x[3] for x in own if x[2] == "assistant")


def test_chat_edges(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    rows = queries.QUERIES["op10_reply_tree_chats"](spark, str(tmp_path)).collect()
    text = "\\### Assistant: </turn> ok"
    assert [r["conv_id"] for r in rows] == [-7] and rows[0]["loss_chars"] == len(text)
    assert rows[0]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chat_null_keys(spark, tmp_path):
    """A null conversation is one of its own, as in the SQL; so are messages without an id."""
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (5, 0, "user", "x"), (5, None, "assistant", "y"),
            (None, 2, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.QUERIES["op10_reply_tree_chats"](spark, str(tmp_path))
    null = [tuple(r) for r in got.where("conv_id is null").collect()]
    want = con.execute(queries.ORACLES["op10_reply_tree_chats"]).fetchall()
    assert null == [r for r in want if r[0] is None] and null[0][1] == 3 and got.count() == len(want) == 3
    df = spark.createDataFrame([(None, 1, None, "user", "q", 1.0), (None, None, 1, "user", "b", 2.0),
                                (None, None, 1, "user", "c", 3.0), (2, None, None, "user", "r", 1.0)],
                               "tree long, msg long, parent int, role string, text string, score double")
    every = rows_of(reply_trees.paths(df, top=None).select("tree", "leaf", "path_score", "pos", "text"))
    assert every == sorted([(None, None, 3.0, 1, "q"), (None, None, 3.0, 2, "b"), (None, None, 4.0, 1, "q"),
                            (None, None, 4.0, 2, "c"), (2, None, 1.0, 1, "r")], key=repr)


def test_chat_long_conversation(spark):
    """80,000 turns in linear time; spans name the same text by place and by turn."""
    n = 80_000
    turns = spark.range(1, n + 1, numPartitions=4).select(
        F.lit(9).alias("conv_id"), F.col("id").alias("pos"),
        F.when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("\\ <\u00fc\U0001f600> \n"), F.col("id").cast("string")).alias("text"))
    chats = reply_trees.render(turns, ["conv_id"])
    row = chats.select("formatted", "loss_spans", reply_trees.read_back(F.col("formatted")).alias("turns"),
                       reply_trees.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t["text"] for t in row["turns"]] == [f"\\ <\u00fc\U0001f600> \n{i}" for i in range(1, n + 1)]
    want = [f"\\ <\u00fc\U0001f600> \n{i}" for i in range(2, n + 1, 2)]
    assert row["loss"] == "".join(want)
    plain = [row["formatted"][s["start"]:s["start"] + s["length"]].replace("\\1", "<").replace("\\0", "\\")
             for s in row["loss_spans"]]
    assert plain == want


def test_chat_ties_clashing_columns_and_null_texts(spark, tmp_path):
    """Repeated rows, turns that share a number, a null text, and columns named as the operator's own."""
    rows = [(1, 0, "user", "q", 1, "x"), (1, 0, "user", "q", 2, "y"), (1, 1, "assistant", None, 3, "z"),
            (1, 1, "assistant", "b", 4, "z"), (2, 5, None, "<turn>", 5, "z"), (2, 5, "assistant", "", 6, "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, part string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.QUERIES["op10_reply_tree_chats"](spark, str(tmp_path))
    want = con.execute(queries.ORACLES["op10_reply_tree_chats"])
    names = [d[0] for d in want.description]
    assert rows_of(got.select(*names)) == sorted(want.fetchall(), key=repr)


def test_pipeline_against_plain_python(spark):
    """The stages one after the other; the mix follows its own SQL oracle, which test_oracle checks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "token_files"]
    one = stored(stages["quality_rules"](spark, docs, SF), "t")
    kept = {r["doc_id"] for r in host_rules.assess(docs).where("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    two = stored(stages["near_dedup"](spark, one, SF), "t")
    left = [r for r in rows if r[0] in kept]
    first = {r[0] for r in brute.near_classes(left, 80) if r[3]}
    assert {r["doc_id"] for r in two.collect()} == first and two.columns == docs.columns
    three = stored(stages["decontaminate"](spark, two, SF), "t")
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(r["text"].translate(brute.AZ))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()

    def hit(text):
        w = word.findall((text or "").translate(brute.AZ))
        return any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    clean = {d for d, t in left if d in first and not hit(t)}
    assert {r["doc_id"] for r in three.collect()} == clean
    four = stored(stages["mix_sources"](spark, three, SF), "t")
    plan = {r["doc_id"]: r["copies"] for r in systematic.plan(three).collect()}
    counts = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in plan.items() if n} and four.columns == docs.columns
    text = dict(rows)
    want = brute.token_files([(d, text[d]) for d in sorted(counts) for _ in range(counts[d])])
    assert rows_of(stages["token_files"](spark, four, SF)) == sorted(want, key=repr)
    assert rows_of(corpus_pipeline.run(spark, SF)) == sorted(want, key=repr)


def test_salted_join(spark, monkeypatch):
    from riskset.llm import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    left = spark.createDataFrame([(i % 3, i) for i in range(90)], "k long, v long")
    side = stored(spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string"), "side")
    assert common.join_side(left, side, ["k"]).count() == 60
    assert common.join_side(left, side, ["k"], "left").count() == 90
    assert common.join_side(left, side, ["k"], "left_anti").count() == 30
    assert BROADCAST_ROWS > 0
