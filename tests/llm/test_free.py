"""Operators that SQL does not express, against plain Python."""

import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute_llm as brute
from riskset.llm import ctw, doubling, huffman, odd_sketch, patience, queries, token_counts
from riskset.llm.components import components

SCHEMA = "doc_id long, text string"
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, ""), (2, "  two  spaces   three "), (3, "a\n b \nc\t d  e  \n\n f"),
       (4, "x <|endoftext|> y<|endoftext|> z <|startoftext|>"),
       (5, "don't I'll WE'VE  9 99　wide \x1c sep\x85 next"), (6, "\n"), (7, " lead"), (8, "trail "),
       (9, "é e ̈x ΑΣ Σ word\x0b\x0cff"), (10, "a b" * 5000), (11, None)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clashing(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("doc_id", "text", "1 as n_words", "'x' as node", "2 as _th", "3 as bounds", "4 as n", "5 as rid")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_files(spark, tables, empty):
    assert rows_of(huffman.token_files(clashing(spark, ODD), BYTE)) == sorted(brute.token_files(ODD), key=repr)
    docs = tables["documents"]
    assert rows_of(huffman.token_files(spark.createDataFrame(docs, SCHEMA), BYTE)) == sorted(
        brute.token_files(docs), key=repr)
    assert huffman.token_files(empty, BYTE).count() == 0
    twice = huffman.token_files(spark.createDataFrame([(1, "a"), (1, "a b"), (None, "c")], SCHEMA), BYTE)
    assert sorted((r["start"], r["n_tokens"]) for r in twice.collect()) == [(0, 2), (2, 3), (5, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_package_merge(n):
    rng = random.Random(n)
    counts = {s: int(rng.paretovariate(0.4)) + 1 for s in range(n)}
    for limit in (13, 16):
        bits = huffman.code_lengths(counts, limit)
        assert max(bits.values()) <= limit
        assert sum(2 ** (limit - b) for b in bits.values()) <= 2 ** limit
    if n > 1:
        import heapq
        heap, total = list(counts.values()), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            total += x
            heapq.heappush(heap, x)
        free = huffman.code_lengths(counts, 16)
        own = sum(counts[s] * b for s, b in free.items())
        assert own >= total and (own == total or max(free.values()) == 16)


def test_package_merge_is_best():
    from itertools import product
    counts = {0: 1, 1: 1, 2: 2, 3: 3, 4: 9, 5: 30}
    best = min(sum(c * b for c, b in zip(counts.values(), bs, strict=True))
               for bs in product(range(1, 4), repeat=6) if sum(2 ** -b for b in bs) <= 1)
    assert sum(counts[s] * b for s, b in huffman.code_lengths(counts, 3).items()) == best


def test_token_counts(spark, tables, empty):
    assert rows_of(token_counts.count(clashing(spark, ODD), WORDS)) == sorted(brute.token_counts(ODD), key=repr)
    docs = tables["documents"]
    assert rows_of(token_counts.count(spark.createDataFrame(docs, SCHEMA), WORDS, frequent=100)) == sorted(
        brute.token_counts(docs), key=repr)
    assert token_counts.count(empty, WORDS).count() == 0


def test_near_classes(spark, tables, empty, monkeypatch):
    rng, rows, doc = random.Random(5), [], 0
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 40, 150, 300]))]
        for k in range(30):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
            rows.append((doc, " ".join(w) if k % 11 else " ".join(w).upper()))
            doc += 7
    rows += [(1, None), (2, ""), (3, "  "), (4, "a b"), (5, "A  B"), (6, "a b c")]
    rng.shuffle(rows)
    monkeypatch.setattr(odd_sketch, "BLOCK", 16)
    assert rows_of(odd_sketch.digest_rows(clashing(spark, rows))) == sorted(brute.near_classes(rows), key=repr)
    assert odd_sketch.digest_rows(empty).count() == 0
    kept = {r["doc_id"] for r in odd_sketch.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {r[0] for r in brute.near_classes(rows, 80) if r[3]}


def test_near_keep_one_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A b"), (None, None), (None, "")], SCHEMA)
    assert rows_of(odd_sketch.keep_one(df)) == [(1, "a b"), (None, None)] or \
        rows_of(odd_sketch.keep_one(df)) == [(1, "a b"), (None, "")]


def test_near_keep_one_shared_ids(spark):
    """One document of a component is kept, also where ids are shared or missing."""
    long = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(3, long), (7, long + " more"), (7, "a text of its own entirely"), (None, other), (None, other + " x"),
            (None, other + "  X"), (9, "A b"), (9, "a  b")]
    got = odd_sketch.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and {(3, long), (7, "a text of its own entirely")} <= {tuple(r) for r in got}
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "7", "9", "None"]


def test_near_keep_one_is_settled(spark):
    """Rows that agree in id and text, but not in the source: the same one however they are dealt."""
    rows = [(1, "one text of a few words", f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {tuple(map(str, odd_sketch.keep_one(df.repartition(n).orderBy(F.rand(n))).first())) for n in (1, 5, 9)}
    assert len(kept) == 1


def test_near_shared_halves(spark, monkeypatch):
    """Sets whose digests agree in the half that names them stay apart."""
    plain = odd_sketch._digest
    monkeypatch.setattr(odd_sketch, "_digest", lambda s: b"12345678" + plain(s)[8:])
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"{w}x{i // 3}" for w in base) + (f" end{i}" if i % 3 else "")) for i in range(12)]
    rows += [(40, rows[0][1]), (41, "a b"), (42, "A B")]
    got = rows_of(odd_sketch.digest_rows(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(brute.near_classes(rows), key=repr) and {r[2] for r in got} == {0, 3, 6, 9, 41}


def test_near_many_null_ids(spark):
    """Documents without an id are nodes of their own: links between them as between others."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(600):
        w = list(base)
        w[rng.randrange(80)] = f"z{rng.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    with_ids = odd_sketch.classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    without = odd_sketch.classes(spark.createDataFrame([(None, t) for t in texts], SCHEMA))

    def shape(df):
        joined = df.groupBy("node").count()
        return sorted(map(tuple, joined.collect()))
    assert shape(with_ids) == shape(without) and without.where("chosen").count() == with_ids.where("chosen").count()


def test_near_fixture(spark, tables):
    got = rows_of(queries.QUERIES["op4_odd_sketch_near_dedup"](spark, "/root/testdata/sf0.001"))
    assert got == sorted(brute.near_classes(tables["documents"]), key=repr)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1300)]
    label = {}
    for a, b in links:
        if a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert rows_of(components(spark.createDataFrame(links, "a long, b long"))) == sorted(label.items(), key=repr)


def test_tree_scores(spark, empty):
    rng = random.Random(3)
    rows = [(i if i != 9 else None, " ".join(rng.choice(["Ab", "abra", "cad", "x", "éa", "the"])
             + rng.choice(["", "n", "ing"]) for _ in range(rng.randrange(0, 30))) + rng.choice(["", " \n", "\t"]))
            for i in range(40)] + [(70, None), (71, ""), (2, "dup dup"), (2, "dup zzz")]
    for depth, more in ((3, {}), (2, {"frequent": 3, "shard_size": 50})):
        got = rows_of(ctw.score(clashing(spark, rows), depth=depth, **more))
        want = sorted(brute.tree_scores(rows, depth), key=repr)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5]
            assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert ctw.score(empty).count() == 0


def test_substring_dedup(spark, tables, empty):
    rng = random.Random(5)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) if i % 7 else None)
            for i in range(60)]
    rows += [(50, "x y " * 60), (51, "x y " * 60), (52, "y x " * 40 + " "), (3, "q " * 200), (3, "q " * 100),
             (4, "q " * 300), (5, "")]
    for length in (2, 7, 10):
        assert rows_of(doubling.dedup(clashing(spark, rows), length)) == sorted(
            brute.substring_dedup(rows, length), key=repr)
    docs = tables["documents"]
    assert rows_of(doubling.dedup(spark.createDataFrame(docs, SCHEMA))) == sorted(
        brute.substring_dedup(docs), key=repr)
    assert doubling.dedup(empty).count() == 0


def test_line_dedup(spark, tables, empty):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["", "a", "b", "c", "d e", "f", f"own {i} {k}", " "]) for k in range(
        rng.randrange(0, 9)))) for i in range(40)]
    base = [f"line {k}" for k in range(30)]
    for i in range(50, 60):
        own = [x for x in base if rng.random() < .8]
        if i % 2:
            a = rng.randrange(len(own))
            own = own[a:] + own[:a]
        rows.append((i, "\n".join(own)))
    rows += [(70, None), (71, ""), (72, "\n".join(base)), (73, "\n".join(base))]
    want = sorted(brute.line_dedup(rows), key=repr)
    assert rows_of(patience.dedup(clashing(spark, rows))) == want
    docs = tables["documents"]
    assert rows_of(patience.dedup(spark.createDataFrame(docs, SCHEMA))) == sorted(brute.line_dedup(docs), key=repr)
    assert patience.dedup(empty).count() == 0


def all_pairs(rows):
    """doc_id, removed lines of (doc_id, text) rows without copies: aligned with all earlier texts that share a line."""
    lines = [[x for x in (text or "").split("\n") if brute.WORD.search(x)] for _, text in rows]
    held = Counter(x for own in lines for x in set(own))
    lines = [[x for x in own if held[x] > 1] for own in lines]
    out = []
    for (doc, _), own in zip(rows, lines, strict=True):
        gone = set()
        for (other, _), theirs in zip(rows, lines, strict=True):
            if other < doc and set(own) & set(theirs):
                gone |= {i for i, _ in brute._patience(own, theirs)}
        out.append((doc, len(gone)))
    return sorted(out)


def test_line_dedup_every_holder(spark, empty):
    """Lines that do not align with their first holder are compared with the others."""
    block = [(i, f"own {i}\nA\nB\nC\nend {i}") for i in range(2, 30)]
    hot = [(40, "H\nL\nL2\nL\nF"), (41, "p\nL\nq"), (42, "p\nr\nL\nq\nF\nH"), (43, "q\nL\nr\np"), (44, "r\nL2\nF\nL\nx 44\nH")]
    rng = random.Random(3)
    mixed = {"\n".join(rng.choice("stuvwyz") for _ in range(rng.randrange(1, 9))) for _ in range(60)}
    rows = [(1, "C\nB\nA"), *block, *hot, *((100 + i, t) for i, t in enumerate(sorted(mixed)))]
    rows += [(105, "u\nunlike\ns\nt"), (105, "t\ns\nu\nmore")]
    got = patience.dedup(clashing(spark, rows), every_holder=True).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == all_pairs(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[2].count("\n") == 3
    assert kept[29] == "own 29\nend 29"
    assert patience.dedup(empty, every_holder=True).count() == 0


def test_line_dedup_registered_mode(spark, tables):
    """Whole results, texts included, against aligning all overlapping pairs; rows that repeat count once."""
    docs = tables["documents"]
    got = patience.dedup(spark.createDataFrame(docs, SCHEMA), every_holder=True)
    assert rows_of(got) == sorted(brute.line_dedup(docs, every=True), key=repr)
    twice = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\nb\na"), (2, "x\nb\na"), (3, None), (3, "")]
    got = patience.dedup(clashing(spark, twice), every_holder=True)
    assert rows_of(got) == sorted(brute.line_dedup(twice, every=True), key=repr)


def test_line_dedup_common_lines(spark, monkeypatch):
    """A line with more holders than a rare one has them all asked for, in chunks."""
    monkeypatch.setattr(patience, "RARE", 2)
    monkeypatch.setattr(patience, "WIDER", 2)
    rng = random.Random(8)
    rows = [(i, "\n".join([*(rng.sample("abcdefgh", 5)), f"own {i}", *rng.choices("abcdefgh", k=2)])) for i in range(60)]
    got = patience.dedup(clashing(spark, rows), every_holder=True)
    assert rows_of(got) == sorted(brute.line_dedup(rows, every=True), key=repr)
