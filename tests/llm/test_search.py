"""Nearest neighbours, ranked search and collocations against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brute_llm import AZ
from riskset.llm import bit_slices, gram_automata, hash_forest, queries

VECTORS = "vec_id long, embedding array<float>, rank int, tree string, h long"


def nearest(rows, k):
    """(query id, [(id, score)]) by comparing every pair."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
              and any(v)}
    dim = max((len(v) for _, v in usable), default=0)
    own = [(i, np.array([*v, *[0.0] * (dim - len(v))])) for i, v in sorted(usable)]
    out = []
    for q, (i, v) in enumerate(own):
        if i % 20 == 0:
            scored = sorted((-float((v * w).sum()), j) for p, (j, w) in enumerate(own) if p != q)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return out


def search(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    got = hash_forest.search(df, df.where("vec_id % 20 = 0"), **more)
    return [tuple(r) for r in got.collect()]


def as_float32(v):
    return [float(np.float32(x)) for x in v]


def test_forest_recall_and_ranks(spark, monkeypatch):
    """Clustered vectors of different norms in many blocks, a hot cluster and a hot vector."""
    monkeypatch.setattr(hash_forest, "BLOCK", 64)
    monkeypatch.setattr(hash_forest, "ASKS", 16)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24))
    rows = [(int(i), as_float32((centres[i % 40 if i % 3 else 0] + rng.standard_normal(24) * .3) * rng.uniform(.5, 2)))
            for i in range(2400)]
    rows += [(int(i), as_float32(centres[1])) for i in range(3000, 3400)]
    got, want = search(spark, rows, k=10, trees=8), nearest(rows, 10)
    assert len(got) == len(want)
    true = {(q, j) for q, _, j, _ in want}
    assert len({(q, j) for q, _, j, _ in got} & true) >= .9 * len(true)
    exact = {i: np.array(v) for i, v in rows}
    for q, _, j, s in got:
        assert s == float((exact[q] * exact[j]).sum()) and q != j
    ranks = {}
    for q, r, j, s in sorted(got):
        ranks.setdefault(q, []).append((r, -s, j))
    for own in ranks.values():
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    # Copies of one vector: the smallest ids, whatever the block.
    assert [j for q, r, j, _ in sorted(got) if q == 3380][:10] == [j for q, _, j, _ in want if q == 3380]


def test_forest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (20, [nan, 1.0]), (40, [inf, 1.0]), (60, []),
            (80, [0.0, 0.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (120, [-1.0, -2.0]), (0, [2.0, 1.0]), (5, [3.0]),
            (6, [1.0, 2.0, 3.0]), (7, [-0.0, 2.0 ** 100])]
    assert sorted(search(spark, rows)) == sorted(nearest(rows, 20))
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, []) == []


def test_forest_stops():
    counts = np.array([[[9, 5, 2, 0], [9, 4, 1, 1]]])
    counts = np.concatenate([counts, np.zeros((1, 2, hash_forest.BITS + 1 - 4), int)], axis=2)
    for budget, need, depth in ((1, 1, 3), (2, 1, 2), (3, 2, 2), (4, 2, 1), (9, 6, 0), (99, 1, 0)):
        assert hash_forest.stops(counts, budget, need).tolist() == [depth]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_prefixes(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a, b = rng.getrandbits(hash_forest.BITS), rng.getrandbits(rng.randrange(1, hash_forest.BITS))
        c = a ^ b
        same = 0
        while same < hash_forest.BITS and (a >> (hash_forest.BITS - same - 1)) == (c >> (hash_forest.BITS - same - 1)):
            same += 1
        assert hash_forest.shared_bits(np.array([a]), np.array([c]))[0] in (same, same - 1)
        lo, hi = hash_forest.node(np.array([a]), same)
        assert lo[0] <= c <= hi[0]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(doc, Counter(TERM.findall((text or "").translate(AZ)))) for doc, text in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), n in zip(held, lengths, strict=True):
            if n:
                m = 100 - 75 + (75 * n * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                    (1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(AZ)) if c[t])
                if s > 0:
                    scored.append((-s, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


DOCS, ITEMS = "doc_id long, text string, a string, term long, score int, rank int", "item_id long, text string, n int, item string"


def rank(spark, docs, items, **more):
    got = bit_slices.search(spark.createDataFrame([(*r, "x", 1, 2, 3) for r in docs], DOCS),
                            spark.createDataFrame([(*r, 1, "y") for r in items], ITEMS), **more)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("batch", [50_000, 40])
def test_ranked_search(spark, monkeypatch, batch):
    """Skewed terms, copies, ties, long texts and items in one batch and in many."""
    monkeypatch.setattr(bit_slices, "BATCH_TERMS", batch)
    monkeypatch.setattr(bit_slices, "CELLS", 1 << 13)
    rng = random.Random(11)
    known = [f"w{int(rng.paretovariate(.7))}é{i % 7}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(known, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    hot = " ".join(known[:20])
    docs += [(1000 - i, hot) for i in range(150)] + [(2000 + i, f"{hot} own{i}") for i in range(60)]
    docs += [(3, docs[3][1]), (3, "another text of W1é1 w1É1"), (None, hot), (None, None), (5, ""), (6, " ,.\x7f"),
             (7, (" ".join(known) + " ") * 40), (8, "ab1-2C.d_e\x1cf é"), (9, "　x y")]
    items = [(i, " ".join(rng.choices(known, k=rng.choice([1, 3, 12, 30])))) for i in range(25)]
    items += [(30, hot), (30, "w1É1, AB1 2c!"), (31, None), (32, ""), (33, "nowhere"), (None, f"{hot} {hot}"), (34, "x y é f")]
    assert rank(spark, docs, items) == ranked(docs, items)


def test_ranked_search_edges(spark):
    assert rank(spark, [], [(1, "a")]) == []
    assert rank(spark, [(1, "a")], []) == []
    assert rank(spark, [(1, None), (2, "--")], [(1, "a")]) == []
    assert rank(spark, [(2, "A b"), (1, "a"), (1, "a")], [(1, "a a")]) == ranked([(2, "A b"), (1, "a"), (1, "a")], [(1, "a a")])


def test_bounds_hold():
    """No bound is below the exact score, whatever the counts."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.choice([1, 4, 20, 200]))) for _ in range(60)]
    block = [b for b in bit_slices._signatures([])(iter([pa.RecordBatch.from_pydict(
        {"text": texts, "a": list(range(60)), "b": [0] * 60})])) if b.column("bits").null_count == 0]
    docs = [(i, t) for i, t in enumerate(texts)]
    want = {(r[0], r[2]): r[3] for r in ranked(docs, [(0, "a b c a"), (1, "j")], k=99)}
    df = Counter(t for x in texts for t in set(x.split()))
    terms = [[{"term": t, "n": n, "df": df[t]} for t, n in own] for own in ((("a", 2), ("b", 1), ("c", 1)), (("j", 1),))]
    queries = bit_slices.Queries([{"item": i, "terms": own} for i, own in enumerate(terms)], 60, sum(len(x.split()) for x in texts))
    bounds = {(q, a): float(x) for b in block for row in b.to_pylist() for q, own in queries.bounds(row)
              for a, x in zip(row["a"], own, strict=True)}
    assert all(bounds[key] >= score for key, score in want.items())


def collocations(rows, min_count=10, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every sequence."""
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        longer = Counter()
        for g, c in own.items():
            if len(g) == 3 and c >= min_count:
                for part in (g[:2], g[1:]):
                    longer[part] = max(longer[part], c)
        found = []
        for g, a in own.items():
            if len(g) > 1 and a >= min_count and not (len(g) == 2 and longer[g] and 100 * longer[g] >= share * a):
                score, _, l, r = min((10 ** 6 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]])
                                     for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(1, t, g, "x", 5, 6) for g, t in rows],
                               "doc_id long, text string, lang string, phrase string, n int, range int").repartition(5)
    return sorted(tuple(r) for r in gram_automata.mine(df, **more).collect())


def test_collocations(spark, monkeypatch):
    monkeypatch.setattr(gram_automata, "RANGE_BYTES", 2000)
    rng = random.Random(9)
    known = ["the", "The", "of", "é", "naïve", "x\x01y", "\x00", "a-b", "zz"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.choice([0, 1, 4, 60])):
            text += rng.choice(known[:rng.choice([3, 10, 49])]) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", " ; "])
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    rows += [("en", "new york city " * 2000), ("fr", None), ("fr", ""), ("fr", " . "), ("de", "q " * 500)] + [("es", "uno dos")] * 30
    assert mined(spark, rows) == collocations([(g, t) for g, t in rows])
    assert mined(spark, rows, min_count=3, top=7, share=80) == collocations(rows, 3, 80, 7)
    assert mined(spark, []) == []
    assert mined(spark, [("en", None)]) == []


def test_automaton_paths_and_states():
    """Paths come back as they were, equal states are one, and walks give the weights."""
    rng = random.Random(1)
    for size, many in ((3, 30), (6, 200), (2, 9), (40, 3000)):
        held = {}
        for _ in range(many):
            path = tuple(rng.randrange(size) for _ in range(rng.choice([2, 3, 4])))
            held[path] = rng.choice([1, 1, 1, 2, 50])
        paths = sorted(held)
        symbols = [np.array([p[d] if d < len(p) else -1 for p in paths], np.int64) for d in range(4)]
        row = gram_automata.build(pa.array([f"s{i:03}" for i in range(size)]), symbols, np.array([held[p] for p in paths]))
        automaton = gram_automata.Automaton(gram_automata.unpack(gram_automata.pack(row)))
        back = {tuple(int(s[i]) for s in path): int(weight[i]) for path, weight in automaton.paths() for i in range(len(weight))}
        assert back == held

        def state(prefix, held=held):
            return frozenset((p[len(prefix):], n) for p, n in held.items() if p[:len(prefix)] == prefix and len(p) > len(prefix))

        different = {(len(p[:d]), state(p[:d])) for p in held for d in range(len(p)) if state(p[:d])}
        assert len(row[1]) - 1 == len(different)
        for k in (2, 3, 4):
            asked = [tuple(rng.randrange(-1, size) for _ in range(k)) for _ in range(300)] + [p for p in paths if len(p) == k]
            got = automaton.walk([np.array([p[d] for p in asked]) for d in range(k)])
            assert got.tolist() == [held.get(p, 0) for p in asked]


def test_weakest_cut_is_exact():
    big = np.array([3_000_000_000_000, 7])
    l, r, score = gram_automata.weakest_cut(big, [(big + 1, big), (big + 2, big)])
    assert score.tolist() == [10 ** 6 * int(a) ** 2 // ((int(a) + 2) * int(a)) for a in big]
    assert l.tolist()[1] == 9 and r.tolist() == big.tolist()


def test_forest_query_on_the_fixture(spark):
    """The registered query against all pairs: every query, whole ranks, recall, exact scores."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.QUERIES["op11_hash_forest_neighbours"](spark, "/root/testdata/sf0.001").collect()]
    want = nearest(rows, 20)
    assert len(got) == len(want) and {r[:2] for r in got} == {r[:2] for r in want}
    assert len({(q, j) for q, _, j, _ in got} & {(q, j) for q, _, j, _ in want}) >= .9 * len(want)
    exact = {i: np.array(v) for i, v in rows}
    assert all(s == float((exact[q] * exact[j]).sum()) for q, _, j, s in got)
