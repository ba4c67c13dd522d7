"""Plain Python references for the training-data operators, written for clarity only."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_files(rows, end_id=2):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def token_counts(rows, limit=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        out.append((doc, len((text or "").encode()), n, n > limit))
    return out


def near_classes(rows, percent=85):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(AZ))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in index[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, len(sets[i]), least[top(i)], least[top(i)] == doc) for i, (doc, _) in enumerate(rows)]


def substring_dedup(rows, length=50):
    words = [WORD.findall(text or "") for _, text in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] < doc:
                gone[s:s + length] = [True] * length
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def _lis(values):
    best, back = [], []
    for i, v in enumerate(values):
        j = max((k for k in range(i) if values[k] < v), key=lambda k: (best[k], k), default=-1)
        back.append(j)
        best.append(best[j] + 1 if j >= 0 else 1)
    if not best:
        return []
    i = max(range(len(best)), key=lambda k: (best[k], k))
    out = []
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _patience(a, b, ao=0, bo=0):
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(ao, bo), *_patience(a[1:], b[1:], ao + 1, bo + 1)]
    if a[-1] == b[-1]:
        return [*_patience(a[:-1], b[:-1], ao, bo), (ao + len(a) - 1, bo + len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    anchors = [once[k] for k in _lis([j for _, j in once])]
    if not anchors:
        return []
    out, pi, pj = [], 0, 0
    for i, j in [*anchors, (len(a), len(b))]:
        out += _patience(a[pi:i], b[pj:j], ao + pi, bo + pj)
        if i < len(a):
            out.append((ao + i, bo + j))
        pi, pj = i + 1, j + 1
    return out


def line_dedup(rows, every=False):
    """Align each text with the first (or with all earlier) holders of its lines; lines that no other text holds are left out."""
    once, later = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if once.get(text or "", doc) < doc:
            later.append((doc, text or ""))
        else:
            once.setdefault(text or "", doc)
    texts = sorted({(doc, text or "") for doc, text in rows} - set(later))
    lines = {t: [x for x in t[1].split("\n") if WORD.search(x)] for t in texts}
    holders = collections.defaultdict(set)
    for t, own in lines.items():
        for x in own:
            holders[x].add(t)
    shared = {x for x, h in holders.items() if len(h) > 1}
    out = {}
    for t, own in lines.items():
        mine = [x for x in own if x in shared]
        others = {min(holders[x], key=lambda h: h[0]) for x in mine}
        gone = set()
        partners = sum(o[0] < t[0] for o in others)
        for o in {h for x in mine for h in holders[x]} if every else others:
            if o[0] < t[0]:
                kept = [i for i, x in enumerate(own) if x in shared]
                theirs = [x for x in lines[o] if x in shared]
                gone |= {kept[i] for i, _ in _patience(mine, theirs)}
        out[t] = gone, partners
    result = []
    for doc, text in rows:
        text = text or ""
        n = sum(bool(WORD.search(x)) for x in text.split("\n"))
        if (doc, text) in later:
            gone, partners = set(range(n)), 1
        else:
            gone, partners = out[(doc, text)]
        kept, at = [], 0
        for x in text.split("\n"):
            if WORD.search(x):
                if at not in gone:
                    kept.append(x)
                at += 1
            else:
                kept.append(x)
        result.append((doc, n, len(gone), partners, "\n".join(kept)))
    return result


def _kt(a, b):
    return (math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)) / math.log(2)


def tree_scores(rows, depth):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = [(doc, WORD.findall((text or "").translate(AZ))) for doc, text in rows]

    def held(doc):
        return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1

    def decisions(words):
        b = b"\n" * depth + " ".join(words).encode() + b"\n"
        for i in range(depth, len(b)):
            for k in range(8):
                yield i, b, (256 | b[i]) >> (8 - k), (b[i] >> (7 - k)) & 1

    counts, nodes = collections.Counter(), collections.defaultdict(lambda: [0, 0])
    for doc, words in texts:
        if not held(doc):
            counts.update([*words, "\0end"])
            for i, b, node, bit in decisions(words):
                for d in range(depth + 1):
                    nodes[(b[i - d:i], node)][bit] += 1
    children = collections.defaultdict(list)
    for s, node in nodes:
        if s:
            children[(s[1:], node)].append((s, node))
    weight, stop = {}, {}
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        own = _kt(*nodes[key])
        if len(key[0]) == depth:
            weight[key], stop[key] = own, 1.0
        else:
            below = sum(weight[k] for k in children[key])
            high = max(own, below)
            weight[key] = high + math.log2(1 + 2 ** (min(own, below) - high)) - 1
            stop[key] = 0.0 if below - own > 1000 else 1 / (1 + 2.0 ** (below - own))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for doc, words in texts:
        tokens = [*words, "\0end"]
        base = sum(math.log10((counts[w] + .5) / (total + .5 * (kinds + 1))) for w in tokens)
        score = 0.0
        for i, b, node, bit in decisions(words):
            q = .5
            for d in range(depth, -1, -1):
                key = (b[i - d:i], node)
                if key in nodes:
                    q = stop[key] * (nodes[key][1] + .5) / (sum(nodes[key]) + 1) + (1 - stop[key]) * q
                else:
                    q = .5
            score += math.log10(q if bit else 1 - q)
        out.append((doc, held(doc), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score))
    return out
