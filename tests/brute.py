"""Independent brute-force references (NumPy, per-subject loops) for tests."""

from __future__ import annotations

import math

import numpy as np


def km(t, e):
    """[(time, n_at_risk, d, S)] by the product-limit definition."""
    t, e = np.asarray(t, float), np.asarray(e, int)
    out, s = [], 1.0
    for u in np.unique(t):
        n = int((t >= u).sum())
        d = int(((t == u) & (e == 1)).sum())
        s = s * (1 - d / n)
        out.append((u, n, d, s))
    return out


def logrank(t, e, g):
    t, e, g = np.asarray(t, float), np.asarray(e, int), np.asarray(g)
    levels = sorted(set(g.tolist()))
    k = len(levels)
    o = np.zeros(k)
    ex = np.zeros(k)
    v = np.zeros((k, k))
    for u in np.unique(t[e == 1]):
        at = t >= u
        n = at.sum()
        d = ((t == u) & (e == 1)).sum()
        nj = np.array([(at & (g == lv)).sum() for lv in levels], float)
        dj = np.array([((t == u) & (e == 1) & (g == lv)).sum() for lv in levels], float)
        o += dj
        ex += d * nj / n
        if n > 1:
            w = d * (n - d) / (n - 1)
            v += w * (np.diag(nj / n) - np.outer(nj / n, nj / n))
    z = (o - ex)[:-1]
    stat = float(z @ np.linalg.solve(v[:-1, :-1], z))
    return stat, k - 1


def cox_efron(t, e, x, ties="efron", steps=30):
    """Newton on the partial likelihood, looping over subjects."""
    t, e = np.asarray(t, float), np.asarray(e, int)
    x = np.asarray(x, float)
    if x.ndim == 1:
        x = x[:, None]
    p = x.shape[1]
    beta = np.zeros(p)
    for _ in range(steps):
        u, info, ll = np.zeros(p), np.zeros((p, p)), 0.0
        r = np.exp(x @ beta)
        for tt in np.unique(t[e == 1]):
            risk = t >= tt
            dead = (t == tt) & (e == 1)
            d = dead.sum()
            s0, s1 = r[risk].sum(), (x[risk] * r[risk, None]).sum(0)
            s2 = (x[risk, :, None] * x[risk, None, :] * r[risk, None, None]).sum(0)
            d0, d1 = r[dead].sum(), (x[dead] * r[dead, None]).sum(0)
            d2 = (x[dead, :, None] * x[dead, None, :] * r[dead, None, None]).sum(0)
            ll += (x[dead] @ beta).sum()
            u += x[dead].sum(0)
            for l in range(d):
                phi = l / d if ties == "efron" else 0.0
                a0, a1, a2 = s0 - phi * d0, s1 - phi * d1, s2 - phi * d2
                ll -= math.log(a0)
                u -= a1 / a0
                info += a2 / a0 - np.outer(a1, a1) / a0 ** 2
        step = np.linalg.solve(info, u)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info))), ll


def concordance(t, e, risk):
    conc = tied = comp = 0
    n = len(t)
    for i in range(n):
        if e[i] != 1:
            continue
        for j in range(n):
            if t[j] > t[i] or (t[j] == t[i] and e[j] == 0 and j != i):
                comp += 1
                if risk[i] > risk[j]:
                    conc += 1
                elif risk[i] == risk[j]:
                    tied += 1
    return conc, tied, comp


def auc(y, s):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = 0.0
    for a in pos:
        for b in neg:
            tot += 1.0 if a > b else 0.5 if a == b else 0.0
    return tot / (len(pos) * len(neg))
