"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates(docs, percent, k=5):
    """docs: (id, text) -> {id: (n_shingles, component)}"""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = defaultdict(int)
    for ids in by.values():
        for x in range(len(ids)):
            for y in range(x):
                both[ids[x], ids[y]] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def decontaminate(docs, items, n=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, text in items:
        w = word(text)
        for j in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[j : j + n])].add(i)
    spans, out = {len(w) for w in windows}, {}
    for d, text in docs:
        w, hit, found = word(text), set(), set()
        for m in spans:
            for j in range(len(w) - m + 1):
                if (x := tuple(w[j : j + m])) in windows:
                    hit |= set(range(j, j + m))
                    found |= windows[x]
        names = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def pieces(ids, capacity):
    over = len(ids) % capacity
    cuts = [0, *range(over, len(ids), capacity)] if over and len(ids) > capacity else list(range(0, len(ids), capacity))
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True))]


def nearest(vectors, queries, k=5):
    """vectors: {id: list} -> {query: [(id, score)]}"""
    ids = sorted(i for i, v in vectors.items() if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v))
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for q in queries:
        if q in ids:
            s = x @ x[ids.index(q)]
            order = sorted((-round(float(v), 12), i) for i, v in zip(ids, s, strict=True) if i != q)[:k]
            out[q] = [(i, -v) for v, i in order]
    return out


def languages(rows, names, buckets, size, right, prior_rows, spread):
    """rows: (text, fold, declared, address, host) -> [(language, probability among the languages)]; buckets(text): the numbers of its trigrams; right: (declared, address) by what has been counted."""
    text_of = [buckets(t or "") for t, *_ in rows]
    models = []
    for own in range(1 + max(r[1] for r in rows)):
        counts = {x: [0] * size for x in names}
        for t, (_, fold, said, *_) in zip(text_of, rows, strict=True):
            if fold != own and said in counts:
                for b in t:
                    counts[said][b] += 1
        models.append({x: [math.log((n + spread) / (sum(c) + spread * size)) for n in c] for x, c in counts.items()})
    mean = [{x: sum(models[r[1]][x][b] for b in t) / len(t) if len(t) else 0.0 for x in names} for t, r in zip(text_of, rows, strict=True)]
    likeliest = [max(names, key=lambda x: (m[x], -names.index(x))) if len(t) else None for m, t in zip(mean, text_of, strict=True)]
    n = [sum(k == x for k in likeliest) for x in names]
    everywhere = [(c + 1) / (sum(n) + len(n)) for c in n]
    domain = lambda h: ".".join(h.split(".")[-2:])
    out = []
    for i, (t, (_, _, said, address, host)) in enumerate(zip(text_of, rows, strict=True)):
        p = everywhere
        if host is not None:
            for same in (lambda h, host=host: domain(h) == domain(host), lambda h, host=host: h == host):
                c = [sum(r[4] is not None and same(r[4]) and k == x for j, (r, k) in enumerate(zip(rows, likeliest, strict=True)) if j != i) for x in names]
                p = [(a + prior_rows * b) / (sum(c) + prior_rows) for a, b in zip(c, p, strict=True)]
        logs = []
        for x, q in zip(names, p, strict=True):
            v = mean[i][x] * min(len(t), 60) + math.log(q)
            for stated, share in zip((said, address), right, strict=True):
                if stated in names:
                    v += math.log(share if stated == x else (1 - share) / (len(names) - 1))
            logs.append(v)
        best = max(logs)
        out.append((names[logs.index(best)], 1 / sum(math.exp(v - best) for v in logs)))
    return out


def spelling(docs):
    """docs: (id, text) -> {word: (form, root, n, n_near, form_n)}"""
    counts, by, near = defaultdict(int), defaultdict(set), defaultdict(set)
    for i, text in docs:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    for w in n:
        for p in range(len(w) + 1):
            by[w[:p] + "*" + w[p:]].add(w)
            if p < len(w):
                by[w[:p] + "*" + w[p + 1 :]].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def whitened(rows, k=4):
    """rows: (id, vector) -> (ids, n, deviations, whitened, explained) by LAPACK's eigenvectors of the covariance."""
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(256 * np.array([v for _, v in rows], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    covariance = (fit - s / n).T @ (fit - s / n) / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviations = [int(((n * r - s).astype(object) ** 2).sum()) for r in x]
    return [i for i, _ in rows], n, deviations, (x - s / n) @ v / np.sqrt(e), e / np.trace(covariance)


def lines_kept(docs, least=40, documents=5):
    """docs: (id, text) -> [(id, n_lines, n_dropped, text)]"""
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, text in docs:
        for k in map(key, (text or "").split("\n")):
            if len(k) >= least:
                holders[k].add(-math.inf if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < documents or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _logistic(x, y, weight, penalty=1e-2):
    """(weights, offset) on raw columns, by many plain Newton steps on columns standardised by `scale`."""
    w = np.zeros(x.shape[1] + 1)
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag(np.r_[np.full(x.shape[1], penalty), 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + ridge, z.T @ (weight * (p - y)) / weight.sum() + ridge @ w)
    return w


def cotrained(train, y, pool, q):
    """Both views' classifiers after q.ROUNDS, all rows in memory."""
    scale = [(x.mean(axis=0), np.where(x.std(axis=0) < 1e-9, np.inf, x.std(axis=0))) for x in train]
    z = [(x - c) / s for x, (c, s) in zip(train, scale, strict=True)]
    pz = [(x - c) / s for x, (c, s) in zip(pool, scale, strict=True)]
    ones = np.ones(len(y))
    w = [_logistic(x, y, ones) for x in z]
    for _ in range(q.ROUNDS):
        said = []
        for v in (0, 1):
            m = np.clip(pz[v] @ w[v][:-1] + w[v][-1], -30, 30)
            order = np.sort(np.floor(m * 1000))
            n, good, edge = len(m), y.mean(), math.floor(1000 * math.log(q.SURE / (1 - q.SURE)))
            low = max(order[max(1, round(n * q.SHARE * (1 - good))) - 1], math.floor(-1000 * math.log(q.SURE / (1 - q.SURE))))
            high = min(order[-max(1, round(n * q.SHARE * good))], edge)
            bad, fine = np.floor(m * 1000) <= low, np.floor(m * 1000) >= high
            said.append((bad != fine, fine))
        w = []
        for v in (0, 1):
            some, label = said[1 - v]
            each = min(q.PSEUDO_WEIGHT, q.PSEUDO_SHARE * len(y) / max(1, some.sum()))
            w.append(_logistic(np.vstack([z[v], pz[v][some]]), np.r_[y, label[some]], np.r_[ones, np.full(some.sum(), each)]))
    return [q.raw(x, *s) for x, s in zip(w, scale, strict=True)]
