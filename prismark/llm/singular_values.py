"""Singular values and right singular vectors of a small square matrix: Householder bidiagonalisation, dqds, twisted factorisations.

The matrix is the triangular factor of a tall one, so its size is that of a row, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Relative distance below which neighbouring values count as a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, b) with (I - b v v') x a multiple of the first unit vector."""
    v, size = x.astype(float).copy(), np.abs(x).max(initial=0.0)
    if size == 0:
        return v, 0.0
    v /= size
    length = np.sqrt(v @ v)
    v[0] += np.copysign(length, v[0])
    return v, 2 / (v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of U' r V upper bidiagonal."""
    b, d = r.astype(float).copy(), r.shape[1]
    right = np.eye(d)
    for k in range(d):
        v, f = reflector(b[k:, k])
        b[k:, k:] -= f * np.outer(v, v @ b[k:, k:])
        if k < d - 2:
            v, f = reflector(b[k, k + 1 :])
            b[k:, k + 1 :] -= f * np.outer(b[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= f * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential quotient-difference transform with shift; None if the shift was above the smallest value."""
    d, qq, ee = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        up = d + e[i]
        t = q[i + 1] / up if up else 0.0
        qq.append(up)
        ee.append(e[i] * t)
        d = d * t - shift
    if d < 0:
        return None
    return [*qq, d], ee


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix (a, b), each to high relative accuracy, largest first."""
    blocks: list[tuple[list[float], list[float], float]] = [((a * a).tolist(), (b * b).tolist(), 0.0)]
    out: list[float] = []
    while blocks:
        q, e, done = blocks.pop()
        while q:
            if len(q) == 1:
                out.append(done + q[0])
                break
            tiny = EPS * EPS * 1e2
            if e[-1] <= tiny * (done + q[-1]) or e[-1] == 0:
                out.append(done + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1) if e[i] <= tiny * min(done + q[i], done + q[i + 1]) or e[i] == 0), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], done))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # turned over, so that small values come last
                q, e = q[::-1], e[::-1]
            # The smaller value of the last two rows is above the smallest of all; a part of it, or none, is below.
            x, y, z = q[-2] + e[-2] if len(e) > 1 else q[-2], q[-1] + e[-1], q[-2] * e[-1]
            low = (x * y - z) / ((x + y) / 2 + np.hypot((x - y) / 2, np.sqrt(z))) if x + y else 0.0
            shift, now = max(0.0, min(low, q[-1])), None
            for part in (1 - 1e-8, 0.75, 0.25, 0.0):
                now = _dqds(q, e, shift * part)
                if now is not None:
                    done += shift * part
                    break
            q, e = now
    return np.sort(np.array(out))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit vector of B'B for one of its values: factored from both ends, put together where they fit best."""
    n, q, e, off = len(a), a * a, b * b, a[:-1] * b
    tiny = EPS * EPS * max(q.max(initial=0.0), e.max(initial=0.0), 1e-290)
    down, up, s, p = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        down[i] = (s[i] + q[i]) or tiny
        s[i + 1] = e[i] * (s[i] / down[i]) - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = (e[i] + p[i + 1]) or tiny
        p[i] = q[i] * (p[i + 1] / up[i + 1]) - value
    gamma = np.abs(s + p + value)
    r = int(np.nanargmin(gamma))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -(off[i] / down[i]) * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -(off[i] / up[i + 1]) * z[i]
    z /= np.abs(z).max()
    return z / np.sqrt(z @ z)


def _blocks(a: np.ndarray, b: np.ndarray) -> list[slice]:
    """Where the bidiagonal matrix falls apart."""
    limit = EPS * max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    ends = [*(np.flatnonzero(np.abs(b) <= limit) + 1).tolist(), len(a)]
    return [slice(i, j) for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(the largest squared singular values of a square matrix, their right vectors as columns, sum of all squared values)."""
    size = np.abs(r).max(initial=0.0)
    d = r.shape[1]
    if size == 0:
        return np.zeros(count), np.eye(d)[:, :count], 0.0
    a, b, right = bidiagonal(r / size)
    found = []
    for part in _blocks(a, b):
        values = squared_values(a[part], b[part.start : part.stop - 1])
        found += [(v, k, part) for k, v in enumerate(values)]
    total = sum(v for v, *_ in found)
    found = sorted(found, key=lambda x: -x[0])
    z, values = np.zeros((d, 0)), []
    for v, _, part in found[:count]:
        one = np.zeros(d)
        one[part] = twisted(a[part], b[part.start : part.stop - 1], v)
        near = [i for i, w in enumerate(values) if w - v <= CLUSTER * w]
        for attempt in range(4):
            beside = one - z[:, near] @ (z[:, near].T @ one)
            left = np.sqrt(beside @ beside)
            if left > 0.1 or not near:
                break
            # The vectors of a cluster have fallen together: one at right angles to those found, drawn to the cluster by inverse iteration.
            gram = np.diag(a * a) + np.diag(np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
            off = gram - (v + 1e-12 * found[0][0]) * np.eye(d)
            one = np.cos(np.arange(1.0, d + 1) * (attempt + 1))
            for _ in range(4):
                one -= z @ (z.T @ one)
                one = np.linalg.solve(off, one / np.sqrt(one @ one))
            one /= np.sqrt(one @ one)
        one = beside / left
        one -= z[:, near] @ (z[:, near].T @ one)
        z, values = np.column_stack([z, one / np.sqrt(one @ one)]), [*values, v]
    return np.array(values) * size**2, right @ z, total * size**2
