"""Small dense matrices and filters that the operators share: made once per spectrum length, applied to whole batches."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np

MODES = ("nearest", "constant", "reflect", "mirror", "wrap")


def edge_places(n: int, left: int, right: int, mode: str) -> np.ndarray:
    """For each place of the padded axis the place it takes its value from, -1 for a constant."""
    i = np.arange(-left, n + right)
    if mode == "nearest":
        return np.clip(i, 0, n - 1)
    if mode == "wrap":
        return i % n
    if mode == "reflect":
        k = i % (2 * n)
        return np.where(k < n, k, 2 * n - 1 - k)
    if mode == "mirror":
        k = i % max(2 * n - 2, 1)
        return np.where(k < n, k, 2 * n - 2 - k)
    if mode == "constant":
        return np.where((i >= 0) & (i < n), i, -1)
    raise ValueError(f"unknown mode {mode!r}")


def correlate(x: np.ndarray, weights: np.ndarray, left: int, mode: str, cval: float = 0.0) -> np.ndarray:
    """sum_k weights[k] * x[i - left + k] along the rows of x, padded by mode."""
    n, w = x.shape[1], len(weights)
    at = edge_places(n, left, w - 1 - left, mode)
    full = x[:, at]
    if mode == "constant":
        full = np.where(at < 0, cval, full)
    out = np.zeros_like(x)
    for k, c in enumerate(weights):  # a number each, or a column with a number for each row
        if np.any(c):
            out += c * full[:, k : k + n]
    return out


@functools.lru_cache(maxsize=64)
def savgol_weights(window: int, order: int, deriv: int) -> np.ndarray:
    """Correlation weights of the least-squares polynomial's derivative at the window's centre."""
    if window % 2 == 0 or window < 1:
        raise ValueError("window_size must be odd and positive")
    if order >= window:
        raise ValueError("polynomial_order must be less than window_size")
    if deriv > order:
        return np.zeros(window)
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1.0), order + 1, increasing=True)
    return np.linalg.pinv(powers)[deriv] * math.factorial(deriv)


def savgol(x: np.ndarray, window: int, order: int, deriv: int, mode: str) -> np.ndarray:
    """`interp` fits one polynomial to each end's window; the other modes pad."""
    weights, half, n = savgol_weights(window, order, deriv), window // 2, x.shape[1]
    if mode != "interp":
        return correlate(x, weights, half, mode)
    if window > n:
        raise ValueError("with mode interp, window_size must not exceed the number of points")
    out = correlate(x, weights, half, "nearest")
    places = np.arange(window) - (window - 1) / 2
    powers = np.vander(places, order + 1, increasing=True)
    back = np.linalg.pinv(powers)
    rise = np.zeros((window, order + 1))
    for k in range(deriv, order + 1):
        rise[:, k] = math.factorial(k) / math.factorial(k - deriv) * places ** (k - deriv)
    ends = rise @ back
    out[:, :half] = x[:, :window] @ ends[:half].T
    if half:
        out[:, -half:] = x[:, -window:] @ ends[-half:].T
    return out


@functools.lru_cache(maxsize=64)
def differences(n: int, order: int) -> np.ndarray:
    """Bands of D'D for the difference matrix of an order: row k holds the k-th superdiagonal."""
    d = np.diff(np.eye(n), order, axis=0) if n <= 400 else None
    if d is not None:
        g = d.T @ d
        return np.stack([np.append(np.diagonal(g, k), np.zeros(k)) for k in range(order + 1)])
    c = np.diff(np.eye(order + 1), order, axis=0)[0]
    bands = np.zeros((order + 1, n))
    for r in range(n - order):
        for k in range(order + 1):
            for a in range(order + 1 - k):
                bands[k, r + a] += c[a] * c[a + k]
    return bands


def solve_banded(bands: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Symmetric positive systems, one for each row of rhs: bands[k, row, i] = A[i, i + k]; LDL' without pivoting."""
    m = bands.shape[0] - 1
    rows, n = rhs.shape
    d = np.empty((n, rows))
    low = np.zeros((m + 1, n, rows))  # low[k, i] = L[i, i - k]
    z = np.ascontiguousarray(rhs.T, np.float64).copy()
    band = np.ascontiguousarray(np.moveaxis(np.broadcast_to(bands, (m + 1, rows, n)), 2, 1))
    for i in range(n):
        for k in range(min(m, i), 0, -1):
            j = i - k
            v = band[k, j].copy()
            for t in range(1, min(m - k, j) + 1):
                v -= low[k + t, i] * low[t, j] * d[j - t]
            low[k, i] = v / d[j]
        v = band[0, i].copy()
        for k in range(1, min(m, i) + 1):
            v -= low[k, i] ** 2 * d[i - k]
        d[i] = v
        for k in range(1, min(m, i) + 1):
            z[i] -= low[k, i] * z[i - k]
    z /= d
    for i in range(n - 1, -1, -1):
        for k in range(1, min(m, n - 1 - i) + 1):
            z[i] -= low[k, i + k] * z[i + k]
    return z.T


@functools.lru_cache(maxsize=16)
def whittaker_inverse(n: int, lam: float, order: int) -> np.ndarray:
    """(I + lam D'D)^-1 for moderate n."""
    d = np.diff(np.eye(n), order, axis=0)
    return np.linalg.inv(np.eye(n) + lam * (d.T @ d))


def whittaker(x: np.ndarray, lam: float, order: int) -> np.ndarray:
    n = x.shape[1]
    if n <= 600:
        return x @ whittaker_inverse(n, lam, order)
    bands = lam * differences(n, order)
    bands[0] += 1
    return solve_banded(bands[:, None, :], x)


@functools.lru_cache(maxsize=16)
def polynomial_baseline(n: int, order: int, indices: tuple[int, ...]) -> np.ndarray:
    """M with x @ M the least-squares polynomial through x[indices] at all places; on an orthogonal basis."""
    at = np.array(indices) if indices else np.arange(n)
    t = 2 * np.arange(n) / max(n - 1, 1) - 1.0
    basis = np.polynomial.legendre.legvander(t, order)
    out = np.zeros((n, n))
    np.add.at(out, at, (basis @ np.linalg.pinv(basis[at])).T)
    return out


def spline_basis(knots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """B with B @ values the not-a-knot cubic spline through (knots, values) at the places `at`, extrapolating its end pieces."""
    k = len(knots)
    if k < 2 or np.any(np.diff(knots) <= 0):
        raise ValueError("a spline needs two or more strictly increasing places")
    if k <= 3:  # a line or a parabola
        powers = np.vander(knots - knots[0], k, increasing=True)
        return np.vander(at - knots[0], k, increasing=True) @ np.linalg.inv(powers)
    h = np.diff(knots).astype(float)
    a, b = np.zeros((k, k)), np.zeros((k, k))  # a @ second derivatives = b @ values
    for i in range(1, k - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    second = np.linalg.solve(a, b)
    j = np.clip(np.searchsorted(knots, at, side="right") - 1, 0, k - 2)
    left, right, w = at - knots[j], knots[j + 1] - at, h[j]
    eye = np.eye(k)
    curve = (right**3 / (6 * w) - w * right / 6)[:, None] * second[j] + (left**3 / (6 * w) - w * left / 6)[:, None] * second[j + 1]
    return curve + (right / w)[:, None] * eye[j] + (left / w)[:, None] * eye[j + 1]


@functools.lru_cache(maxsize=16)
def _unit_curvature(n: int) -> np.ndarray:
    """M with x @ M the second derivatives, at all places 0 .. n - 1, of the not-a-knot spline through x there."""
    a = np.zeros((n, n))
    second = np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        second[i, i - 1 : i + 2] = 6, -12, 6
    a[0, :3] = a[-1, -3:] = 1, -2, 1
    return np.linalg.solve(a, second).T


def _swept_curvature(x: np.ndarray) -> np.ndarray:
    """The same for long rows, by elimination along the places for all rows at once; the ends continue the line of the next two."""
    rhs = 6 * (x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]).T
    k = len(rhs)
    d, up, low = np.full(k, 4.0), np.ones(k), np.ones(k)
    d[0] = d[-1] = 6.0
    up[0] = low[-1] = 0.0
    for i in range(1, k):
        f = low[i] / d[i - 1]
        d[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    m = np.empty((k + 2, len(x)))
    m[k] = rhs[-1] / d[-1]
    for i in range(k - 2, -1, -1):
        m[i + 1] = (rhs[i] - up[i] * m[i + 2]) / d[i]
    m[0], m[-1] = 2 * m[1] - m[2], 2 * m[-2] - m[-3]
    return m.T


def unit_spline(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The not-a-knot cubic spline through each row of x at places 0 .. n - 1, at the row's places `at`; end pieces go on outside."""
    n = x.shape[1]
    if n <= 3:
        return np.stack([spline_basis(np.arange(float(n)), p) @ row for row, p in zip(x, at, strict=True)]) if len(x) else x
    m = x @ _unit_curvature(n) if n <= 400 else _swept_curvature(x)
    j = np.clip(np.floor(at).astype(int), 0, n - 2)
    a, b = j + 1 - at, at - j
    of = lambda v, k: np.take_along_axis(v, k, axis=1)
    return a * of(x, j) + b * of(x, j + 1) + ((a**3 - a) * of(m, j) + (b**3 - b) * of(m, j + 1)) / 6


@functools.lru_cache(maxsize=16)
def spline_baseline(n: int, indices: tuple[int, ...]) -> np.ndarray:
    """M with x @ M the spline through x[indices] at all places."""
    at = np.array(indices if indices else (0, n - 1)) % n
    out = np.zeros((n, n))
    out[at] = spline_basis(at.astype(float), np.arange(n, dtype=float)).T
    return out


# --- quantiles -----------------------------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_quantile(p: float, d1: float, d2: float) -> float:
    """By bisection on the beta variable."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, d1 / 2, d2 / 2) < p else (low, mid)
    x = (low + high) / 2
    return d2 * x / (d1 * (1 - x))


def chi2_two_quantile(p: float) -> float:
    """Of two degrees of freedom."""
    return -2 * math.log(1 - p)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def nearest_index(axis: list[float], target: float) -> int:
    """The first place whose value is nearest."""
    return int(np.argmin(np.abs(np.asarray(axis, float) - target)))


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!: exact sums for small k, Stirling's series beyond."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 200.0)))])
    k = np.asarray(k, float)
    z = np.maximum(k, 100.0) + 1
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(k < 200, small[np.minimum(k, 199).astype(int)], series)


def poisson_quantile(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """How many k have a distribution function of u or less: Poisson draws from uniform ones. Means must not be negative or NaN."""
    if not (mean >= 0).all():
        raise ValueError("Poisson noise needs values of 0 or more")
    reach = 12 * np.sqrt(mean) + 30
    first = np.floor(np.maximum(mean - reach, 0))
    last = np.ceil(mean + reach)
    log_mean = np.log(np.maximum(mean, 1e-300))
    below, k = np.zeros_like(mean), first.copy()
    drawn, open_ = first.copy(), np.ones(mean.shape, bool)
    while open_.any():
        below = below + np.exp(k * log_mean - mean - log_factorial(k))
        open_ &= (below <= u) & (k < last)
        drawn[open_] += 1
        k += 1
    return np.where(mean == 0, 0.0, drawn)
