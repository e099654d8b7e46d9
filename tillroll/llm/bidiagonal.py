"""Singular values and right singular vectors of a small triangular factor.

Householder reflections bring the factor to bidiagonal form, dqds finds the squares of its singular
values to high relative accuracy, twisted factorisations of shifted L D L' forms give the vectors.
Values that lie close together get their vectors from a form shifted next to them, in which they
are far apart relatively.

The order is the number of dimensions, never that of rows; loops of order squared are plain Python.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Values nearer than this, relative to their size, are taken as a cluster.
CLOSE = 1e-3
#: How often a cluster may be shifted again.
DEPTH = 8


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta and the new first entry such that (I - beta v v') x has zeros below it."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0, float(x[0])
    first = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= first
    return v, 2.0 / float(v @ v), first


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of U' R V, and V."""
    work = np.array(r, dtype=np.float64)
    d = work.shape[1]
    v = np.eye(d)
    for k in range(d):
        h, beta, work[k, k] = _reflector(work[k:, k].copy())
        if beta:
            work[k:, k + 1 :] -= beta * np.outer(h, h @ work[k:, k + 1 :])
            work[k + 1 :, k] = 0.0
        if k + 1 < d:
            h, beta, first = _reflector(work[k, k + 1 :].copy())
            if beta:
                work[k + 1 :, k + 1 :] -= beta * np.outer(work[k + 1 :, k + 1 :] @ h, h)
                v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ h, h)
            work[k, k + 1] = first
            work[k, k + 2 :] = 0.0
    return np.diag(work).copy(), np.diag(work, 1).copy(), v


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd step; None if the shift passes the smallest value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return None
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0.0:
        return None
    new_q[n - 1] = d
    return new_q, new_e


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A bound that the smallest value surely reaches: with zero shift the reciprocals of the
    step's d sum to the trace of the inverse."""
    d, total = q[0], 0.0
    for i in range(len(q)):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        if i < len(e):
            d = d * (q[i + 1] / (d + e[i]))
    return 1.0 / total


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of a bidiagonal matrix, falling; q and e are the squares of
    its diagonal (none of them 0) and of its superdiagonal."""
    found: list[float] = []
    blocks = [(list(q), list(e), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while len(q) > 1:
            cut = next((i for i, x in enumerate(e) if x <= EPS * EPS * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = _lower_bound(q, e) * (1.0 - 4 * EPS * len(q))
            if moved + shift == moved:
                shift = 0.0
            step = _transform(q, e, shift)
            while step is None:  # rounding alone can let the bound pass the value
                shift = shift / 2 if shift > EPS * moved else 0.0
                step = _transform(q, e, shift)
            q, e = step
            moved += shift
        found.append(moved + q[0])
    return sorted(found, reverse=True)


class Form:
    """A tridiagonal matrix as L D L' with unit lower bidiagonal L."""

    def __init__(self, d: list[float], low: list[float]):
        self.d, self.low = d, low

    def _stationary(self, shift: float) -> tuple[list[float], list[float], list[float]]:
        """D and L of L D L' - shift, and the auxiliary s of each row."""
        n = len(self.d)
        new_d, new_low, aux = [0.0] * n, [0.0] * (n - 1), [0.0] * n
        s = -shift
        for i in range(n):
            aux[i] = s
            new_d[i] = (s + self.d[i]) or EPS * EPS * (abs(self.d[i]) + 1e-300)
            if i < n - 1:
                new_low[i] = self.d[i] * self.low[i] / new_d[i]
                s = new_low[i] * self.low[i] * s - shift
        return new_d, new_low, aux

    def shifted(self, shift: float) -> "Form":
        d, low, _ = self._stationary(shift)
        return Form(d, low)

    def below(self, shift: float) -> int:
        """How many eigenvalues lie under ``shift``."""
        return sum(x < 0.0 for x in self._stationary(shift)[0])

    def vector(self, value: float) -> np.ndarray:
        """The eigenvector of an eigenvalue, by the twisted factorisation with the smallest twist."""
        n = len(self.d)
        _, low, aux = self._stationary(value)
        up, back = [0.0] * (n - 1), [0.0] * n
        p = self.d[n - 1] - value
        back[n - 1] = p
        for i in range(n - 2, -1, -1):
            under = self.d[i] * self.low[i] * self.low[i] + p
            ratio = self.d[i] / (under or EPS * EPS * (abs(self.d[i]) + 1e-300))
            up[i] = self.low[i] * ratio
            p = p * ratio - value
            back[i] = p
        twist = min(range(n), key=lambda i: abs(aux[i] + back[i] + value))
        z = np.zeros(n)
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -low[i] * z[i + 1]
        for i in range(twist, n - 1):
            z[i + 1] = -up[i] * z[i]
        return z / np.linalg.norm(z)

    def solved(self, value: float, x: np.ndarray) -> np.ndarray:
        """A unit vector along the solution z of (L D L' - value) z = x."""
        d, low, _ = self._stationary(value)
        z = x.copy()
        for i in range(1, len(d)):
            z[i] -= low[i - 1] * z[i - 1]
        z /= np.array([y if abs(y) > EPS * abs(value) else EPS * abs(value) or EPS for y in d])
        for i in range(len(d) - 2, -1, -1):
            z[i] -= low[i] * z[i + 1]
        return z / np.linalg.norm(z)

    def refined(self, rank: int, guess: float, width: float) -> float:
        """The eigenvalue with ``rank`` smaller ones, by bisection from near ``guess``."""
        low, high = guess - width, guess + width
        while self.below(low) > rank:
            low -= width
            width *= 2
        while self.below(high) <= rank:
            high += width
            width *= 2
        for _ in range(200):
            middle = 0.5 * (low + high)
            if middle in (low, high) or high - low <= 2 * EPS * max(abs(low), abs(high)):
                break
            if self.below(middle) > rank:
                high = middle
            else:
                low = middle
        return 0.5 * (low + high)


def _vectors(form: Form, first: int, values: list[float], depth: int) -> list[np.ndarray]:
    """Eigenvectors for neighbouring rising eigenvalues, the first of which has ``first`` smaller ones."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[j + 1] - values[j] <= CLOSE * max(abs(values[j]), abs(values[j + 1])):
            j += 1
        cluster = values[i : j + 1]
        if len(cluster) == 1 or depth == DEPTH:
            out += [form.vector(value) for value in cluster]
        else:
            # next to the cluster, as far off as the cluster is wide
            size = max(map(abs, cluster))
            gap = max((cluster[-1] - cluster[0]) / len(cluster), 8 * EPS * size)
            origin = cluster[0] - gap
            child = form.shifted(origin)
            near = [
                child.refined(first + i + k, value - origin, 4 * EPS * size * len(form.d))
                for k, value in enumerate(cluster)
            ]
            out += _vectors(child, first + i, near, depth + 1)
        i = j + 1
    return out


def singular_pairs(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of a square matrix, falling, and the right singular vectors as columns.

    A singular value of 0 comes out as at most eps times the largest. Vectors of values that agree
    to the last bits are made orthogonal to each other."""
    a, b, v = bidiagonalise(r)
    d = len(a)
    scale = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(d), v
    a, b = a / scale, b / scale
    a[np.abs(a) < EPS * EPS] = EPS * EPS
    ends = [i + 1 for i in range(d - 1) if abs(b[i]) <= EPS * min(abs(a[i]), abs(a[i + 1]))] + [d]
    values, columns, origin, start = [], [], [], 0
    for end in ends:
        diagonal, above = a[start:end].tolist(), b[start : end - 1].tolist()
        squares = dqds([x * x for x in diagonal], [x * x for x in above])
        form = Form([x * x for x in diagonal], [y / x for x, y in zip(diagonal, above)])
        found = _vectors(form, 0, squares[::-1], 0)[::-1]
        for square, z in zip(squares, found):
            whole = np.zeros(d)
            whole[start:end] = z
            values.append(square)
            columns.append(whole)
            origin.append((form, start, end))
        start = end
    order = sorted(range(d), key=lambda i: -values[i])
    rng = np.random.default_rng(0)
    basis = np.zeros((d, d))
    for k, i in enumerate(order):
        taken = basis[:, :k]
        z = columns[i]
        left = z - taken @ (taken.T @ z)
        if np.linalg.norm(left) < 0.5:
            # equal to the last bits: inverse iteration in what the vectors before it leave
            form, start, end = origin[i]
            left = np.zeros(d)
            left[start:end] = rng.standard_normal(end - start)
            for _ in range(4):
                left -= taken @ (taken.T @ left)
                left[start:end] = form.solved(values[i], left[start:end])
            left -= taken @ (taken.T @ left)
        left -= taken @ (taken.T @ left)
        basis[:, k] = left / np.linalg.norm(left)
    return scale * np.sqrt(np.array([values[i] for i in order])), v @ basis
