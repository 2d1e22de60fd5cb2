"""Singular values and right singular vectors of a small square matrix (operator 13).

``bidiagonalise`` turns R into ``U B V'`` with Householder reflections, ``singular_squares`` finds the squares of
B's singular values by dqds sweeps, ``directions`` finds eigenvectors of ``B'B`` by twisted factorisations.  All
work is on d x d numbers, d being the dimension of the vectors, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, beta, alpha`` with ``(I - beta v v') x = alpha e1``."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0, 0.0
    alpha = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal ``a``, upper diagonal ``b`` and orthogonal V with ``R'R = V B'B V'``."""
    m = np.array(r, dtype=float)
    d = m.shape[0]
    right = np.eye(d)
    a, b = np.zeros(d), np.zeros(max(d - 1, 0))
    for i in range(d):
        v, beta, a[i] = _reflector(m[i:, i])
        m[i:, i:] -= beta * np.outer(v, v @ m[i:, i:])
        if i + 1 < d:
            v, beta, b[i] = _reflector(m[i, i + 1:])
            m[i:, i + 1:] -= beta * np.outer(m[i:, i + 1:] @ v, v)
            right[:, i + 1:] -= beta * np.outer(right[:, i + 1:] @ v, v)
    return a, b, right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform, or None where the shift exceeds the least eigenvalue."""
    n = len(q)
    q2, e2 = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    low = d
    for i in range(n - 1):
        if d < 0.0:
            return None
        q2[i] = d + e[i]
        t = q[i + 1] / q2[i] if q2[i] > 0.0 else 0.0
        e2[i] = e[i] * t
        d = d * t - shift
        low = min(low, d)
    if d < 0.0:
        return None
    q2[n - 1] = d
    return q2, e2, low


def _least_of_pair(q1: float, e1: float, q2: float) -> tuple[float, float]:
    """Eigenvalues of the 2 x 2 qd array, larger first."""
    high = 0.5 * (q1 + q2 + e1) + float(np.hypot(0.5 * ((q1 - q2) + e1), np.sqrt(e1) * np.sqrt(q2)))
    return high, (q1 / high) * q2 if high > 0 else 0.0


def singular_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling."""
    scale = max(float(np.max(np.abs(a), initial=0.0)), float(np.max(np.abs(b), initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(a))
    found: list[float] = []
    work = [([float(x / scale) ** 2 for x in a], [float(x / scale) ** 2 for x in b], 0.0)]
    while work:
        q, e, sigma = work.pop()
        while len(q) > 2:
            n = len(q)
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= (EPS * EPS) * (sigma + q[i + 1]) or e[i] <= EPS * EPS * q[i]), None)
            if cut == n - 2:
                found.append(q[-1] + sigma)
                q, e = q[:-1], e[:-1]
                continue
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # graded the other way: the array of the reversed bidiagonal converges sooner
                q, e = q[::-1], e[::-1]
            shift = _least_of_pair(q[-2], e[-1], q[-1])[1] * (1 - 4 * EPS)
            step = None
            while step is None:
                step = _sweep(q, e, shift)
                if step is None:  # beyond the least eigenvalue: a smaller shift, at last none
                    shift = shift / 4 if shift > EPS * (sigma + q[-1]) else 0.0
            q, e = step[0], step[1]
            sigma += shift
        if len(q) == 2:
            found += [x + sigma for x in _least_of_pair(q[0], e[0], q[1])]
        else:
            found += [x + sigma for x in q]
    return np.array(sorted(found, reverse=True)) * scale * scale


def _twisted(d: np.ndarray, l: np.ndarray, value: float, tiny: float) -> np.ndarray:
    """Unit vector z with ``(L D L' - value) z`` least, from the twisted factorisation of least pivot."""
    n = len(d)
    s, down = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    p, up = np.empty(n), np.empty(max(n - 1, 0))
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * l[i] * l[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        t = d[i] / pivot
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: orthonormal eigenvectors of ``B'B`` for its ``values`` (falling).

    A vector that nearly repeats those of close values is found anew by inverse iteration beside them.
    """
    n = len(a)
    scale = max(float(np.max(np.abs(a))), float(np.max(np.abs(b), initial=0.0)))
    floor = EPS * scale
    a = np.where(np.abs(a) > floor, a, floor)
    l, d = b / a[:-1], a * a
    t = np.diag(d)
    t[np.arange(1, n), np.arange(1, n)] += b * b
    t[np.arange(n - 1), np.arange(1, n)] = t[np.arange(1, n), np.arange(n - 1)] = a[:-1] * b
    out = np.zeros((n, len(values)))
    rng = np.random.default_rng(0)
    for j, value in enumerate(values):
        near = [i for i in range(j) if values[i] - value <= 1e-3 * values[i]]
        beside = out[:, near]
        z = _twisted(d, l, float(value), floor * floor)
        z = z - beside @ (beside.T @ z)
        tries = 0
        while near and (np.linalg.norm(z) < 0.5 or tries == 0):
            z = rng.standard_normal(n) if np.linalg.norm(z) < 0.5 else z
            for _ in range(3):
                z = z - beside @ (beside.T @ z)
                z = np.linalg.solve(t - (value + 4 * EPS * values[0] * (1 + tries)) * np.eye(n), z / np.linalg.norm(z))
                z /= np.linalg.norm(z)
            z = z - beside @ (beside.T @ z)
            tries += 1
        z = z - beside @ (beside.T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out
