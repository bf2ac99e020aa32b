"""Eigenvalues and vectors of a symmetric matrix: Householder tridiagonal form, then divide and conquer."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q @ T @ q.T = a."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size == 0:
            continue
        v *= np.sqrt(2 / size)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= v * (v @ p / 2)
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1 :, k] -= v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _merge(poles: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(poles) + rho * z z^T with rho > 0 and rising, distinct poles where z is not 0.

    Between two poles there is one root of 1 + rho * sum(z^2 / (pole - x)). It is bisected as a distance from the nearer
    pole, so that distances keep their leading digits; z is then made anew from the roots, which makes the vectors
    orthogonal however close the roots are.
    """
    n = len(poles)
    gaps = np.append(poles[1:], poles[-1] + rho * (z @ z) * (1 + 4 * EPS)) - poles
    middle = poles + gaps / 2
    left = 1 + rho * np.sum(z**2 / (poles - middle[:, None]), axis=1) >= 0
    left[-1] = True
    near = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    apart = poles - poles[near][:, None]  # [root, pole]
    low, high = np.where(left, 0.0, -gaps / 2), np.where(left, gaps / 2, 0.0)
    high[-1] = gaps[-1]
    for _ in range(2200):
        # halve the exponent while an end is 0 or the ends differ by much, then the distance
        step = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            below = 1 + rho * np.sum(z**2 / (apart - step[:, None]), axis=1) < 0
        low, high = np.where(below, step, low), np.where(below, high, step)
        if np.all(high - low <= EPS * np.maximum(np.abs(low), np.abs(high))):
            break
    shift = np.where(left, high, low)
    distance = apart - shift[:, None]  # pole - root, [root, pole]
    ratio = np.empty(n)
    for k in range(n):
        others = np.arange(n) != k
        ratio[k] = -distance[n - 1, k] * np.prod(distance[: n - 1, k] / (poles[k] - poles[others])) if n > 1 else -distance[0, 0]
    made = np.copysign(np.sqrt(np.abs(ratio) / rho), z)
    vectors = made / distance
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return poles[near] + shift, vectors.T


def _conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    cut = n // 2
    rho = abs(e[cut - 1])
    sign = 1.0 if e[cut - 1] >= 0 else -1.0
    first, second = d[:cut].copy(), d[cut:].copy()
    first[-1] -= rho
    second[0] -= rho
    (l1, q1), (l2, q2) = _conquer(first, e[: cut - 1]), _conquer(second, e[cut:])
    poles = np.concatenate([l1, l2])
    q = np.zeros((n, n))
    q[:cut, :cut], q[cut:, cut:] = q1, q2
    z = np.concatenate([q1[-1], sign * q2[0]])
    order = np.argsort(poles, kind="stable")
    poles, z, q = poles[order], z[order], q[:, order]
    scale = EPS * 8 * max(np.abs(poles).max(), rho)
    live: list[int] = []
    for k in range(n):
        if rho * abs(z[k]) <= scale:
            continue
        if live and poles[k] - poles[live[-1]] <= scale:  # equal poles: turn one's share of z into the other
            j = live.pop()
            size = np.hypot(z[j], z[k])
            c, s = z[k] / size, z[j] / size
            q[:, [j, k]] = q[:, [j, k]] @ np.array([[c, s], [-s, c]])
            poles[[j, k]] = c * c * poles[j] + s * s * poles[k], s * s * poles[j] + c * c * poles[k]
            z[j], z[k] = 0.0, size
        live.append(k)
    if live:
        ranked = sorted(live, key=lambda k: poles[k])
        values, vectors = _merge(poles[ranked], z[ranked], rho)
        poles[ranked], q[:, ranked] = values, q[:, ranked] @ vectors
    return poles, q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns)."""
    if not len(a):
        return np.empty(0), np.empty((0, 0))
    scale = np.abs(a).max() or 1.0
    d, e, q = tridiagonal(np.asarray(a, float) / scale)
    values, vectors = _conquer(d, e)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, (q @ vectors)[:, order]
