"""Singular values and directions of a small matrix by quotient differences.

``directions(r)``: Householder reflections bring R to an upper bidiagonal B;
dqds (differential quotient-difference steps with shifts) finds the squares of
its singular values; twisted factorisations of B'B - s give a direction for each
value, which the reflections carry back. All of it is on one d x d matrix, d being
the number of dimensions of a vector.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: An e that is this small beside the numbers next to it counts as zero.
NEGLIGIBLE = EPS * EPS
#: Values closer than this (relatively) have their directions made orthogonal.
CLOSE = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right reflections V of R = U B V'."""
    a = np.array(r, float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x):
        """The unit vector u with (I - 2 u u') x along the first axis."""
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not np.abs(x[1:]).any():
            return None
        u = x / scale
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(a[k:, k].copy())
        if u is not None:
            a[k:, k:] -= np.outer(2 * u, u @ a[k:, k:])
        if k < d - 2:
            u = reflector(a[k, k + 1 :].copy())
            if u is not None:
                a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ (2 * u), u)
                v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ (2 * u), u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of the bidiagonal matrix whose squared
    entries are q (diagonal) and e (above it), in no order.

    Every round runs one step without a shift to see its pivots p: the least
    value lies between 1 / sum(1 / p) and min(p). The lower end is the next
    shift, so no step meets a negative pivot but by rounding; then the shift is
    lessened. An e that becomes negligible splits the matrix.
    """
    found = []
    todo = [(list(q), list(e), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while q:
            n = len(q)
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= NEGLIGIBLE * (moved + q[k + 1]) or e[k] <= NEGLIGIBLE * q[k]), None)
            if cut is not None and cut < n - 2:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if n == 1 or cut == n - 2:
                found.append(moved + q.pop())
                if e:
                    e.pop()
                continue
            _, _, pivots = _step(q, e, 0.0)
            least = min(pivots)
            shift = 0.0 if least <= 0 else min(least, 1.0 / sum(1.0 / p for p in pivots)) * (1 - 4 * EPS * n)
            while True:
                q2, e2, pivots = _step(q, e, shift)
                if shift == 0 or min(pivots) >= 0:
                    break
                shift = 0.0 if shift < EPS * q[0] else shift * 0.75
            q, e, moved = q2, e2, moved + shift
    return found


def _step(q, e, shift):
    """One differential step: the new q and e, and its pivots."""
    n = len(q)
    p = q[0] - shift
    q2, e2, pivots = [0.0] * n, [0.0] * (n - 1), [p]
    for k in range(n - 1):
        q2[k] = p + e[k]
        t = q[k + 1] / q2[k] if q2[k] else 0.0
        e2[k] = e[k] * t
        p = p * t - shift
        pivots.append(p)
    q2[n - 1] = p if shift else max(p, 0.0)
    return q2, e2, pivots


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, choice: int = 0) -> np.ndarray:
    """A unit vector z with B'B z = value z, from the two triangular
    factorisations of B'B - value, joined where they leave the least."""
    n, scale = len(diagonal), max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    safe = np.where(np.abs(diagonal) < EPS * scale, EPS * scale, diagonal)
    q, low = safe * safe, upper / safe[:-1]
    tiny = EPS * EPS * scale * scale
    down, up, s, p = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0)), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        down[i] = q[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = q[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        t = q[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    at = int(np.argsort(np.abs(s + p + value), kind="stable")[min(choice, n - 1)])
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _blocks(diagonal, upper):
    """Ranges of B between upper entries that count as zero."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    start = 0
    for k in range(len(upper)):
        if abs(upper[k]) <= EPS * max(min(abs(diagonal[k]), abs(diagonal[k + 1])), EPS * scale):
            yield start, k + 1
            start = k + 1
    yield start, len(diagonal)


def directions(r: np.ndarray, most: int, floor: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest squared singular values of R, falling, and their
    right singular vectors as columns. Values up to ``floor`` of their sum are
    rounding and left out."""
    diagonal, upper, v = bidiagonalise(r)
    pairs = []  # (value, block, place in the block)
    blocks = list(_blocks(diagonal, upper))
    for b, (i, j) in enumerate(blocks):
        values = sorted(dqds([x * x for x in diagonal[i:j].tolist()], [x * x for x in upper[i : j - 1].tolist()]), reverse=True)
        pairs += [(x, b) for x in values]
    least = floor * sum(x for x, _ in pairs)
    pairs = sorted((x for x in pairs if x[0] > least), key=lambda x: (-x[0], x[1]))[:most]
    columns, near = [], {}
    for value, b in pairs:
        i, j = blocks[b]
        held = [z for other, z in near.get(b, []) if abs(other - value) <= CLOSE * max(other, value)]
        best = None
        for choice in range(j - i if held else 1):
            z = twisted(diagonal[i:j], upper[i : j - 1], value, choice)
            for _ in range(2):
                for other in held:
                    z = z - other * (other @ z)
            left = np.linalg.norm(z)
            if best is None or left > best[0]:
                best = (left, z / left if left else z)
            if left > 0.5:
                break
        near.setdefault(b, []).append((value, best[1]))
        whole = np.zeros(len(diagonal))
        whole[i:j] = best[1]
        columns.append(v @ whole)
    return np.array([x for x, _ in pairs]), np.array(columns).T.reshape(len(diagonal), len(pairs))
