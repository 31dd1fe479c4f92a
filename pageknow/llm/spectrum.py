"""Leading eigenpairs of a small symmetric matrix by spectrum slicing.

The pivots of the factors L D L' of A - s I have the signs of the eigenvalues less s, so one factorization counts the
eigenvalues above s. Counts at the midpoints of intervals isolate the leading eigenvalues; Rayleigh quotient iteration, which
converges cubically, then finds each in its interval; counts on both sides of what it found certify its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps
#: Of Bunch and Kaufman: when a diagonal entry is large enough to be a pivot.
ALPHA = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of ``a`` above ``shift``: the positive pivots of a symmetric elimination with pivots of one
    or two rows. A pivot of zero counts as not above."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        col = np.abs(m[1:, 0])
        r = int(col.argmax()) + 1 if len(col) else 0
        top = col[r - 1] if r else 0.0
        two = False
        if top and abs(m[0, 0]) < ALPHA * top:
            row = np.abs(m[r])
            row[r] = 0
            if abs(m[0, 0]) * row.max() < ALPHA * top * top:
                if abs(m[r, r]) >= ALPHA * row.max():
                    _swap(m, 0, r)
                else:
                    two = True
                    _swap(m, 1, r)
        if two:
            d, b = m[:2, :2], m[2:, :2]
            det, trace = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0], d[0, 0] + d[1, 1]
            above += 1 if det < 0 else 2 if trace > 0 else 0
            m = m[2:, 2:] - b @ np.linalg.solve(d, b.T) if len(b) else m[2:, 2:]
        else:
            d, b = m[0, 0], m[1:, 0]
            above += int(d > 0)
            m = m[1:, 1:] - np.outer(b, b / d) if d and len(b) else m[1:, 1:].copy()
    return above


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]


@dataclass
class Slice:
    """An interval with the numbers (from 1, by falling value) of the eigenvalues in it."""

    lo: float
    hi: float
    first: int
    last: int


def isolate(a: np.ndarray, k: int, least: float) -> list[Slice]:
    """Intervals with one of the ``k`` leading eigenvalues each, or no wider than ``least`` with several."""
    reach = float(np.abs(a).sum(axis=1).max()) * (1 + 8 * EPS) + np.finfo(float).tiny
    todo, done = [Slice(-reach, reach, 1, len(a))], []
    while todo:
        s = todo.pop()
        if s.first > k:
            continue
        if s.first == s.last or s.hi - s.lo <= least:
            done.append(s)
            continue
        mid = (s.lo + s.hi) / 2
        n = min(max(count_above(a, mid), s.first - 1), s.last)
        if n < s.last:
            todo.append(Slice(s.lo, mid, n + 1, s.last))
        if n >= s.first:
            todo.append(Slice(mid, s.hi, s.first, n))
    return sorted(done, key=lambda s: s.first)


def narrowed(a: np.ndarray, s: Slice) -> Slice:
    """Half of an interval with one eigenvalue."""
    mid = (s.lo + s.hi) / 2
    return Slice(mid, s.hi, s.first, s.last) if count_above(a, mid) >= s.first else Slice(s.lo, mid, s.first, s.last)


def _solve(a: np.ndarray, shift: float, x: np.ndarray, size: float) -> np.ndarray:
    try:
        y = np.linalg.solve(a - shift * np.eye(len(a)), x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        y = np.linalg.solve(a - (shift + 4 * EPS * size) * np.eye(len(a)), x)
    return y / np.linalg.norm(y)


def _apart(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    if found:
        q = np.array(found)
        for _ in range(2):
            x = x - q.T @ (q @ x)
    return x / np.linalg.norm(x)


def iterate(a: np.ndarray, s: Slice, found: list[np.ndarray], seed: int, size: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of a slice, kept apart from the vectors found; None if it leaves the slice or,
    by counts on both sides of the value, does not have the slice's number."""
    x = _apart(np.random.default_rng(seed).standard_normal(len(a)), found)
    shift = (s.lo + s.hi) / 2
    for _ in range(2):
        x = _apart(_solve(a, shift, x, size), found)
    best: tuple[float, float, np.ndarray] | None = None
    for _ in range(12):
        e = float(x @ a @ x)
        left = float(np.linalg.norm(a @ x - e * x))
        if best is None or left < best[0]:
            best = (left, e, x)
        elif left >= best[0] / 2:
            break
        if left <= EPS * size:
            break
        x = _apart(_solve(a, e, x, size), found)
    left, e, x = best
    wide = 64 * EPS * size * len(a) ** 0.5
    if left > wide or not s.lo - wide <= e <= s.hi + wide:
        return None
    return (e, x) if s.first != s.last or count_above(a, e + wide) < s.first <= count_above(a, e - wide) else None


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``k`` largest eigenvalues of a symmetric matrix, by falling value.

    Eigenvalues that agree to about 10^-12 of the largest share a slice; their vectors are kept orthogonal by projection. Raises
    ArithmeticError if the counts don't certify the numbering."""
    k = min(k, len(a))
    size = float(np.abs(a).max(initial=0.0)) * len(a)
    if not k or not size:
        return np.zeros(k), np.eye(len(a))[:, :k]
    found: list[np.ndarray] = []
    values: list[float] = []
    for s in isolate(a, k, 1e-12 * size):
        for n in range(s.first, s.last + 1):
            got, at = None, s
            while got is None:
                got = iterate(a, at, found, n, size)
                if got is None:
                    if at.hi - at.lo <= 16 * EPS * size or s.first != s.last:
                        raise ArithmeticError(f"no eigenpair found in [{at.lo}, {at.hi}]")
                    at = narrowed(a, at)
            values.append(got[0])
            found.append(got[1])
    e, q = np.array(values), np.array(found).T
    order = np.argsort(-e, kind="stable")[:k]
    e, q = e[order], q[:, order]
    certify(a, e, 1e-12 * size)
    return e, q


def certify(a: np.ndarray, e: np.ndarray, near: float) -> None:
    """Counts just above and below each run of eigenvalues that lie within ``near`` of each other."""
    ends = np.flatnonzero(np.append(e[:-1] - e[1:] > 4 * near, True))
    first = 0
    for last in ends:
        if count_above(a, e[first] + near) > first or count_above(a, e[last] - near) < last + 1:
            raise ArithmeticError(f"eigenvalue {first + 1} is not where it was found")
        first = last + 1
