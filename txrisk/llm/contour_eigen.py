"""Largest eigenpairs of a symmetric matrix by contour integration (the FEAST method).

The matrix is small (dimensions of a vector, never rows of a table). Inertia counts say
how many eigenvalues lie below a shift. They place the cuts between intervals, and they
say afterwards how many eigenpairs each interval must have given.
"""

from __future__ import annotations

import numpy as np

#: Gauss points on the upper half of each contour, and the most passes over a contour.
POINTS, PASSES = 8, 40
#: Eigenvalues of one interval differ by this factor at most, unless no gap parts them.
SPREAD = 4.0


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of an orthogonally similar matrix, by Householder steps."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, side: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia counts: for each shift, how many eigenvalues lie below it.

    The matrix less the shift is congruent to a diagonal one (its LDL' form), so both have
    equally many negative eigenvalues.
    """
    shifts = np.asarray(shifts, dtype=float)
    tiny = np.finfo(float).tiny ** 0.5 * max(1.0, float(np.abs(side).max(initial=0.0)))
    pivot, count = diagonal[0] - shifts, np.zeros(len(shifts), dtype=np.int64)
    for k in range(len(diagonal)):
        if k:
            pivot = diagonal[k] - shifts - side[k - 1] ** 2 / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def _levels(diagonal: np.ndarray, side: np.ndarray, wanted: int, top: float, tolerance: float) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, each within the tolerance, by bisection."""
    ranks = len(diagonal) - 1 - np.arange(wanted)
    low, high = np.full(wanted, -top), np.full(wanted, top)
    while (high - low).max() > tolerance:
        middle = (low + high) / 2
        over = below(diagonal, side, middle) > ranks
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return (low + high) / 2


def _intervals(levels: np.ndarray, k: int, top: float, tolerance: float) -> list[tuple[float, float]]:
    """Intervals (low, high) that together hold the k largest levels, cut in the middle of gaps."""
    gaps = levels[:-1] - levels[1:] if len(levels) > 1 else np.zeros(0)
    high, first, found = top, 0, []
    while first < k:
        last = first
        while last + 1 < k and levels[last + 1] * SPREAD > levels[first] > 0:
            last += 1
        # the cut goes into the widest gap from here on; close levels stay together
        choices = range(last, len(levels) - 1)
        cut = max(choices, key=lambda j: (gaps[j] > 4 * tolerance, -j), default=None)
        if cut is None or gaps[cut] <= 4 * tolerance:
            last, low = len(levels) - 1, -top
        else:
            last, low = cut, (levels[cut] + levels[cut + 1]) / 2
        found.append((low, high))
        first, high = last + 1, low
    return found


def _contour(matrix: np.ndarray, low: float, high: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs inside (low, high): filtered subspaces, Rayleigh-Ritz, until they settle."""
    d, scale = len(matrix), max(float(np.abs(matrix).max()), np.finfo(float).tiny)
    size = min(d, wanted + max(4, wanted // 2))
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - points)  # the lower half mirrors the upper one
    turns = np.exp(1j * angles)
    space = np.linalg.qr(np.random.default_rng(13).standard_normal((d, size)))[0]
    best = None
    for _ in range(PASSES):
        filtered = np.zeros_like(space)
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((middle + radius * turn) * np.eye(d) - matrix, space.astype(complex))
            filtered += weight / 2 * np.real(radius * turn * solved)
        basis = np.linalg.qr(filtered)[0]
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        space = basis @ inner
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(matrix @ space - space * values, axis=0)[inside].max(initial=0.0) / scale
        if inside.sum() == wanted and (best is None or residual < best[0]):
            stale = best is not None and residual > best[0] / 4
            best = (residual, values[inside], space[:, inside])
            if residual < 1e-12 and stale:
                break
        elif best is not None and best[0] < 1e-12:
            break
        elif inside.sum() != wanted and size < d:
            size = min(d, 2 * size)
            fresh = np.random.default_rng(size).standard_normal((d, size - space.shape[1]))
            space = np.linalg.qr(np.hstack([space, fresh]))[0]
    if best is None or best[0] > 1e-9:
        raise ArithmeticError(f"{wanted} eigenvalues lie between {low} and {high}, but the contour did not give them")
    return best[1], best[2]


def largest_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns.

    Each vector's entry of the greatest size is positive. Fewer than k pairs come out if
    the matrix has fewer rows. The values of every interval are as many as the inertia
    counts at its ends say; otherwise an error is raised.
    """
    matrix = (np.asarray(matrix, dtype=float) + np.asarray(matrix, dtype=float).T) / 2
    d = len(matrix)
    k = min(k, d)
    if k == 0:
        return np.zeros(0), np.zeros((d, 0))
    bound = float(np.abs(matrix).sum(axis=1).max())
    if bound == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    matrix = matrix / bound  # eigenvalues now lie in [-1, 1]
    top, tolerance = 1 + 2.0**-20, 1e-7
    diagonal, side = tridiagonal(matrix)
    levels = _levels(diagonal, side, min(d, 2 * k + 4), top, tolerance)
    values, vectors = [], []
    for low, high in _intervals(levels, k, top, tolerance):
        ends = below(diagonal, side, np.array([low, high]))
        found, columns = _contour(matrix, low, high, int(ends[1] - ends[0]))
        values.append(found)
        vectors.append(columns)
    # one more Rayleigh-Ritz step makes the intervals' vectors orthogonal to each other
    basis = np.linalg.qr(np.hstack(vectors))[0]
    found, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-found)[:k]
    columns = (basis @ inner)[:, order]
    largest = columns[np.abs(columns).argmax(axis=0), np.arange(k)]
    return found[order] * bound, columns * np.where(largest < 0, -1.0, 1.0)
