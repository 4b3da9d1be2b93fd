"""Eigenvectors of symmetric matrices by QDWH spectral divide-and-conquer.

The polar factor U of A - shift has the eigenvectors of A, with eigenvalues -1 below the shift and +1 above. So
(U + I) / 2 projects onto the invariant subspace of the eigenvalues above the shift. Orthonormal bases of the two
subspaces split A into two smaller matrices, and so on down to single components. The polar
factor comes from the QR-based dynamically weighted Halley iteration, which needs no inverses and six steps at most
for any condition that double precision can hold.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Steps of the Halley iteration at most; six are enough from the smallest bound on.
STEPS = 12


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without zero eigenvalues."""
    n = len(a)
    size = np.linalg.norm(a)
    x, low, eye = a / size, EPS, np.eye(n)
    for _ in range(STEPS):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        h = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (h + b * low**2) / (1 + c * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _bases(projector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector of rank k, and of its complement, by subspace iteration."""
    n = len(projector)
    start = np.random.default_rng(n).standard_normal((n, n))
    upper, lower = projector @ start[:, :k], start[:, k:] - projector @ start[:, k:]
    for _ in range(2):
        upper, _ = np.linalg.qr(projector @ upper)
        lower, _ = np.linalg.qr(lower - projector @ lower)
    both, _ = np.linalg.qr(np.hstack([upper, lower]))
    return both[:, :k], both[:, k:]


def _shifts(a: np.ndarray) -> list[float]:
    """Places to cut the spectrum, the diagonal's median first: eigenvalues lie on both sides of all but the ends."""
    d = np.sort(np.diag(a))
    middle = (d[:-1] + d[1:]) / 2
    near = np.argsort(np.abs(np.arange(len(middle)) - (len(middle) - 1) / 2), kind="stable")
    mean = [float(np.mean(d)), float(np.mean(d)) + np.linalg.norm(a - np.mean(d) * np.eye(len(a))) / (4 * len(a))]
    return [float(np.median(d)), *middle[near].tolist(), *mean]


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces, or None if all eigenvalues are equal to working precision."""
    n, best = len(a), None
    if np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= 4 * EPS * scale:
        return None
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        projector = (polar_factor(moved) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        upper, lower = _bases(projector, k)
        # what couples the two subspaces is the error of the split
        error = np.linalg.norm(lower.T @ a @ upper)
        if best is None or error < best[0]:
            best = error, upper, lower
        if error <= 8 * n * EPS * scale:
            break
    return None if best is None else best[1:]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order and the unit eigenvectors as columns.

    The entry of largest size of each vector is positive.
    """
    a = (a + a.T) / 2
    n, scale = len(a), float(np.linalg.norm(a)) or 1.0
    waiting, done = [np.eye(n)], []
    while waiting:
        basis = waiting.pop()
        if basis.shape[1] == 1:
            done.append(basis)
            continue
        part = basis.T @ a @ basis
        halves = _split((part + part.T) / 2, scale)
        if halves is None:
            done.append(basis)
        else:
            waiting += [basis @ half for half in halves]
    vectors, _ = np.linalg.qr(np.hstack(done))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)
