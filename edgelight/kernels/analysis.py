"""Comparison of spectra on a common grid: linear combinations and principal components."""

from __future__ import annotations

import numpy as np

from edgelight.kernels import splines as sp


def common_rows(curves: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """The first curve's own grid inside the shared range and every curve on it (cubic); None without overlap."""
    lo, hi = max(x.min() for x, _ in curves), min(x.max() for x, _ in curves)
    if lo >= hi:
        return None
    x0 = curves[0][0]
    a = int(np.flatnonzero(x0 <= lo)[-1]) if (x0 <= lo).any() else 0
    b = int(np.flatnonzero(x0 <= hi)[-1])
    grid = x0[a : b + 1]
    return grid, np.stack([curves[0][1][a : b + 1]] + [sp.interp_cubic(x, y, grid) for x, y in curves[1:]])


def average_curves(curves: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean on the first curve's points inside the shared range; None without overlap, with unequal lengths or under two points."""
    if not curves or any(len(x) != len(y) or len(x) < 2 for x, y in curves):
        return None
    lo, hi = max(x.min() for x, _ in curves), min(x.max() for x, _ in curves)
    grid = curves[0][0][(curves[0][0] >= lo) & (curves[0][0] <= hi)]
    if lo >= hi or len(grid) < 2:
        return None
    return grid, np.mean([np.interp(grid, x, y) for x, y in curves], axis=0)


def lincombo(y: np.ndarray, comps: np.ndarray, sum_to_one: bool = True) -> dict:
    """Weights of components (rows) for y; with sum_to_one the last one is what is left of one."""
    comps = np.asarray(comps, float)
    if len(comps) < 2:
        raise ValueError("need at least two components")
    base, a = (comps[-1], comps[:-1] - comps[-1]) if sum_to_one else (0.0, comps)
    w = np.linalg.lstsq(a.T, y - base, rcond=None)[0]
    weights = np.append(w, 1 - w.sum()) if sum_to_one else w
    fit = weights @ comps
    free = len(y) - len(w)
    chisqr = float(np.sum((y - fit) ** 2))
    covar = np.linalg.pinv(a @ a.T) * chisqr / max(free, 1)
    err = np.sqrt(np.maximum(np.diag(covar), 0))
    if sum_to_one:
        err = np.append(err, np.sqrt(max(covar.sum(), 0)))
    return {"weights": weights, "stderr": err, "yfit": fit, "chisqr": chisqr, "redchi": chisqr / max(free, 1), "rfactor": chisqr / float(np.sum(y * y)), "total": float(weights.sum())}


def pca_train(rows: np.ndarray) -> dict:
    """Principal components of spectra (rows): mean, components (rows, scaled), variances, indicator values and their first minimum."""
    rows = np.asarray(rows, float)
    narr, nfreq = rows.shape
    mean = rows.mean(axis=0)
    z = rows - mean
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(z @ z.T / narr)
    values, vectors = values[::-1], vectors[:, ::-1]
    comps = -(vectors.T @ z) / narr
    tail = np.array([values[r:].sum() for r in range(narr)])
    ind = []
    for r in range(narr - 1):
        left = narr - r - 1
        ind.append(np.sqrt(max(nfreq * tail[r], 0) / left) / left**2)
    ind = np.array(ind[:1] + ind)  # the first value stands twice
    return {"mean": mean, "components": comps, "eigenvalues": values, "variances": values / values.sum(), "ind": ind, "nsig": int(np.argmin(ind))}


def pca_fit(y: np.ndarray, model: dict, ncomps: int | None = None, rescale: bool = True) -> dict:
    """y by the mean and the first components; with rescale y's own non-negative scale is fitted too, in closed form."""
    y, n = np.asarray(y, float), max(1, model["nsig"]) if ncomps is None else ncomps
    c, mean = model["components"][:n].T, model["mean"]
    q, _ = np.linalg.qr(c)

    def outside(v):
        return v - q @ (q.T @ v)

    a, b = outside(y), outside(mean)
    scale = max(0.0, float(a @ b / (a @ a))) if rescale and a @ a > 0 else 1.0
    w = np.linalg.lstsq(c, scale * y - mean, rcond=None)[0]
    fit = c @ w + mean
    return {"weights": w, "yfit": fit, "ydat": scale * y, "scale": scale, "chi_square": float(np.sum((scale * y - fit) ** 2))}
