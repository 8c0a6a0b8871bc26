"""Levenberg-Marquardt in trust-region form, on singular values of the scaled Jacobian."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class LmResult:
    x: np.ndarray
    fvec: np.ndarray
    nfev: int
    info: int
    jac: np.ndarray

    def covar(self) -> np.ndarray | None:
        """(J'J)^-1 at the solution, or None if it is singular."""
        u, s, vt = np.linalg.svd(self.jac, full_matrices=False)
        if not len(s) or s[-1] <= np.finfo(float).eps * s[0]:
            return None
        return (vt.T / s**2) @ vt


def jacobian(f: Callable, x: np.ndarray, f0: np.ndarray, eps: float) -> np.ndarray:
    rel = np.sqrt(max(eps, np.finfo(float).eps))
    out = np.empty((len(f0), len(x)))
    for j in range(len(x)):
        h = rel * abs(x[j]) or rel
        moved = x.copy()
        moved[j] += h
        out[:, j] = (f(moved) - f0) / h
    return out


def lmfit(f: Callable, x0, ftol: float = 1.49012e-8, xtol: float = 1.49012e-8, gtol: float = 0.0, maxfev: int | None = None, epsfcn: float = 0.0, factor: float = 100.0, jac: Callable | None = None) -> LmResult:
    """Minimise sum f(x)^2. info: 1 cost, 2 step, 3 both, 4 gradient, 5 too many calls."""
    x = np.array(x0, float)
    n = len(x)
    maxfev = maxfev or 200 * (n + 1)
    fx = f(x)
    nfev, norm, delta, scale, info = 1, np.linalg.norm(fx), None, None, 0
    while True:
        j = jac(x) if jac else jacobian(f, x, fx, epsfcn)
        nfev += 0 if jac else n
        columns = np.linalg.norm(j, axis=0)
        if scale is None:
            scale = np.where(columns == 0, 1.0, columns)
            delta = factor * np.linalg.norm(scale * x) or factor
        grad = j.T @ fx
        if norm == 0 or np.max(np.abs(grad) / np.where(columns == 0, np.inf, columns) / norm, initial=0.0) <= gtol:
            return LmResult(x, fx, nfev, 4, j)
        scale = np.maximum(scale, columns)
        u, s, vt = np.linalg.svd(j / scale, full_matrices=False)
        uf = u.T @ fx
        while True:
            step, par = _step(s, vt, uf, delta)
            p = -step / scale
            size = np.linalg.norm(step)
            if nfev == 1 + (0 if jac else n):
                delta = min(delta, size)
            trial = f(x + p)
            nfev += 1
            t_norm = np.linalg.norm(trial)
            actual = 1 - (t_norm / norm) ** 2 if 0.1 * t_norm < norm else -1.0
            predicted = (np.linalg.norm(j @ p) / norm) ** 2 + 2 * par * (size / norm) ** 2
            ratio = actual / predicted if predicted else 0.0
            if ratio <= 0.25:
                slope = -((np.linalg.norm(j @ p) / norm) ** 2 + par * (size / norm) ** 2)
                shrink = 0.5 if actual >= 0 else 0.5 * slope / (slope + 0.5 * actual)
                shrink = 0.1 if 0.1 * t_norm >= norm or shrink < 0.1 else shrink
                delta = shrink * min(delta, size / 0.1)
            elif par == 0 or ratio >= 0.75:
                delta = size / 0.5
            if ratio >= 1e-4:
                x, fx, norm = x + p, trial, t_norm
            flat = abs(actual) <= ftol and predicted <= ftol and ratio <= 2
            still = delta <= xtol * np.linalg.norm(scale * x)
            info = (1 if flat else 0) + (2 if still else 0)
            if info or nfev >= maxfev or not np.isfinite(norm):
                return LmResult(x, fx, nfev, info or 5, j)
            if ratio >= 1e-4:
                break


def _step(s, vt, uf, delta) -> tuple[np.ndarray, float]:
    """The step of length delta at most (within a tenth), in scaled coordinates, and its parameter."""
    good = s > s[0] * 1e-15 if len(s) else s > 0
    gauss = np.where(good, uf / np.where(good, s, 1.0), 0.0)
    if np.linalg.norm(gauss) <= 1.1 * delta:
        return vt.T @ gauss, 0.0
    low, high = 0.0, np.linalg.norm(s * uf) / delta
    par = np.sqrt(max(low, 1e-3 * high) * high)
    for _ in range(30):
        y = s * uf / (s * s + par)
        size = np.linalg.norm(y)
        if abs(size - delta) <= 0.1 * delta:
            break
        low, high = (par, high) if size > delta else (low, par)
        slope = -np.sum((s * uf) ** 2 / (s * s + par) ** 3) / size
        new = par - (size - delta) / slope * size / delta
        par = new if low < new < high else max(1e-3 * high, np.sqrt(low * high))
    return vt.T @ (s * uf / (s * s + par)), par
