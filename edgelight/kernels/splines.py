"""Cubic B-splines as matrices, interpolation and least-squares helpers."""

from __future__ import annotations

import numpy as np


def basis(t: np.ndarray, x: np.ndarray, degree: int = 3) -> np.ndarray:
    """Values of all B-splines over knots t at points x (rows); end polynomials continue outside the knots."""
    x, t = np.atleast_1d(np.asarray(x, float)), np.asarray(t, float)
    n = len(t) - degree - 1
    span = np.clip(np.searchsorted(t, x, side="right") - 1, degree, n - 1)
    local = np.zeros((len(x), degree + 1))
    local[:, 0] = 1.0
    for d in range(1, degree + 1):
        carry = np.zeros(len(x))
        for j in range(d):
            right, left = t[span + j + 1], t[span + j + 1 - d]
            width = right - left
            part = np.divide(local[:, j], width, out=np.zeros(len(x)), where=width != 0)
            local[:, j] = carry + (right - x) * part
            carry = (x - left) * part
        local[:, d] = carry
    out = np.zeros((len(x), n))
    out[np.arange(len(x))[:, None], span[:, None] + np.arange(-degree, 1)] = local
    return out


def knots_of(x: np.ndarray) -> np.ndarray:
    """Knots of the interpolating cubic through x: ends fourfold, the second and last but one point left out."""
    return np.concatenate([np.repeat(x[0], 4), x[2:-2], np.repeat(x[-1], 4)])


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, coefficients) of the interpolating cubic; y may have several columns."""
    t = knots_of(np.asarray(x, float))
    return t, np.linalg.solve(basis(t, x), y)


def operator(x: np.ndarray, xnew: np.ndarray) -> np.ndarray:
    """The matrix that takes values at x to the interpolating cubic's values at xnew."""
    t = knots_of(np.asarray(x, float))
    return np.linalg.solve(basis(t, x).T, basis(t, xnew).T).T


def banded_interp(x: np.ndarray, y: np.ndarray, xnew: np.ndarray) -> np.ndarray:
    """The interpolating cubic at xnew, from its end slopes' tridiagonal system; linear in len(x)."""
    x, y, xnew = (np.asarray(v, float) for v in (x, y, xnew))
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), xnew - x[0])
    h = np.diff(x)
    s = np.diff(y) / h
    lower, diag, upper, rhs = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    lower[1:-1], diag[1:-1], upper[1:-1] = h[1:], 2 * (h[1:] + h[:-1]), h[:-1]
    rhs[1:-1] = 3 * (h[1:] * s[:-1] + h[:-1] * s[1:])
    # the third derivative is continuous at the second and last but one point
    a, b = h[0] + h[1], h[-1] + h[-2]
    diag[0], upper[0], rhs[0] = h[1], a, (h[1] * (3 * h[0] + 2 * h[1]) * s[0] + h[0] ** 2 * s[1]) / a
    diag[-1], lower[-1], rhs[-1] = h[-2], b, (h[-2] * (3 * h[-1] + 2 * h[-2]) * s[-1] + h[-1] ** 2 * s[-2]) / b
    for i in range(1, n):
        f = lower[i] / diag[i - 1]
        diag[i] -= f * upper[i - 1]
        rhs[i] -= f * rhs[i - 1]
    m = np.empty(n)
    m[-1] = rhs[-1] / diag[-1]
    for i in range(n - 2, -1, -1):
        m[i] = (rhs[i] - upper[i] * m[i + 1]) / diag[i]
    k = np.clip(np.searchsorted(x, xnew, side="right") - 1, 0, n - 2)
    u = (xnew - x[k]) / h[k]
    # Hermite form
    return y[k] * (1 + 2 * u) * (1 - u) ** 2 + m[k] * h[k] * u * (1 - u) ** 2 + y[k + 1] * u * u * (3 - 2 * u) + m[k + 1] * h[k] * u * u * (u - 1)


def interp_cubic(x: np.ndarray, y: np.ndarray, xnew: np.ndarray) -> np.ndarray:
    """Interpolating cubic inside; outside, the cubic through the first or last five points (NaN for unsorted input)."""
    x, y, xnew = (np.asarray(v, float) for v in (x, y, xnew))
    out = banded_interp(x, y, xnew)
    sides = ((xnew < x[0], slice(0, min(5, len(x)))), (xnew > x[-1], slice(len(x) - min(5, len(x)), len(x))))
    rising = (np.diff(x) >= 0).all() and (np.diff(xnew) >= 0).all()
    for where, own in sides:
        if where.any():
            out[where] = banded_interp(x[own], y[own], xnew[where]) if rising else np.nan
    return out


def polyfit(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """Least squares, low to high, solved on x mapped to [-1, 1] with columns of length one."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    lo, hi = (x.min(), x.max()) if len(x) else (0.0, 0.0)
    if not hi > lo:
        return np.array([np.mean(y)])
    shift, scale = -(hi + lo) / (hi - lo), 2 / (hi - lo)
    columns = np.vander(shift + scale * x, degree + 1, increasing=True)
    size = np.sqrt((columns * columns).sum(axis=0))
    size[size == 0] = 1.0
    c = np.linalg.lstsq(columns / size, y, rcond=len(x) * np.finfo(float).eps)[0] / size
    # Horner's rule in (shift + scale x) gives the powers of x
    out = np.zeros(degree + 1)
    for v in c[::-1]:
        out[1:] = shift * out[1:] + scale * out[:-1]
        out[0] = shift * out[0] + v
    return out


def padded(c: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([c, np.zeros(max(0, n - len(c)))])
