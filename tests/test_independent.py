"""Kernels against plainer programs written here and against spectra whose answers are known from their formula."""

import cmath
import math

import numpy as np
import pytest

from edgelight.kernels import fitting as ff
from edgelight.kernels import fourier as ft
from edgelight.kernels import paths as pt
from edgelight.kernels import reduction as rd
from edgelight.kernels import splines as sp
from edgelight.operators.fits import parameters
from edgelight.plans.kernel_queries import FIT, PARAMS, SPECS, demo_path

E0 = 8979.0


def hanning(x, low, high, width, step):
    """Raised cosine over width around low and high, point by point; its four corners lie on points of the grid."""
    a, b, c, d = (step * math.floor(v / step + 1e-9) for v in (low - width / 2, low + width / 2, high - width / 2, high + width / 2))
    if x <= a or x >= d:
        return 0.0
    if x < b:
        return math.sin(math.pi / 2 * (x - a) / (b - a)) ** 2
    return math.cos(math.pi / 2 * (x - c) / (d - c)) ** 2 if x > c else 1.0


def summed_transform(k, chi, r, kweight, weights):
    return [sum(c * q**kweight * w * cmath.exp(-2j * q * d) for q, c, w in zip(k, chi, weights)) * (k[1] - k[0]) / math.sqrt(math.pi) for d in r]


def test_forward_transform_is_the_sum_over_points():
    k = 0.05 * np.arange(301)
    chi = np.sin(2 * 2.1 * k + 0.4) * np.exp(-0.01 * k * k)
    out = ft.xftf(k, chi, 3, 12.5, 2, 1.5)
    some = slice(0, None, 17)
    want = summed_transform(k, chi, out["r"][some], 2, [hanning(q, 3, 12.5, 1.5, 0.05) for q in k])
    assert np.abs(out["chir"][some] - want).max() < 1e-12 * np.abs(out["chir"]).max() * len(k)


def test_back_transform_is_the_sum_over_points():
    k = 0.05 * np.arange(281)
    fwd = ft.xftf(k, np.sin(2 * 2.3 * k), 2, 12, 1, 1)
    back = ft.xftr(fwd["r"], fwd["chir"], 1, 3.5, 0.4)
    step = fwd["r"][1]
    want = [2 / math.sqrt(math.pi) * step * sum(c * hanning(r, 1, 3.5, 0.4, step) * cmath.exp(2j * q * r) for r, c in zip(fwd["r"], fwd["chir"])) for q in 0.05 * np.arange(0, 240, 23)]
    assert np.abs(back["chiq"][:240:23] - want).max() < 1e-11


def smooth_edge(width, at=E0):
    e = E0 - 150 + 1.0 * np.arange(901)
    return e, 0.5 + np.arctan((e - at) / width) / np.pi


@pytest.mark.parametrize("width,at", [(1.5, E0), (3.0, E0 + 4), (6.0, E0 - 3)])
def test_edge_energy_of_an_arctangent_is_its_centre(width, at):
    e, mu = smooth_edge(width, at)
    assert rd.find_e0(e, mu) == pytest.approx(at, abs=1.01)
    assert rd.find_e0(e, 7 * mu - 2) == rd.find_e0(e, mu)


@pytest.mark.parametrize("nvict", (0, 1, 2))
def test_normalisation_finds_line_and_polynomial_of_the_formula(nvict):
    e = E0 - 200 + 2.0 * np.arange(501)
    line = (3.0 - 2e-4 * e) * e ** float(-nvict)
    jump = 1.3 + 4e-4 * (e - E0) - 5e-8 * (e - E0) ** 2
    mu = line + np.where(e >= E0, jump, 0)
    out = rd.pre_edge(e, mu, rd.PreEdgeParams(e0=E0, pre1=-180, pre2=-20, norm1=50, norm2=750, nnorm=2, nvict=nvict))
    assert out["e0"] == E0 and out["edge_step"] == pytest.approx(1.3, abs=1e-9)
    assert np.abs(out["pre_edge"] - line).max() < 1e-9 and np.abs(out["post_edge"] - line - jump).max() < 1e-8
    assert np.abs(out["norm"] - np.where(e >= E0, jump, 0) / 1.3).max() < 1e-8
    assert np.abs(out["flat"] - (e >= E0)).max() < 1e-8


def background_spectrum(wave):
    e = E0 - 150 + 2.0 * np.arange(481)
    k = np.sqrt(np.maximum(e - E0, 0) * 0.2624682843)
    return e, k, np.where(e >= E0, 1.0 + 0.02 * k - 0.004 * k**2 + 1e-4 * k**3, 0.0) + np.where(e > E0, wave * np.sin(4.6 * k) * np.exp(-0.01 * k * k), 0)


def test_background_that_is_a_cubic_in_k_is_found_whole():
    e, k, mu = background_spectrum(0.0)
    out = rd.autobk(e, mu, rd.AutobkParams(ek0=E0, edge_step=1.0))
    assert np.abs(out["chi"]).max() < 1e-5 and np.abs((out["bkg"] - mu)[e >= E0]).max() < 1e-5


def test_background_without_clamps_is_the_linear_least_squares_solution():
    e, k, mu = background_spectrum(0.05)
    p = rd.AutobkParams(ek0=E0, edge_step=1.0, nclamp=0)
    out = rd.autobk(e, mu, p)
    own = slice(out["iek0"], out["iemax"] + 1)
    grid, kraw = out["k"], np.sqrt(np.maximum(e[own] - E0, 0) * rd.ETOK)
    r = math.pi / (p.kstep * p.nfft) * np.arange(out["irbkg"])

    window = ft.window(grid, p.win, p.kmin, out["kmax"], p.dk, p.dk)

    def head(curve):
        """What the fit makes small, by other means: tridiagonal interpolation and a sum point by point."""
        on = sp.banded_interp(kraw, curve, grid)
        return np.array(summed_transform(grid, on, r, p.kweight, window)).view(float)

    unit = np.eye(out["nspl"])
    columns = np.stack([head(sp.basis(out["knots"], kraw) @ c) for c in unit], axis=1)
    best = np.linalg.lstsq(columns, head(mu[own]), rcond=None)[0]
    want = sp.basis(out["knots"], kraw) @ best
    assert np.abs(out["bkg"][own] - want)[5:-5].max() < 1e-4


def test_convolution_widens_a_step_and_keeps_its_middle():
    e = 0.5 * np.arange(161) + 9000
    y = 0.5 + np.arctan((e - 9030) / 2) / np.pi
    got = rd.convolve(e, y, esigma=1.0, form="gaussian")
    assert got[100] == pytest.approx(y[100], abs=0.05) and (np.diff(got[40:110]) > -1e-9).all()


def noisy_fit(scale):
    paths = [demo_path(2.55, 12.0), demo_path(3.6, 6.0)]
    k = 0.05 * np.arange(321)
    true = [dict(degen=f["degen"], s02=0.85, e0=1.5, ei=0.0, deltar=0.003 * f["reff"], sigma2=s, third=0.0, fourth=0.0) for f, s in zip(paths, (0.005, 0.007))]
    chi = pt.summed(paths, true, k)[1] + scale * np.random.default_rng(5).normal(size=len(k))
    params = parameters(PARAMS)
    sets = [ff.DataSet(k, chi, paths, SPECS, FIT, 1e-3)]
    return params, sets, ff.fit(params, sets)


def test_uncertainties_are_those_of_a_numerical_jacobian():
    params, sets, out = noisy_fit(2e-3)
    names = [b["name"] for b in out["best"]]
    best = np.array([b["value"] for b in out["best"]])
    symbols = params.resolve()

    def residual(x):
        return sets[0].residual(sets[0].model(moved(x)))

    def moved(x):
        own = symbols | dict(zip(names, x))
        return own | {"sig2": 1.4 * own["sig1"]}

    steps = 1e-5 * np.maximum(np.abs(best), 1e-2)
    jac = np.stack([(residual(best + s) - residual(best - s)) / (2 * s.max()) for s in np.diag(steps)], axis=1)
    f = residual(best)
    # at the minimum the residual is orthogonal to every column
    assert (np.abs(jac.T @ f) / (np.linalg.norm(jac, axis=0) * np.linalg.norm(f))).max() < 1e-3
    covar = np.linalg.inv(jac.T @ jac) * (f @ f) / (out["n_idp"] - len(names))
    assert np.allclose([b["stderr"] for b in out["best"]], np.sqrt(np.diag(covar)), rtol=1e-3)
    assert out["chi_square"] == pytest.approx(f @ f * out["n_idp"] / len(f), rel=1e-8)
    assert out["n_idp"] == pytest.approx(1 + 2 * (FIT.rmax - FIT.rmin) * (FIT.kmax - FIT.kmin) / math.pi, abs=1e-9)
