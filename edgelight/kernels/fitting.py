"""Fits of sums of paths to chi(k), in k, R, q or wavelet space."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from edgelight.functions import expressions as ex
from edgelight.kernels import fourier as ft
from edgelight.kernels import paths as pt
from edgelight.kernels import splines as sp
from edgelight.kernels.lm import lmfit


class FitError(ValueError):
    pass


@dataclass(frozen=True)
class Transform:
    kmin: float = 0.0
    kmax: float = 20.0
    kweight: tuple[int, ...] = (2,)
    dk: float = 4.0
    dk2: float | None = None
    window: str = "kaiser"
    nfft: int = 2048
    kstep: float = 0.05
    rmin: float = 0.0
    rmax: float = 10.0
    dr: float = 0.0
    dr2: float | None = None
    rwindow: str = "hanning"
    rbkg: float = 0.0
    space: str = "r"

    @property
    def rstep(self) -> float:
        return math.pi / (self.kstep * self.nfft)

    def kwin(self) -> np.ndarray:
        return ft.k_window(self.nfft, self.kstep, self.window, self.kmin, self.kmax, self.dk, self.dk2)

    def rwin(self) -> np.ndarray:
        return ft.k_window(self.nfft, self.rstep, self.rwindow, max(self.rbkg, self.rmin), self.rmax, self.dr, self.dr2)

    def forward(self, chi: np.ndarray, kw: int) -> np.ndarray:
        n = len(chi)
        return ft.forward(chi * self.kwin()[:n] * (self.kstep * np.arange(n)) ** kw, self.nfft, self.kstep)

    def backward(self, chir: np.ndarray) -> np.ndarray:
        return ft.backward(chir * self.rwin()[: len(chir)], self.nfft, self.kstep)

    def refining(self) -> "Transform":
        """With background refinement the range begins at the first R point, and R below rbkg is the background's."""
        return replace(self, rbkg=max(self.rbkg, self.rmin), rmin=self.rstep)


def noise(chi: np.ndarray, t: Transform, kw: int, eps_k: float | None = None) -> tuple[float, float]:
    """(eps_k, eps_r) of chi on t's uniform grid: from chi(R) between 15 and 30, or eps_r of a given eps_k."""
    w = 2 * kw + 1
    spread = math.pi * w / (t.kstep * (t.kmax**w - t.kmin**w))
    if eps_k is not None:
        return eps_k, eps_k / (2 * math.sqrt(spread))
    a, b = int(0.01 + 15.0 / t.rstep), int(min(t.nfft / 2, 1.01 + 30.0 / t.rstep))
    high = t.forward(chi, kw)[a:b]
    if not len(high):
        raise FitError("Range: no point of R between 15 and 30")
    mean = t.kwin().sum() * t.kstep / (t.kmax - t.kmin)
    eps = math.sqrt(float(np.mean(np.concatenate([high.real, high.imag]) ** 2))) / mean
    return eps * math.sqrt(2 * spread), eps


@dataclass
class DataSet:
    k: np.ndarray
    chi: np.ndarray
    paths: list[dict]
    specs: list[dict]
    transform: Transform = field(default_factory=Transform)
    epsilon_k: float | None = None
    refine_bkg: bool = False
    cubic: bool = True

    def prepare(self) -> None:
        if len(self.paths) != len(self.specs):
            raise FitError(f"Shape: {len(self.paths)} paths but {len(self.specs)} specs")
        t = self.transform
        self.grid = t.kstep * np.arange(int(1.01 + max(self.k) / t.kstep))
        self.data = np.interp(self.grid, self.k, self.chi)
        self.n_idp = 1 + 2 * (t.rmax - t.rmin) * (t.kmax - t.kmin) / math.pi
        self._noise(t)
        self.background = None
        if self.refine_bkg:
            t = self.transform = t.refining()
            self.n_idp = 1 + 2 * t.rmax * (t.kmax - t.kmin) / math.pi
            n = 1 + int(np.round(2 * t.rbkg * (t.kmax - t.kmin) / math.pi))
            at = np.linspace(t.kmin, t.kmax, n)
            self.background = sp.basis(np.concatenate([np.repeat(t.kmin, 4), at[2:-2], np.repeat(t.kmax, 4)]), self.grid)
        self.compiled = [{n: ex.parse(str(v)) for n, v in _complete(s).items()} for s in self.specs]
        self.symbols = [_path_symbols(p) for p in self.paths]
        self.functions = [_path_functions(p) for p in self.paths]

    def _noise(self, t: Transform) -> None:
        self.eps_k, self.eps_r = map(list, zip(*(noise(self.data, t, kw, self.epsilon_k) for kw in t.kweight)))

    def path_params(self, symbols: dict) -> list[dict]:
        return [{n: ex.evaluate(e, symbols | own, fun) for n, e in spec.items()} for spec, own, fun in zip(self.compiled, self.symbols, self.functions)]

    def model(self, symbols: dict) -> np.ndarray:
        return pt.summed(self.paths, self.path_params(symbols), self.grid, self.cubic)[1]

    def residual(self, model: np.ndarray | float, bkg: np.ndarray | None = None) -> np.ndarray:
        t, diff = self.transform, self.data - model
        if bkg is not None:
            diff = diff - self.background @ bkg
        half, out = t.nfft / 2, []
        a, b = int(max(0.0, 0.01 + t.kmin / t.kstep)), int(min(half, 0.01 + t.kmax / t.kstep))
        c, d = int(max(0.0, 0.01 + t.rmin / t.rstep)), int(min(half, 0.01 + t.rmax / t.rstep))
        for kw, ek, er in zip(t.kweight, self.eps_k, self.eps_r):
            if t.space == "k":
                out.append(diff[a:b] / ek * self.grid[a:b] ** kw)
            elif t.space == "r":
                out.append((t.forward(diff, kw)[c:d] / er).view(float))
            elif t.space == "q":
                out.append(t.backward(t.forward(diff, kw))[a:b].real / er)
            else:
                rows = ft.cauchy(diff / ek, t.kmin, t.kmax, t.rmin, t.rmax, kw, t.kwin(), t.nfft, t.kstep)
                out.append(np.stack([rows.real, rows.imag], axis=1).ravel())
        return np.concatenate(out)


def _complete(spec: dict) -> dict:
    unknown = set(spec) - set(pt.NAMES)
    if unknown:
        raise FitError(f"Expr: no path parameter {', '.join(sorted(unknown))}")
    return {"degen": "degen", "s02": "1", **{n: "0" for n in pt.NAMES[2:]}, **spec}


def _path_symbols(p: dict) -> dict:
    names = ("reff", "nleg", "degen", "rnorman", "gam_ch", "rs_int", "vint", "vmu", "vfermi")
    return {n: float(p[n]) for n in names if n in p} | {"rmass": pt.reduced_mass(p["geom"])}


def _path_functions(p: dict) -> dict:
    return {
        "sigma2_eins": (2, lambda t, theta: pt.sigma2_einstein(t, theta, p["geom"])),
        "sigma2_debye": (2, lambda t, theta: pt.sigma2_debye(t, theta, p["rnorman"], p["geom"])),
        "gnxas": (3, lambda r0, sigma, beta: pt.gnxas(r0, sigma, beta, p["reff"])),
    }


def wired(n: int) -> tuple[ex.Parameters, list[dict]]:
    """Usual parameters and specs for n paths."""
    params = ex.Parameters().var("amp", 1.0).var("del_e0", 0.0).var("alpha", 0.0)
    for i in range(1, n + 1):
        params.var(f"sig{i}", 0.003)
    return params, [{"s02": "amp", "e0": "del_e0", "deltar": "alpha*reff", "sigma2": f"sig{i}"} for i in range(1, n + 1)]


def _started(params: ex.Parameters, sets: list[DataSet]) -> list[list[str]]:
    names = []
    for i, ds in enumerate(sets):
        ds.prepare()
        own = [] if ds.background is None else [f"bkg{j:02d}_ds{i}" for j in range(ds.background.shape[1])]
        for n in own:
            params.var(n, 0.0)
        names.append(own)
    return names


def evaluate(params: ex.Parameters, sets: list[DataSet]) -> list[np.ndarray]:
    """The model of each data set at the parameters' present values."""
    _started(params, sets)
    symbols = params.resolve()
    return [ds.model(symbols) for ds in sets]


def fit(params: ex.Parameters, sets: list[DataSet]) -> dict:
    """Least-squares fit; statistics scaled to independent points, uncertainties propagated to constrained values and path parameters."""
    bkg_names = _started(params, sets)
    own = params.varied()
    n_var = len(own)

    def residual(x):
        params.set_internal(x)
        symbols = params.resolve()
        return np.concatenate([ds.residual(ds.model(symbols), np.array([symbols[n] for n in names]) if names else None) for ds, names in zip(sets, bkg_names)])

    got = lmfit(residual, params.internal(), ftol=1e-6, xtol=1e-6, gtol=1e-6, maxfev=4000 * (n_var + 1), epsfcn=1e-10)
    params.set_internal(got.x)
    symbols = params.resolve()
    n_idp, n_data, total = sum(ds.n_idp for ds in sets), len(got.fvec), float(got.fvec @ got.fvec)
    base = sum(float(np.sum(ds.residual(0.0, np.array([symbols[n] for n in names]) if names else None) ** 2)) for ds, names in zip(sets, bkg_names))
    chi_square = total * n_idp / n_data
    covar = got.covar()
    if covar is not None:
        g = params.scales(got.x)
        covar = covar * np.outer(g, g) * total / (n_idp - n_var)

    def spread(g):
        return math.nan if covar is None else math.sqrt(max(float(g @ covar @ g), 0.0))

    grads = params.gradients()
    likelihood = n_idp * math.log(chi_square / n_idp) if chi_square > 0 else -math.inf
    path_rows = []
    for i, ds in enumerate(sets):
        for j, (spec, sym, fun) in enumerate(zip(ds.compiled, ds.symbols, ds.functions)):
            for name, e in spec.items():
                v, g = ex.evaluate_grad(e, symbols | sym, grads, n_var, fun)
                path_rows.append({"dataset": i, "path": j, "name": name, "value": v, "stderr": spread(g)})
    return {
        "best": [{"name": p.name, "value": p.value, "stderr": math.nan if covar is None else math.sqrt(max(covar[i, i], 0.0))} for i, p in enumerate(own)],
        "derived": [{"name": p.name, "value": p.value, "stderr": spread(grads[p.name])} for p in params.items.values() if p.kind == "expr"],
        "path_params": path_rows, "covar": covar, "nvarys": n_var, "ndata": n_data, "nfree": n_data - n_var, "n_idp": n_idp, "nfev": got.nfev, "info": got.info,
        "chi_square": chi_square, "chi2_reduced": chi_square / (n_idp - n_var), "rfactor": total / base if base else math.nan,
        "aic": likelihood + 2 * n_var, "bic": likelihood + math.log(n_idp) * n_var,
    }


def outputs(t: Transform, chi: np.ndarray, rmax_out: float = 10.0) -> dict:
    """chi(R) up to rmax_out and chi(q) up to 2 beyond kmax of a chi(k) on the transform's grid, with unwrapped phases."""
    chir = t.forward(chi, t.kweight[0])
    n = int(min(t.nfft / 2, 1.01 + rmax_out / t.rstep))
    q = np.linspace(0.0, t.kmax + 2, int(1.05 + (t.kmax + 2) / t.kstep))
    chiq = t.backward(chir)[: len(q)]
    out = {"r": t.rstep * np.arange(n), "q": q[: len(chiq)]}
    for name, c in (("chir", chir[:n]), ("chiq", chiq)):
        out |= {f"{name}_re": c.real, f"{name}_im": c.imag, f"{name}_mag": np.abs(c), f"{name}_pha": ft.unwrapped_phase(c)}
    return out
