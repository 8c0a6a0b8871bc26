"""Kernels over tables of spectra: one row in, one row out, inside mapInPandas, so without a shuffle.

A spectrum that a kernel cannot take is a row with status 'failed', its error and null results; it never ends the job.
Rows whose inputs are null pass through with status 'skipped'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from edgelight.kernels import analysis as an
from edgelight.kernels import fourier as ft
from edgelight.kernels import reduction as rd
from edgelight.kernels import splines as sp
from edgelight.kernels.fitting import Transform
from edgelight.kernels.fitting import noise as noise_of
from edgelight.operators import components


#: Bytes of arrays, inputs and results, that go back to Spark at once
BATCH_BYTES = 4 << 20


def rowwise(df: DataFrame, inputs: list[str], kernel: Callable[..., dict], results: str) -> DataFrame:
    """df with the kernel's results (DDL) and status, error; same-named columns of df give way.

    Results are many times the inputs, so they go back as soon as they come to BATCH_BYTES, however many rows a batch brings.
    """
    added = _parse_datatype_string(results)
    names = [f.name for f in added.fields]
    keep = [f for f in df.schema.fields if f.name not in {*names, "status", "error"}]
    schema = StructType([*keep, *added.fields, StructField("status", StringType()), StructField("error", StringType())])
    scalars = {f.name for f in added.fields if f.dataType.typeName() not in ("array",)}

    def made(pdf, rows, status, errors):
        data = {f.name: pdf[f.name] for f in keep} | {n: pd.Series(v, index=pdf.index, dtype=object) for n, v in rows.items()}
        for f in added.fields:
            if f.dataType.typeName() in ("double", "integer", "long"):
                data[f.name] = pd.to_numeric(data[f.name], errors="coerce")
        return pd.DataFrame(data | {"status": pd.Series(status, index=pdf.index), "error": pd.Series(errors, index=pdf.index, dtype=object)})

    def run(batches):
        for pdf in batches:
            kept = [pdf[f.name] for f in keep if f.dataType.typeName() == "array"]
            first, size, rows, status, errors = 0, 0, {n: [] for n in names}, [], []
            for at, values in enumerate(zip(*(pdf[c] for c in inputs))):
                try:
                    if any(v is None for v in values):
                        out, state, why = {}, "skipped", None
                    else:
                        out, state, why = kernel(*(np.asarray(v, float) if np.ndim(v) else v for v in values)), "ok", None
                except Exception as e:  # an error is a result here
                    out, state, why = {}, "failed", f"{type(e).__name__}: {e}"
                for n in names:
                    v = out.get(n)
                    rows[n].append(None if v is None else v if n in scalars else np.array(v, float))  # no view, which would keep all of a kernel's work
                    size += 8 if v is None or n in scalars else rows[n][-1].nbytes
                status.append(state)
                errors.append(why)
                size += sum(8 * len(c.iat[at]) for c in kept if c.iat[at] is not None)
                if size >= BATCH_BYTES:
                    yield made(pdf.iloc[first : at + 1], rows, status, errors)
                    first, size, rows, status, errors = at + 1, 0, {n: [] for n in names}, [], []
            if first < len(pdf) or pdf.empty:
                yield made(pdf.iloc[first:], rows, status, errors)

    return df.mapInPandas(run, schema)


def find_e0(df: DataFrame) -> DataFrame:
    return rowwise(df, ["energy", "mu"], lambda e, m: {"e0": rd.find_e0(e, m)}, "e0 double")


PRE_EDGE = "energy array<double>, e0 double, edge_step double, pre1 double, pre2 double, norm1 double, norm2 double, pre_edge array<double>, post_edge array<double>, norm array<double>, flat array<double>, dmude array<double>, d2mude array<double>"


def pre_edge(df: DataFrame, p: rd.PreEdgeParams = rd.PreEdgeParams()) -> DataFrame:
    """Normalised spectra; the cleaned energy grid comes with them, so arrays line up."""
    return rowwise(df, ["energy", "mu"], lambda e, m: rd.pre_edge(e, m, p), PRE_EDGE + ", mu array<double>")


def autobk(df: DataFrame, p: rd.AutobkParams = rd.AutobkParams(), err_sigma: float = 0.0) -> DataFrame:
    def run(e, m):
        out = rd.autobk(e, m, p)
        return out | ((rd.autobk_bands(out, err_sigma) or {}) if err_sigma > 0 else {})

    return rowwise(df, ["energy", "mu"], run, "ek0 double, edge_step double, bkg array<double>, k array<double>, chi array<double>, delta_chi array<double>, delta_bkg array<double>, redchi double")


def autobk_standard(df: DataFrame, standard: DataFrame, p: rd.AutobkParams = rd.AutobkParams()) -> DataFrame:
    """autobk() with a standard chi(k) as constraint: standard has k and chi arrays, and gid if spectra have standards of their own.

    Without gid it has one row for all (more are an error). A spectrum without a standard is 'skipped'.
    """
    own = standard.select(*(["gid"] if "gid" in standard.columns else []), F.col("k").alias("k_std"), F.col("chi").alias("chi_std"))
    if "gid" in standard.columns:
        rows = df.drop("k_std", "chi_std").join(own, "gid", "left")
    else:
        one = own.agg(F.count(F.lit(1)).alias("n"), F.first("k_std").alias("k_std"), F.first("chi_std").alias("chi_std"))
        one = one.select(F.when(F.col("n") > 1, F.raise_error(F.lit("one standard is expected")).cast("array<double>")).otherwise(F.col("k_std")).alias("k_std"), "chi_std")
        rows = df.drop("k_std", "chi_std").join(F.broadcast(one))

    def run(e, m, k, chi):
        return rd.autobk(e, m, replace(p, k_std=tuple(k), chi_std=tuple(chi)))

    return rowwise(rows, ["energy", "mu", "k_std", "chi_std"], run, "ek0 double, edge_step double, bkg array<double>, k array<double>, chi array<double>").drop("k_std", "chi_std")


CHIR = "r array<double>, chir_re array<double>, chir_im array<double>, chir_mag array<double>"
CHIQ = "q array<double>, chiq_re array<double>, chiq_im array<double>, chiq_mag array<double>"


def _complex(name: str, c: np.ndarray) -> dict:
    return {f"{name}_re": c.real, f"{name}_im": c.imag, f"{name}_mag": np.abs(c)}


def xftf(df: DataFrame, **options) -> DataFrame:
    def run(k, chi):
        out = ft.xftf(k, chi, **options)
        return {"r": out["r"]} | _complex("chir", out["chir"])

    return rowwise(df, ["k", "chi"], run, CHIR)


def xftr(df: DataFrame, **options) -> DataFrame:
    def run(r, re, im):
        out = ft.xftr(r, re + 1j * im, **options)
        return {"q": out["q"]} | _complex("chiq", out["chiq"])

    return rowwise(df, ["r", "chir_re", "chir_im"], run, CHIQ)


def noise(df: DataFrame, transform: Transform, kweight: int = 2) -> DataFrame:
    """Noise of every chi(k) in k and R, from its transform between 15 and 30 Angstrom."""

    def run(k, chi):
        grid = transform.kstep * np.arange(int(1.01 + k.max() / transform.kstep))
        eps_k, eps_r = noise_of(np.interp(grid, k, chi), transform, kweight)
        return {"eps_k": eps_k, "eps_r": eps_r}

    return rowwise(df, ["k", "chi"], run, "eps_k double, eps_r double")


def reduce_all(df: DataFrame, pre: rd.PreEdgeParams = rd.PreEdgeParams(), bkg: rd.AutobkParams = rd.AutobkParams(), transform: dict | None = None) -> DataFrame:
    """Normalise, remove the background and transform in one pass over the rows: no shuffle and no stage between the steps."""
    transform = transform or {}

    def run(e, m):
        if not len(m):
            raise ValueError("empty spectrum")
        pe = rd.pre_edge(e, m, pre)
        ab = rd.autobk(pe["energy"], pe["mu"], replace(bkg, ek0=bkg.ek0 or pe["e0"], edge_step=bkg.edge_step or pe["edge_step"]))
        out = ft.xftf(ab["k"], ab["chi"], **transform)
        return pe | {"bkg": ab["bkg"], "k": ab["k"], "chi": ab["chi"], "r": out["r"]} | _complex("chir", out["chir"])

    return rowwise(df, ["energy", "mu"], run, f"{PRE_EDGE}, mu array<double>, bkg array<double>, k array<double>, chi array<double>, {CHIR}")


def rebin(df: DataFrame, e0: float | None = None, **options) -> DataFrame:
    return rowwise(df, ["energy", "mu"], lambda e, m: rd.rebin(e, m, rd.find_e0(e, m) if e0 is None else e0, **options), "energy array<double>, mu array<double>, delta_mu array<double>")


def smooth(df: DataFrame, **options) -> DataFrame:
    def run(e, m):
        if len(e) < 2 or not (np.diff(e) > 0).all():
            raise ValueError("needs two points or more, ascending")
        return {"mu": rd.smooth(e, m, **options)}

    return rowwise(df, ["energy", "mu"], run, "mu array<double>")


def deconvolve(df: DataFrame, **options) -> DataFrame:
    return rowwise(df, ["energy", "norm"], lambda e, m: {"deconv": rd.deconvolve(e, m, **options)}, "deconv array<double>")


def convolve(df: DataFrame, **options) -> DataFrame:
    return rowwise(df, ["energy", "norm"], lambda e, m: {"conv": rd.convolve(e, m, **options)}, "conv array<double>")


def mback(df: DataFrame, **options) -> DataFrame:
    """df needs f2, a supplied table's values on the energy grid."""
    return rowwise(df, ["energy", "mu", "f2"], lambda e, m, f2: rd.mback(e, m, f2, **options), "e0 double, edge_step double, fpp array<double>, norm array<double>, norm_function array<double>, s double")


def mback_norm(df: DataFrame, **options) -> DataFrame:
    return rowwise(df, ["energy", "mu", "f2"], lambda e, m, f2: rd.mback_norm(e, m, f2, **options), "norm array<double>, edge_step double, edge_step_poly double, mback_mu array<double>, slope double, offset double, scale double")


def diffkk(df: DataFrame, **options) -> DataFrame:
    return rowwise(df, ["energy", "mu", "f1", "f2"], lambda e, m, f1, f2: rd.diffkk(e, m, f1, f2, **options), "fp array<double>, fpp array<double>, s double")


def cauchy(df: DataFrame, kmin: float = 2.0, kmax: float = 12.0, rmin: float = 0.5, rmax: float = 5.0, kweight: int = 2, kstep: float = 0.05) -> DataFrame:
    """Per R the largest magnitude of the Cauchy wavelet over k; cauchy_map() has all of them."""

    def run(k, chi):
        grid = kstep * np.arange(int(1.01 + k.max() / kstep))
        win = ft.k_window(2048, kstep, "hanning", kmin, kmax, 1.0, None)
        return {"mag": np.abs(ft.cauchy(np.interp(grid, k, chi), kmin, kmax, rmin, rmax, kweight, win, kstep=kstep)).max(axis=1)}

    return rowwise(df, ["k", "chi"], run, "mag array<double>")


def cauchy_map(df: DataFrame, kmin: float = 2.0, kmax: float = 12.0, rmin: float = 0.5, rmax: float = 5.0, kweight: int = 2, kstep: float = 0.05) -> DataFrame:
    """The whole Cauchy wavelet map: magnitude row by row over R (map), and its number of k points (columns)."""

    def run(k, chi):
        grid = kstep * np.arange(int(1.01 + k.max() / kstep))
        win = ft.k_window(2048, kstep, "hanning", kmin, kmax, 1.0, None)
        mag = np.abs(ft.cauchy(np.interp(grid, k, chi), kmin, kmax, rmin, rmax, kweight, win, kstep=kstep))
        return {"map": mag.ravel(), "columns": mag.shape[1]}

    return rowwise(df, ["k", "chi"], run, "map array<double>, columns int")


def morlet_map(df: DataFrame, **options) -> DataFrame:
    """The whole Morlet map: r, magnitude row by row over R (map), and its number of k points (columns); null beyond the Nyquist limit."""

    def run(k, chi):
        out = ft.morlet(k, chi, **options)
        return {} if out is None else {"r": out["r"], "map": out["mag"].ravel(), "columns": out["mag"].shape[1]}

    return rowwise(df, ["k", "chi"], run, "r array<double>, map array<double>, columns int")


def on_first_grid(df: DataFrame) -> DataFrame:
    """Every curve (gid, x array, y array) on the first one's native grid inside the shared range, by cubic splines: y_grid.

    The first curve (smallest gid) and the range travel with the closure; no shared range gives skipped rows.
    """
    from pyspark.sql import functions as F

    lo, hi = df.select(F.array_min("x").alias("a"), F.array_max("x").alias("b")).agg(F.max("a"), F.min("b")).head()
    first = df.orderBy("gid").select("gid", "x").head()
    grid = np.zeros(0)
    if first is not None and lo is not None and lo < hi:
        x0 = np.asarray(first.x, float)
        grid = x0[rd.index_of(x0, lo) : rd.index_of(x0, hi) + 1]
    own = None if first is None else first.gid

    def run(gid, x, y):
        if not len(grid):
            return {}
        return {"y_grid": y[rd.index_of(x, lo) : rd.index_of(x, hi) + 1] if gid == own else sp.interp_cubic(x, y, grid)}

    return rowwise(df, ["gid", "x", "y"], run, "y_grid array<double>")


def morlet(df: DataFrame, **options) -> DataFrame:
    """Per R the largest Morlet magnitude over k; None where the range passes the Nyquist limit."""

    def run(k, chi):
        out = ft.morlet(k, chi, **options)
        return {} if out is None else {"r": out["r"], "mag": out["mag"].max(axis=1)}

    return rowwise(df, ["k", "chi"], run, "r array<double>, mag array<double>")


def lincombo(df: DataFrame, components: list, sum_to_one: bool = True) -> DataFrame:
    """Weights of fixed component curves for every row's y; the components travel with the closure."""
    comps = np.asarray(components, float)
    return rowwise(df, ["y"], lambda y: an.lincombo(y, comps, sum_to_one), "weights array<double>, stderr array<double>, yfit array<double>, chisqr double, redchi double, rfactor double")


def pca_train(df: DataFrame) -> dict:
    """A model of the training spectra in df (y), however many: see operators.components."""
    return components.train(df)


def pca_fit(df: DataFrame, model: dict, ncomps: int | None = None, rescale: bool = True) -> DataFrame:
    return rowwise(df, ["y"], lambda y: an.pca_fit(y, model, ncomps, rescale), "weights array<double>, yfit array<double>, scale double, chi_square double")


def build_mu(files: DataFrame, mode: str, energy: int = 0, i0: int = 1, it: int = 2, iref: int = 3, mu: int = 1, channels: tuple[int, ...] = ()) -> DataFrame:
    """Spectra from scanned column files (path, columns): one spec for all, errors kept as rows."""
    from edgelight.functions import pointwise as p

    def col(i):
        return F.get("columns", F.lit(i))

    used = {"transmission": (energy, i0, it), "reference": (energy, it, iref), "raw": (energy, mu), "fluorescence": (energy, i0, *channels)}[mode]
    checks = F.lit(None).cast("string")
    for i in reversed(used):
        checks = F.when(F.size("columns") <= i, F.lit(f"BadColumn({i})")).otherwise(checks)
    if mode == "fluorescence" and not channels:
        checks = F.lit("NoChannels")
    if mode == "transmission":
        y = F.zip_with(col(i0), col(it), p.mu_transmission)
    elif mode == "reference":
        y = F.zip_with(col(it), col(iref), p.mu_reference)
    elif mode == "raw":
        y = col(mu)
    else:
        total = col(channels[0]) if channels else F.array().cast("array<double>")
        for c in channels[1:]:
            total = p.channel_sum(total, col(c))
        y = F.zip_with(total, col(i0), p.ratio)
    error = F.coalesce(F.col("error"), checks)
    ok = error.isNull()
    return files.select("path", p.name_from_path(F.col("path")).alias("label"), F.when(ok, col(energy)).alias("energy"), F.when(ok, y).alias("mu"), F.when(ok, "ok").otherwise("failed").alias("status"), error.alias("error"))
