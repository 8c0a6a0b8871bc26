"""Fits over tables: one group per fit id, in parallel; each group holds its own data sets and paths, a few hundred points each."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from edgelight.functions.expressions import Parameters
from edgelight.kernels import fitting as ff

RESULT = "fit_id long, kind string, name string, value double, stderr double, status string, error string"


def parameters(rows: list[dict]) -> Parameters:
    """From rows name, kind (vary, fixed, const, expr), value, min, max, expr, in order."""
    out = Parameters()
    for r in rows:
        low, high = (-math.inf if r.get("min") is None else r["min"]), (math.inf if r.get("max") is None else r["max"])
        if r["kind"] == "vary":
            out.var(r["name"], r["value"], low, high)
        elif r["kind"] == "expr":
            out.constrain(r["name"], r["expr"], low, high)
        else:
            (out.fix if r["kind"] == "fixed" else out.const)(r["name"], r["value"])
    return out


def path_fit(data: DataFrame, params: list[dict], paths: list[dict], specs: list[dict], transform: ff.Transform = ff.Transform(), epsilon_k: float | None = None, mode: str = "fit", refine_bkg: bool = False) -> DataFrame:
    """One fit per fit_id over data (fit_id, dsid, k array, chi array) with one template for all.

    Rows (kind, name, value, stderr): stats, best, derived and path values. mode: 'fit', or 'none' to evaluate the model at
    the guesses only. Several data sets of a fit are its rows, in dsid order. A fit that fails is one row with its error.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fit_id, rows = int(key[0]), []
        try:
            sets = [ff.DataSet(np.asarray(k, float), np.asarray(c, float), paths, specs, transform, epsilon_k, refine_bkg) for k, c in pdf.sort_values("dsid")[["k", "chi"]].itertuples(index=False)]
            own = parameters(params)
            if mode == "fit":
                out = ff.fit(own, sets)
                rows += [("stat", n, float(out[n]), None) for n in ("nvarys", "ndata", "n_idp", "nfev", "chi_square", "chi2_reduced", "rfactor", "aic", "bic")]
                rows += [(kind, b["name"], b["value"], b["stderr"]) for kind in ("best", "derived") for b in out[kind]]
                rows += [("path", f"{p['dataset']}/{p['path']}/{p['name']}", p["value"], p["stderr"]) for p in out["path_params"]]
            else:
                models = ff.evaluate(own, sets)
                rows += [("model", f"{i}/rms", float(np.sqrt(np.mean(m * m))), None) for i, m in enumerate(models)]
            return pd.DataFrame([(fit_id, *r, "ok", None) for r in rows], columns=["fit_id", "kind", "name", "value", "stderr", "status", "error"])
        except Exception as e:
            return pd.DataFrame([(fit_id, None, None, None, None, "failed", f"{type(e).__name__}: {e}")], columns=["fit_id", "kind", "name", "value", "stderr", "status", "error"])

    return data.groupBy("fit_id").applyInPandas(run, RESULT)


def save_items(results: DataFrame, items: list[str], first: int = 1, last: int = 1) -> DataFrame:
    """Fits by rows and path parameters of paths first..last by columns, missing values 0."""
    from pyspark.sql import functions as F

    names = [f"0/{i - 1}/{n}" for n in items for i in range(first, last + 1)]
    rows = results.where(F.col("kind") == "path").groupBy("fit_id").pivot("name", names).agg(F.first("value"), F.first("stderr"))
    return rows.select("fit_id", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c.replace("/", "_").replace("_first(value)", "").replace("_first(stderr)", "_err")) for c in rows.columns if c != "fit_id"))


def template(path: str) -> dict:
    """A fit template stored as JSON."""
    with open(path) as f:
        return json.load(f)
