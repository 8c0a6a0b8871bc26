"""Fits whose parameters, paths and path expressions are tables: many fits in one job, each with its own sets.

Four tables meet by fit_id in one cogroup, so every fit has its own number of data sets, paths and variables, and a fit whose
tables do not belong together fails alone, as a row with its error:

* data: fit_id, dsid, k array, chi array
* params: fit_id, pos, name, kind (vary, fixed, const, expr), value, min, max, expr; in order of pos
* paths: fit_id, dsid, path, and what a path file holds (k, pha, amp, rep, lam, reff, degen, nleg, rnorman, gam_ch, rs_int, vint, vmu, vfermi, geom)
* specs: fit_id, dsid, path, name (of a path parameter), expr

A group is one fit: a few data sets of a few hundred points and the paths of these.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelight.kernels import fitting as ff
from edgelight.kernels import paths as pt
from edgelight.operators.fits import parameters
from edgelight.operators.spectra import rowwise

RESULT = "fit_id long, kind string, name string, dsid int, path int, value double, stderr double, k array<double>, chi array<double>, status string, error string"
MODES = ("fit", "none", "data")
#: Starting values of what all paths of a fit share, and of each path's own: its state and value
SHARED = {"amp": 0.9, "del_e0": 0.0, "alpha": 0.0}
LOCALS = {"N": ("set", 1.0), "sig": ("guess", 0.003), "third": ("off", 0.0), "fourth": ("off", 0.0)}


def packed(df: DataFrame, what: str, *keys: str) -> DataFrame:
    """Rows of a side table with their columns as one JSON text."""
    body = F.to_json(F.struct(*(c for c in df.columns if c != "fit_id")))
    whole = [F.col(c).cast("int").alias(c) if c in keys else F.lit(None).cast("int").alias(c) for c in ("dsid", "path", "pos")]
    return df.select(F.col("fit_id").cast("long").alias("fit_id"), F.lit(what).alias("what"), *whole, body.alias("body"))


def sets_of(data: pd.DataFrame, side: pd.DataFrame, transform: ff.Transform, epsilon_k: float | None, refine_bkg: bool) -> list[tuple[int, list[int], ff.DataSet]]:
    """(dsid, path numbers, data set) in order of dsid; paths and specs must be there for the same (dsid, path)."""
    rows = {what: [(d, p, json.loads(b)) for d, p, b in own[["dsid", "path", "body"]].itertuples(index=False)] for what, own in side.groupby("what")}
    paths = {(d, p): b for d, p, b in rows.get("path", [])}
    specs: dict = {}
    for d, p, b in rows.get("spec", []):
        specs.setdefault((d, p), {})[b["name"]] = b["expr"]
    if len(paths) < len(rows.get("path", [])):
        raise ff.FitError("Shape: a path stands twice")
    if odd := sorted(set(paths) ^ set(specs)):
        raise ff.FitError("Shape: path and spec are not both there for " + ", ".join(f"{int(d)}/{int(p)}" for d, p in odd))
    if lost := sorted({d for d, _ in paths} - set(data["dsid"])):
        raise ff.FitError("Shape: no data set " + ", ".join(str(int(d)) for d in lost))
    found = []
    for dsid, k, chi in data.sort_values("dsid")[["dsid", "k", "chi"]].itertuples(index=False):
        own = sorted(key for key in paths if key[0] == dsid)
        found.append((int(dsid), [int(p) for _, p in own], ff.DataSet(np.asarray(k, float), np.asarray(chi, float), [paths[key] for key in own], [specs[key] for key in own], transform, epsilon_k, refine_bkg)))
    return found


def fit_rows(data: pd.DataFrame, side: pd.DataFrame, transform: ff.Transform, epsilon_k: float | None, mode: str, refine_bkg: bool) -> Iterator[dict]:
    if not len(data):
        raise ff.FitError("Shape: no data set")
    sets = sets_of(data, side if mode != "data" else side[:0], transform, epsilon_k, refine_bkg)
    own = parameters([json.loads(b) for b in side[side["what"] == "param"].sort_values("pos")["body"]]) if mode != "data" else parameters([])
    plain = [ds for _, _, ds in sets]
    if mode == "fit":
        out = ff.fit(own, plain)
        for n in ("nvarys", "ndata", "n_idp", "nfev", "chi_square", "chi2_reduced", "rfactor", "aic", "bic"):
            yield {"kind": "stat", "name": n, "value": float(out[n])}
        for kind in ("best", "derived"):
            for b in out[kind]:
                yield {"kind": kind, "name": b["name"], "value": b["value"], "stderr": b["stderr"]}
        yield from correlations([b["name"] for b in out["best"]], out["covar"])
        for p in out["path_params"]:
            dsid, numbers, _ = sets[p["dataset"]]
            yield {"kind": "path", "name": p["name"], "dsid": dsid, "path": numbers[p["path"]], "value": p["value"], "stderr": p["stderr"]}
    else:
        for ds in plain:
            ds.prepare()
    symbols = own.resolve()
    for dsid, numbers, ds in sets:
        yield {"kind": "curve", "name": "data", "dsid": dsid, "k": ds.grid, "chi": ds.data}
        if mode != "data":
            values = ds.path_params(symbols)
            each = [pt.chi(f, ds.grid, p, ds.cubic) for f, p in zip(ds.paths, values)]
            yield {"kind": "curve", "name": "model", "dsid": dsid, "k": ds.grid, "chi": sum(each, np.zeros(len(ds.grid)))}
            for n, chi in zip(numbers, each):
                yield {"kind": "curve", "name": "path", "dsid": dsid, "path": n, "k": ds.grid, "chi": chi}


def correlations(names: list[str], covar: np.ndarray | None) -> Iterator[dict]:
    """One row for each pair of variables; zero where a variance is not positive, and none without a covariance."""
    if covar is None:
        return
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            size = covar[i, i] * covar[j, j]
            yield {"kind": "corr", "name": f"{a}, {names[j]}", "value": float(covar[i, j] / np.sqrt(size)) if size > 0 else 0.0}


def run_fits(data: DataFrame, params: DataFrame, paths: DataFrame, specs: DataFrame, transform: ff.Transform = ff.Transform(), epsilon_k: float | None = None, mode: str = "fit", refine_bkg: bool = False) -> DataFrame:
    """Rows of RESULT for every fit_id of any table.

    kind: stat, best, derived, corr (of two variables, named with a comma between), path (a path parameter of one path) and curve (data, model and path over k, without background splines). mode:
    fit; none, curves at the starting values only; data, data curves only, for which the other tables may be empty. A failed fit is one row with
    kind null. Fits without data fail; rows with a null fit_id are one fit of that name.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    side = packed(params, "param", "pos").unionByName(packed(paths, "path", "dsid", "path")).unionByName(packed(specs, "spec", "dsid", "path"))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = [r | {"status": "ok"} for r in fit_rows(left, right, transform, epsilon_k, mode, refine_bkg)]
        except Exception as e:  # an error is a result here
            rows = [{"status": "failed", "error": f"{type(e).__name__}: {e}"}]
        fit_id = next((v for side in (left, right) for v in side["fit_id"] if not pd.isna(v)), None)
        return pd.DataFrame({c: pd.Series([fit_id if c == "fit_id" else r.get(c) for r in rows], dtype=object) for c in names})

    own = data.select(F.col("fit_id").cast("long").alias("fit_id"), F.col("dsid").cast("int").alias("dsid"), "k", "chi")
    return own.groupBy("fit_id").cogroup(side.groupBy("fit_id")).applyInPandas(run, RESULT)


def wire(paths: DataFrame, own: DataFrame | None = None, shared: dict[str, float] = SHARED) -> tuple[DataFrame, DataFrame]:
    """(params, specs) in the usual wiring for a table of paths.

    Amplitude amp*N, energy shift del_e0, distance alpha*reff, displacement sig, cumulants third and fourth. What is a path's own
    (N, sig, third, fourth) is by default 1, a guess from 0.003, and 0 twice; `own` (fit_id, dsid, path, name, state, value) has others: state
    set is that number, guess a variable of the path (its name and the path's place in the fit, from 1), off zero.
    """
    place = F.row_number().over(Window.partitionBy("fit_id").orderBy("dsid", "path"))
    at = paths.select("fit_id", "dsid", "path", "degen", place.alias("place"))
    defaults = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("usual_state"), F.lit(v).alias("usual_value")) for n, (s, v) in LOCALS.items()))
    rows = at.withColumn("l", F.explode(defaults)).select("fit_id", "dsid", "path", "degen", "place", "l.*")
    if own is not None:
        rows = rows.join(own.select("fit_id", "dsid", "path", "name", "state", "value"), ["fit_id", "dsid", "path", "name"], "left")
    else:
        rows = rows.withColumn("state", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("double"))
    rows = rows.withColumn("value", F.when(F.col("state").isNull(), F.col("usual_value")).otherwise(F.coalesce("value", F.lit(0.0)))).withColumn("state", F.coalesce("state", "usual_state"))
    variable = F.concat("name", F.col("place").cast("string"))
    term = F.when(F.col("state") == "guess", variable).when(F.col("state") == "set", F.col("value").cast("string")).otherwise("0")
    spec = F.create_map(*(F.lit(x) for p in (("N", "s02"), ("sig", "sigma2"), ("third", "third"), ("fourth", "fourth")) for x in p))
    specs = rows.select("fit_id", "dsid", "path", F.element_at(spec, F.col("name")).alias("name"), F.when(F.col("name") == "N", F.concat(F.lit("amp*"), term)).otherwise(term).alias("expr"))
    fixed = F.array(*(F.struct(F.lit(n).alias("name"), e.alias("expr")) for n, e in (("degen", F.col("degen").cast("string")), ("e0", F.lit("del_e0")), ("ei", F.lit("0")), ("deltar", F.lit("alpha*reff")))))
    specs = specs.unionByName(at.select("fit_id", "dsid", "path", F.explode(fixed).alias("s")).select("fit_id", "dsid", "path", "s.*"))
    none = F.lit(None).cast("double")
    common = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for i, (n, v) in enumerate(shared.items())))
    params = at.select("fit_id").distinct().select("fit_id", F.explode(common).alias("p")).select("fit_id", "p.*")
    order = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(LOCALS) for x in (n, i))), F.col("name"))
    guesses = rows.where("state = 'guess'").select("fit_id", (len(shared) + F.col("place") * len(LOCALS) + order).cast("int").alias("pos"), variable.alias("name"), "value")
    params = params.unionByName(guesses).select("fit_id", "pos", "name", F.lit("vary").alias("kind"), "value", none.alias("min"), none.alias("max"), F.lit(None).cast("string").alias("expr"))
    return params, specs


#: Parts of a report: title and kind of result rows
PARTS = (("Statistics", "stat"), ("Variables", "best"), ("Fixed", "fixed"), ("Derived", "derived"), ("Correlations", "corr"), ("Paths", "path"))


def reports(results: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(fit_id, part, text) of run_fits() rows: statistics, variables, fixed values of `params`, derived values, correlations (the largest first) and
    path parameters (by data set, path and name), a line each. A part without rows has none; a fit that failed has a part Error.

    Lines are sorted within one part of one fit, which holds as many as it has variables, pairs or path parameters.
    """
    rows = results.where("status <> 'ok' or kind in ('stat', 'best', 'derived', 'corr', 'path')").select("fit_id", "kind", "name", "dsid", "path", "value", "stderr", "error")
    if params is not None:
        none = F.lit(None)
        fixed = params.where("kind = 'fixed'").select("fit_id", F.lit("fixed").alias("kind"), "name", none.cast("int").alias("dsid"), none.cast("int").alias("path"), "value", none.cast("double").alias("stderr"), none.cast("string").alias("error"))
        rows = rows.unionByName(fixed)
    number = lambda c: F.coalesce(F.when(F.isnan(c), F.lit("nan")).otherwise(F.format_string("%.6f", c)), F.lit(""))
    owner = F.when(F.col("kind") == "path", F.format_string("%d/%d ", F.col("dsid"), F.col("path"))).otherwise("")
    spread = F.when(F.col("stderr").isNotNull(), F.concat(F.lit(" +/- "), number(F.col("stderr")))).otherwise("")
    line = F.when(F.col("kind").isNull(), F.col("error")).otherwise(F.concat(owner, F.col("name"), F.lit(" = "), number(F.col("value")), spread))
    part = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for title, kind in PARTS for x in (kind, title))), F.col("kind")), F.lit("Error"))
    size = F.when(F.col("kind") == "corr", -F.abs("value")).otherwise(0.0)
    lines = F.array_sort(F.collect_list(F.struct(size.alias("size"), "dsid", "path", "name", line.alias("line"))))
    return rows.groupBy("fit_id", part.alias("part")).agg(lines.alias("l")).select("fit_id", "part", F.array_join("l.line", "\n", "").alias("text"))


#: What a table of saved items holds, and the path parameter it comes from
ITEMS = {"e0": "e0", "delr": "deltar", "n": "degen", "sigma2": "sigma2", "third": "third", "fourth": "fourth", "ei": "ei", "reff+delr": "deltar"}


def saved_items(results: DataFrame, item: str, first: int, last: int, paths: DataFrame | None = None) -> DataFrame:
    """A row per fit with path parameters: value and stderr of an item for paths first..last (in any order) as path<n> and path<n>_err, 0 where a path is not there.

    reff+delr adds each path's half length from `paths` (fit_id, dsid, path, reff); its uncertainty is that of delr. Of a path number in several data sets, the smallest dsid counts.
    """
    rows = results.where((F.col("kind") == "path") & F.col("path").isNotNull()).select("fit_id", "dsid", "path", "name", "value", "stderr")
    if item == "reff+delr":
        rows = rows.join(paths.select("fit_id", "dsid", "path", "reff"), ["fit_id", "dsid", "path"], "left").withColumn("value", F.col("value") + F.coalesce("reff", F.lit(0.0)))
    own = F.col("name") == ITEMS[item]
    cells = []
    for n in range(min(first, last), max(first, last) + 1):
        here = F.min_by(F.struct("value", "stderr"), F.when(own & (F.col("path") == n), F.col("dsid")))
        cells += [F.coalesce(here["value"], F.lit(0.0)).alias(f"path{n}"), F.coalesce(here["stderr"], F.lit(0.0)).alias(f"path{n}_err")]
    return rows.groupBy("fit_id").agg(*cells)


SPACES = "r array<double>, chir_re array<double>, chir_im array<double>, chir_mag array<double>, chir_pha array<double>, q array<double>, chiq_re array<double>, chiq_im array<double>, chiq_mag array<double>, chiq_pha array<double>"


def spaces(curves: DataFrame, transform: ff.Transform = ff.Transform(), rmax_out: float = 10.0) -> DataFrame:
    """Curve rows (k and chi arrays on the transform's grid, from 0) in all spaces: their other columns, then space (k, r, q), idx, x, re, im, mag, phase.

    In k stands the weighted curve (re), without the rest; phases are unwrapped. A curve that cannot be transformed has one row with null idx and its error.
    """
    keys = [c for c in curves.columns if c not in ("k", "chi", "status", "error")]
    done = rowwise(curves.select(*keys, "k", "chi"), ["k", "chi"], lambda k, chi: ff.outputs(transform, chi, rmax_out), SPACES)
    none, w = F.lit(None).cast("double"), float(transform.kweight[0])

    def rows(space, *columns):
        fields = F.arrays_zip(*(F.col(c).alias(n) for c, n in zip(columns, ("x", "re", "im", "mag", "phase"))))
        v = F.transform(fields, lambda p: F.struct(*(p[n].alias(n) if i < len(columns) else none.alias(n) for i, n in enumerate(("x", "re", "im", "mag", "phase")))))
        return F.transform(v, lambda p, i: F.struct(F.lit(space).alias("space"), i.alias("idx"), p.alias("p")))

    done = done.withColumn("weighted", F.zip_with("k", "chi", lambda k, c: c * F.pow(k, F.lit(w))))
    every = F.concat(rows("k", "k", "weighted"), rows("r", "r", *(f"chir_{c}" for c in ("re", "im", "mag", "pha"))), rows("q", "q", *(f"chiq_{c}" for c in ("re", "im", "mag", "pha"))))
    out = done.select(*keys, F.explode_outer(F.when(F.col("status") == "ok", every)).alias("v"), "status", "error")
    return out.select(*keys, "v.space", "v.idx", "v.p.*", "status", "error")


def view(rows: DataFrame, space: str, part: str = "mag") -> DataFrame:
    """What a plot of one space shows of spaces(): axis (k, r or q), x and y, with the other columns. space: K, R, Q, or KQ, which is K and Q. part: mag, re, im or phase; in k the weighted curve, whatever the part."""
    axes = {"K": ("k",), "R": ("r",), "Q": ("q",), "KQ": ("k", "q")}
    if space not in axes or part not in ("mag", "re", "im", "phase"):
        raise ValueError(f"no view {space} of {part}")
    y = F.when(F.col("space") == "k", F.col("re")).otherwise(F.col(part))
    keys = [c for c in rows.columns if c not in ("space", "idx", "x", "re", "im", "mag", "phase", "status", "error")]
    return rows.where(F.col("space").isin(*axes[space])).select(*keys, F.col("space").alias("axis"), "idx", "x", y.alias("y"))
