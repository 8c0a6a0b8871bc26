"""Fits over tables: own paths by fit id, failures alone, wiring, curves in all spaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelight.kernels import fitting as ff
from edgelight.kernels import paths as pt
from edgelight.operators import fit_tables as ft
from edgelight.plans.fit_queries import FEFF
from edgelight.plans.kernel_queries import FIT, demo_path

K = 0.05 * np.arange(321)
DATA = "fit_id long, dsid int, k array<double>, chi array<double>"


def chi(shells, s02=0.8, e0=1.0, alpha=0.002):
    files = [demo_path(r, n) for r, n, _ in shells]
    return pt.summed(files, [{"degen": n, "s02": s02, "e0": e0, "ei": 0.0, "deltar": alpha * r, "sigma2": s, "third": 0.0, "fourth": 0.0} for r, n, s in shells], K)[1]


def path_rows(spark, rows):
    """From (fit_id, dsid, path, reff, degen)."""
    names = [c.split()[0] for c in FEFF.split(", ")]
    made = [(f, d, p, *(demo_path(r, n)[c] for c in names)) for f, d, p, r, n in rows]
    return spark.createDataFrame(made, "fit_id long, dsid int, path int, " + FEFF)


def data_rows(spark, rows):
    return spark.createDataFrame([(f, d, K.tolist(), c.tolist()) for f, d, c in rows], DATA)


ONE, TWO = [(2.55, 12.0, 0.004)], [(2.55, 12.0, 0.004), (3.6, 6.0, 0.006)]


def test_fits_with_other_paths_in_one_job_and_one_that_does_not_fit(spark):
    data = data_rows(spark, [(1, 0, chi(ONE)), (2, 0, chi(TWO)), (3, 0, chi(TWO)), (4, 0, chi(ONE)), (4, 1, chi(TWO))])
    paths = path_rows(spark, [(1, 0, 0, 2.55, 12.0), (2, 0, 0, 2.55, 12.0), (2, 0, 5, 3.6, 6.0), (3, 0, 0, 2.55, 12.0), (3, 0, 1, 3.6, 6.0), (4, 0, 0, 2.55, 12.0), (4, 1, 0, 2.55, 12.0), (4, 1, 1, 3.6, 6.0), (6, 0, 0, 2.55, 12.0)])
    params, specs = ft.wire(paths)
    specs = specs.where("not (fit_id = 3 and path = 1)")
    found = ft.run_fits(data, params, paths, specs, FIT, epsilon_k=1e-3).collect()
    best = {}
    for r in found:
        if r.kind == "best":
            best.setdefault(r.fit_id, {})[r.name] = r.value
    assert {f: sorted(b) for f, b in best.items()} == {1: ["alpha", "amp", "del_e0", "sig1"], 2: ["alpha", "amp", "del_e0", "sig1", "sig2"], 4: ["alpha", "amp", "del_e0", "sig1", "sig2", "sig3"]}
    want = {"amp": 0.8, "del_e0": 1.0, "alpha": 0.002, "sig1": 0.004}
    for own in best.values():
        assert all(abs(own[n] - v) < 1e-5 for n, v in want.items())
    assert abs(best[2]["sig2"] - 0.006) < 1e-5 and abs(best[4]["sig2"] - 0.004) < 1e-5 and abs(best[4]["sig3"] - 0.006) < 1e-5
    failed = {r.fit_id: r.error for r in found if r.status != "ok"}
    assert set(failed) == {3, 6} and "0/1" in failed[3] and "data set" in failed[6]
    assert {(r.dsid, r.path) for r in found if r.fit_id == 2 and r.kind == "path"} == {(0, 0), (0, 5)}
    curves = {(r.name, r.path): np.array(r.chi) for r in found if r.fit_id == 2 and r.kind == "curve"}
    assert set(curves) == {("data", None), ("model", None), ("path", 0), ("path", 5)}
    assert np.allclose(curves["model", None], curves["path", 0] + curves["path", 5]) and np.allclose(curves["model", None], curves["data", None], atol=1e-5)


def test_modes_without_a_fit(spark):
    data = data_rows(spark, [(1, 0, chi(ONE))])
    paths = path_rows(spark, [(1, 0, 0, 2.55, 12.0)])
    params, specs = ft.wire(paths)
    only = ft.run_fits(data, params.limit(0), paths.limit(0), specs.limit(0), FIT, mode="data").collect()
    assert [(r.kind, r.name, r.status) for r in only] == [("curve", "data", "ok")] and np.allclose(only[0].chi, chi(ONE))
    start = {r.name: r for r in ft.run_fits(data, params, paths, specs, FIT, mode="none").collect()}
    assert set(start) == {"data", "model", "path"}
    assert np.allclose(start["model"].chi, chi([(2.55, 12.0, 0.003)], 0.9, 0.0, 0.0))
    assert ft.run_fits(data.limit(0), params.limit(0), paths.limit(0), specs.limit(0), FIT).count() == 0
    with pytest.raises(ValueError):
        ft.run_fits(data, params, paths, specs, mode="later")


def test_wiring_of_what_is_a_paths_own(spark):
    paths = path_rows(spark, [(1, 0, 3, 2.55, 12.0), (1, 0, 7, 3.6, 6.0)])
    own = spark.createDataFrame([(1, 0, 3, "N", "guess", 1.5), (1, 0, 3, "sig", "set", 0.005), (1, 0, 7, "third", "guess", 1e-4), (1, 0, 7, "sig", "off", 9.0)], "fit_id long, dsid int, path int, name string, state string, value double")
    params, specs = ft.wire(paths, own, {"amp": 1.0, "del_e0": 0.0, "alpha": 0.0})
    assert [(r.name, r.value, r.kind) for r in params.orderBy("pos").collect()] == [("amp", 1.0, "vary"), ("del_e0", 0.0, "vary"), ("alpha", 0.0, "vary"), ("N1", 1.5, "vary"), ("third2", 1e-4, "vary")]
    texts = {(r.path, r.name): r.expr for r in specs.collect()}
    assert len(texts) == 16
    assert {k: texts[k] for k in ((3, "s02"), (3, "sigma2"), (3, "degen"), (7, "s02"), (7, "third"), (7, "sigma2"), (7, "fourth"))} == {(3, "s02"): "amp*N1", (3, "sigma2"): "0.005", (3, "degen"): "12.0", (7, "s02"): "amp*1.0", (7, "third"): "third2", (7, "sigma2"): "0", (7, "fourth"): "0"}


def test_spaces_and_views(spark):
    c = chi(TWO)
    rows = ft.spaces(spark.createDataFrame([(1, "data", K.tolist(), c.tolist()), (2, "data", None, None)], "fit_id long, name string, k array<double>, chi array<double>"), FIT)
    got = {}
    for r in rows.where("fit_id = 1").orderBy("idx").collect():
        got.setdefault(r.space, []).append(r)
    want = ff.outputs(FIT, c)
    assert np.allclose([r.re for r in got["k"]], c * K**2) and all(r.mag is None for r in got["k"])
    for space, name in (("r", "chir"), ("q", "chiq")):
        assert np.allclose([r.x for r in got[space]], want[space])
        for part in ("re", "im", "mag"):
            assert np.allclose([getattr(r, part) for r in got[space]], want[f"{name}_{part}"])
        assert np.allclose([r.phase for r in got[space]], want[f"{name}_pha"])
    assert len(got["q"]) == int(1.05 + 16 / 0.05) and max(r.x for r in got["r"]) <= 10.0
    # explicit sums at some points
    win = FIT.kwin()[: len(K)]
    for i in (5, 60, 90):
        z = 0.05 / np.sqrt(np.pi) * np.sum(c * K**2 * win * np.exp(2j * K * want["r"][i]))
        assert abs(abs(z) - got["r"][i].mag) < 1e-9
    assert [(r.space, r.status) for r in rows.where("fit_id = 2").collect()] == [(None, "skipped")]
    fine = rows.where("fit_id = 1")
    assert {r.axis for r in ft.view(fine, "KQ", "re").collect()} == {"k", "q"}
    assert ft.view(fine, "R", "phase").count() == len(got["r"]) and ft.view(fine, "K", "im").columns == ["fit_id", "name", "axis", "idx", "x", "y"]
    with pytest.raises(ValueError):
        ft.view(fine, "E")


def test_reports_and_saved_items(spark):
    row = "fit_id long, kind string, name string, dsid int, path int, value double, stderr double, status string, error string"
    rows = [
        (1, "best", "amp", None, None, 0.9, 0.1, "ok", None), (1, "corr", "a, b", None, None, 0.2, None, "ok", None), (1, "corr", "a, c", None, None, -0.8, None, "ok", None),
        (1, "path", "deltar", 0, 2, 0.5, float("nan"), "ok", None), (1, "path", "e0", 0, 2, 7.0, 0.3, "ok", None), (1, "path", "deltar", 1, 2, 9.0, 9.0, "ok", None),
        (1, "curve", "data", 0, None, None, None, "ok", None), (2, None, None, None, None, None, None, "failed", "no data"),
    ]
    df = spark.createDataFrame(rows, row)
    text = {(r.fit_id, r.part): r.text for r in ft.reports(df).collect()}
    assert text[1, "Variables"] == "amp = 0.900000 +/- 0.100000"
    assert text[1, "Correlations"] == "a, c = -0.800000\na, b = 0.200000"
    assert text[1, "Paths"].split("\n") == ["0/2 deltar = 0.500000 +/- nan", "0/2 e0 = 7.000000 +/- 0.300000", "1/2 deltar = 9.000000 +/- 9.000000"]
    assert text[2, "Error"] == "no data" and len(text) == 4
    paths = spark.createDataFrame([(1, 0, 2, 2.5), (1, 1, 2, 4.0)], "fit_id long, dsid int, path int, reff double")
    got = ft.saved_items(df, "reff+delr", 2, 1, paths).collect()
    assert len(got) == 1 and got[0].path1 == got[0].path1_err == 0.0 and got[0].path2 == 3.0
    assert ft.saved_items(df, "e0", 2, 2).head().path2_err == 0.3
    assert ft.reports(df.where("fit_id = 9")).collect() == []


def test_correlations_of_a_covariance():
    got = list(ft.correlations(["a", "b", "c"], np.array([[4.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]])))
    assert [(r["name"], r["value"]) for r in got] == [("a, b", 0.5), ("a, c", 0.0), ("b, c", 0.0)]
    assert list(ft.correlations(["a"], None)) == []
