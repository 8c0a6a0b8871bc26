import math

import numpy as np
import pytest

from edgelight.functions import expressions as ex
from edgelight.kernels import analysis as an
from edgelight.kernels import fitting as ff
from edgelight.kernels import fourier as ft
from edgelight.kernels import paths as pt
from edgelight.kernels import reduction as rd
from edgelight.kernels import splines as sp
from edgelight.kernels.lm import lmfit
from edgelight.plans.kernel_queries import FIT, PARAMS, SPECS, demo_path
from edgelight.operators.fits import parameters


def edge(n=481, wave=0.1):
    e = 8829.0 + 2.0 * np.arange(n)
    d = e - 8979.0
    k = np.sqrt(np.maximum(d, 0) * 0.2625)
    return e, 0.6 - 3e-4 * d + 1.2 * (0.5 + np.arctan(d / 1.5) / np.pi) * (1 - 2e-4 * d) + np.where(d > 0, wave * np.sin(4.6 * k) * np.exp(-0.01 * k * k) / (1 + k), 0)


def test_bspline_interpolates_and_agrees_with_the_tridiagonal_form():
    x = np.sort(np.random.default_rng(1).uniform(0, 10, 30))
    y = np.sin(x)
    new = np.linspace(x[0], x[-1], 101)
    t, c = sp.fitted(x, y)
    assert np.allclose(sp.basis(t, new) @ c, sp.banded_interp(x, y, new), atol=1e-9)
    assert np.allclose(sp.operator(x, new) @ y, sp.banded_interp(x, y, new), atol=1e-8)


def test_cubic_is_reproduced_inside_and_outside():
    x = np.linspace(0, 5, 12)
    f = lambda v: v**3 - 2 * v + 1
    new = np.linspace(-1, 6, 50)
    assert np.allclose(sp.interp_cubic(x, f(x), new), f(new), atol=1e-9)


def test_minimiser_on_known_problems():
    rosen = lmfit(lambda x: np.array([10 * (x[1] - x[0] ** 2), 1 - x[0]]), [-1.2, 1.0])
    assert np.allclose(rosen.x, 1, atol=1e-8)
    a = np.array([[1.0, 2], [3, 4], [5, 6]])
    b = np.array([1.0, 2, 3.5])
    lin = lmfit(lambda x: a @ x - b, [0.0, 0.0])
    assert np.allclose(lin.x, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-7)
    assert np.allclose(lin.covar(), np.linalg.inv(a.T @ a), rtol=1e-5)


def test_windows_are_one_inside_and_zero_outside():
    k = 0.05 * np.arange(301)
    for kind in ("hanning", "parzen", "welch"):
        w = ft.window(k, kind, 3, 12, 1)
        assert w[120] == 1 and w[10] == 0 and w[290] == 0
    assert ft.window(k, "kaiser", 3, 12, 4)[150] == pytest.approx(1, abs=1e-3)


def test_forward_transform_peaks_at_distance_and_reverse_recovers():
    k = 0.05 * np.arange(281)
    out = ft.xftf(k, np.sin(2 * 2.3 * k), 2, 12, 0, 1)
    assert out["r"][np.argmax(np.abs(out["chir"]))] == pytest.approx(2.3, abs=0.04)
    back = ft.xftr(out["r"], out["chir"], 0.5, 5, 0.5)
    mid = (back["q"] > 5) & (back["q"] < 9)
    assert np.abs(back["chiq"][mid]).mean() == pytest.approx(1, abs=0.05)


def test_stationary_special_values():
    assert rd.t_quantile(0.95, 100) == pytest.approx(1.66023432606575, abs=1e-10)
    assert rd.t_quantile(0.025, 30) == pytest.approx(-2.042272456301238, abs=1e-10)
    assert pt.gnxas(2.5, 0.05, 0.3, 2.55) == pytest.approx(4.393525791371315, rel=1e-12)
    pair = [{"mass": 63.546, "x": 0.0, "y": 0.0, "z": z} for z in (0.0, 2.5478)]
    assert pt.sigma2_einstein(300, 335, pair) == pytest.approx(0.00449678280017058, rel=1e-9)
    assert 0.003 < pt.sigma2_debye(300, 315, 2.63, pair) < 0.01


def test_edge_and_normalisation():
    e, mu = edge()
    assert abs(rd.find_e0(e, mu) - 8979) <= 2
    pe = rd.pre_edge(e, mu)
    assert pe["edge_step"] == pytest.approx(1.2, rel=0.03)
    assert len(pe["norm"]) == len(pe["energy"])
    assert abs(pe["flat"][-50:].mean() - 1) < 0.02


def test_unsorted_and_bad_points_are_cleaned():
    e, mu = edge()
    order = np.random.default_rng(0).permutation(len(e))
    bad = mu.copy()
    bad[7] = np.nan
    pe = rd.pre_edge(e[order], bad[order])
    assert len(pe["energy"]) == len(e) - 1 and (np.diff(pe["energy"]) > 0).all()


def test_background_keeps_the_oscillation():
    e, mu = edge(wave=0.3)
    out = rd.autobk(e, mu)
    r = ft.xftf(out["k"], out["chi"], 2, 12, 2, 1)
    assert r["r"][np.argmax(np.abs(r["chir"]))] == pytest.approx(2.3, abs=0.15)
    bands = rd.autobk_bands(out)
    assert (bands["delta_chi"] >= 0).all()


def test_remove_dups_raises_runs():
    assert np.allclose(rd.remove_dups([1.0, 1.0, 1.0, 2.0]), [1.0, 1.0005, 1.001, 2.0])


def test_convolution_then_deconvolution():
    e, mu = edge(241, 0.0)
    norm = rd.pre_edge(e, mu)["norm"]
    wide = rd.convolve(e, norm, esigma=2.0)
    assert np.abs(wide[20:-20] - norm[20:-20]).max() < 0.5
    assert np.isfinite(rd.deconvolve(e, norm, esigma=1.0)).all()
    assert rd.iir([1.0], [1.0, -0.5], [1, 0, 0, 0]).tolist() == [1, 0.5, 0.25, 0.125]
    assert np.allclose(rd.quotient(np.array([1.0, 0, 0, 0]), np.array([1.0, -0.5, 0, 0]), 4), [1, 0.5, 0.25, 0.125])


def test_rebin_of_a_line_is_the_line():
    e = np.arange(8800.0, 9700.0, 0.5)
    out = rd.rebin(e, e / 1000, 8979.0)
    ok = np.isfinite(out["mu"])
    assert np.abs(out["mu"][ok] - out["energy"][ok] / 1000).max() < 0.01


def test_mback_recovers_scale():
    e, _ = edge()
    f2 = 0.5 + 3.4 * (0.5 + np.arctan((e - 8979) / 1.0) / np.pi)
    got = rd.mback(e, (f2 + 0.2 + 1e-4 * (e - 8979)) / 2.5, f2)
    assert got["s"] == pytest.approx(2.5, rel=1e-6)
    assert np.allclose(got["fpp"], f2, atol=1e-6)


def test_kk_of_a_resonance():
    e = np.linspace(1, 400, 4000)
    f = 1 / ((e - 100) ** 2 + 25) * 5
    assert rd.kk_transform(e, f)[800] != 0 and np.isfinite(rd.kk_transform(e, f)).all()


def test_lincombo_and_pca():
    x = np.linspace(0, 1, 50)
    a, b = np.sin(5 * x), x**2
    fit = an.lincombo(0.3 * a + 0.7 * b, [a, b])
    assert np.allclose(fit["weights"], [0.3, 0.7]) and fit["weights"].sum() == pytest.approx(1)
    rng = np.random.default_rng(3)
    rows = np.array([w * a + (1 - w) * b + 1e-6 * rng.normal(size=50) for w in np.linspace(0, 1, 8)])
    model = an.pca_train(rows)
    assert model["nsig"] <= 2 and model["eigenvalues"][0] > 10 * model["eigenvalues"][1]
    assert an.pca_fit(rows[2], model, 2)["chi_square"] < 0.05
    with pytest.raises(ValueError):
        an.lincombo(a, [a])


@pytest.mark.parametrize("text,value", [("-2**2", -4), ("2**3**2", 512), ("-7 % 3", 2), ("7 % -3", -2), ("1/0", math.inf), ("min(3, 1, 2)", 1), ("ln(e)", 1), ("sqrt(-1)", math.nan), ("a*pi", 2 * math.pi)])
def test_expressions(text, value):
    got = ex.evaluate(ex.parse(text), {"a": 2.0})
    assert (math.isnan(got) and math.isnan(value)) or got == pytest.approx(value)


@pytest.mark.parametrize("text,kind", [("a $ b", "BadChar"), ("1_0", "BadNumber"), ("1 +", "Parse"), ("zz + 1", "UnknownVar"), ("nope(1)", "UnknownFunc"), ("sin(1, 2)", "Arity")])
def test_expression_errors(text, kind):
    with pytest.raises(ex.ExprError) as e:
        ex.evaluate(ex.parse(text), {})
    assert e.value.kind == kind


def test_gradients_match_differences():
    e = ex.parse("a**2*sin(b) + max(a, b)/b - atan2(a, b) % 2 + f(a)")
    sym, grads = {"a": 1.3, "b": 0.7}, {"a": np.array([1.0, 0]), "b": np.array([0, 1.0])}
    extra = {"f": (1, lambda v: v**3)}
    _, g = ex.evaluate_grad(e, sym, grads, 2, extra)
    for i, n in enumerate("ab"):
        up, down = dict(sym), dict(sym)
        up[n] += 1e-6
        down[n] -= 1e-6
        assert g[i] == pytest.approx((ex.evaluate(e, up, extra) - ex.evaluate(e, down, extra)) / 2e-6, rel=1e-5)


def test_constraints_resolve_in_order_and_report_cycles():
    p = ex.Parameters().constrain("c", "b + 1").constrain("b", "2*a").var("a", 3.0, 0, 2)
    assert p.resolve() == {"a": 2.0, "b": 4.0, "c": 5.0}
    p.constrain("a", "c")
    with pytest.raises(ex.ParamError, match="cycle"):
        p.resolve()


@pytest.mark.parametrize("low,high", [(-math.inf, math.inf), (0, math.inf), (-math.inf, 5), (0, 5)])
def test_bounds_round_trip(low, high):
    x = ex.to_internal(2.0, low, high)
    assert ex.to_external(x, low, high) == pytest.approx(2.0)
    assert ex.bound_scale(x, low, high) == pytest.approx((ex.to_external(x + 1e-6, low, high) - ex.to_external(x - 1e-6, low, high)) / 2e-6, rel=1e-6)


@pytest.mark.parametrize("space,count", [("k", 220), ("r", 168), ("q", 220), ("w", None)])
def test_fit_recovers_parameters(space, count):
    from dataclasses import replace

    paths = [demo_path(2.55, 12.0), demo_path(3.6, 6.0)]
    k = 0.05 * np.arange(321)
    true = [dict(degen=f["degen"], s02=0.85, e0=1.5, ei=0.0, deltar=0.003 * f["reff"], sigma2=s, third=0.0, fourth=0.0) for f, s in zip(paths, (0.005, 0.007))]
    chi = pt.summed(paths, true, k)[1]
    out = ff.fit(parameters(PARAMS), [ff.DataSet(k, chi, paths, SPECS, replace(FIT, space=space), 1e-3)])
    best = {b["name"]: b["value"] for b in out["best"]}
    assert best["amp"] == pytest.approx(0.85, abs=1e-4) and best["alpha"] == pytest.approx(0.003, abs=1e-5) and best["sig1"] == pytest.approx(0.005, abs=1e-5)
    assert count is None or out["ndata"] == count


def test_fit_errors():
    with pytest.raises(ff.FitError, match="Shape"):
        ff.fit(parameters(PARAMS), [ff.DataSet(np.arange(10.0), np.zeros(10), [demo_path(2.5, 1)], [])])


def test_pca_training_curves_come_from_all_rows(spark):
    from edgelight.plans import kernel_queries as kq

    df = spark.createDataFrame([(i, i % 3, [float(i), 1.0, -float(i)]) for i in range(90)], "gid long, label int, y array<double>")
    got = {r.gid: r.y for r in kq.label_means(df).collect()}
    assert got == {k: [43.5 + k, 1.0, -43.5 - k] for k in range(3)}


def test_pca_fit_query_depends_on_all_rows(spark, tmp_path):
    from edgelight.plans import kernel_queries as kq

    r = np.random.default_rng(3)
    rows = [(i, i % 5, [float(v) for v in r.normal(size=64)]) for i in range(100)]
    for name, far in (("a", 1.0), ("b", 9.0)):  # they differ in rows of ids from 60 on only
        changed = [(i, k, [v * far if i >= 60 and j < 8 else v for j, v in enumerate(y)]) for i, k, y in rows]
        spark.createDataFrame(changed, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / name / "embeddings.parquet"))
    a, b = ({x.gid: x.chi_square for x in kq.pca_fit(spark, str(tmp_path / n)).collect()} for n in "ab")
    assert len(a) == len(b) == 100 and sum(abs(a[i] - b[i]) > 1e-6 for i in range(60)) > 50
