"""Grids that are tables, cubic interpolation, small dense systems and components against numpy and the kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelight.functions.dense import solve
from edgelight.kernels import analysis, splines
from edgelight.operators import components, leastsq, resample

CURVE = "gid long, idx int, x double, y double"


def long_rows(curves):
    return [(g, i, float(x), float(y)) for g, (xs, ys) in curves.items() for i, (x, y) in enumerate(zip(xs, ys))]


def made(seed=1, sizes=(1, 2, 3, 4, 5, 6, 9, 40)):
    r = np.random.default_rng(seed)
    return {g: (np.cumsum(r.uniform(0.1, 1, n)) + g, r.normal(size=n)) for g, n in enumerate(sizes)}


def grids(curves, seed=2):
    r = np.random.default_rng(seed)
    return {g: np.sort(np.concatenate([r.uniform(x[0] - 2, x[-1] + 2, 25), x[:2], x[-1:]])) for g, (x, _) in curves.items()}


def by_gid(df):
    found = {}
    for g, x, y in df.select("gid", "x", "y").collect():
        found.setdefault(g, []).append((x, y))
    return {g: sorted(v, key=lambda p: (p[0] is None, p[0] or 0)) for g, v in found.items()}


def test_linear_onto_own_grids(spark):
    curves = made()
    own = grids(curves)
    df, grid = spark.createDataFrame(long_rows(curves), CURVE), spark.createDataFrame([(g, float(x)) for g, xs in own.items() for x in xs] + [(99, 1.0), (2, None)], "gid long, x double")
    got = by_gid(resample.linear(df, grid))
    for g, (x, y) in curves.items():
        assert np.allclose([v for at, v in got[g] if at is not None], np.interp(own[g], x, y))
    assert got[99] == [(1.0, None)] and (None, None) in got[2]
    inside = by_gid(resample.linear(df, grid, outside="null"))
    for g, (x, y) in curves.items():
        for at, v in inside[g]:
            assert (v is None) == (at is None or not x[0] <= at <= x[-1])
    assert resample.linear(df.limit(0), grid.limit(0)).count() == 0
    with pytest.raises(ValueError):
        resample.linear(df, grid, outside="left")


def test_linear_has_no_grid_in_its_plan_and_takes_large_grids(spark):
    df = spark.createDataFrame(long_rows({1: ([0.0, 1.0, 3.0], [0.0, 10.0, 30.0])}), CURVE)
    grid = spark.range(100_000).select(F.lit(1).alias("gid"), (F.col("id") * 4e-5 - 0.5).alias("x"))
    out = resample.linear(df, grid)
    assert out.where("abs(y - least(greatest(x, 0), 3) * 10) > 1e-9 or y is null").count() == 0 and out.count() == 100_000
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_steps_and_gaps_in_curves(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 1.0, 5.0), (1, 3, None, 9.0), (1, 4, 2.0, 6.0)], CURVE)
    grid = spark.createDataFrame([(1, x) for x in (0.5, 1.0, 1.5, 2.0)], "gid long, x double")
    assert by_gid(resample.linear(df, grid))[1] == [(0.5, 0.5), (1.0, 5.0), (1.5, 5.5), (2.0, 6.0)]


def test_cubic_is_the_kernels(spark):
    curves = made(3)
    own = grids(curves, 4)
    wide = spark.createDataFrame([(g, x.tolist(), y.tolist()) for g, (x, y) in curves.items()] + [(50, [], []), (51, None, None)], "gid long, x array<double>, y array<double>")
    grid = spark.createDataFrame([(g, float(x)) for g, xs in own.items() for x in xs] + [(50, 1.0), (51, 1.0)], "gid long, x double")
    got = by_gid(resample.cubic(wide, grid))
    for g, (x, y) in curves.items():
        want = np.full(len(own[g]), y[0]) if len(x) == 1 else splines.interp_cubic(x, y, own[g])
        assert np.allclose([v for _, v in got[g]], want, rtol=1e-9, atol=1e-9), g
    assert got[50] == got[51] == [(1.0, None)]
    # a cubic comes back as it is, outside too
    x = np.array([0.0, 0.4, 1.0, 1.1, 2.0, 2.5, 4.0])
    f = np.polynomial.Polynomial([1.0, -2.0, 0.5, 0.25])
    one = spark.createDataFrame([(1, x.tolist(), f(x).tolist())], wide.schema)
    out = by_gid(resample.cubic(one, spark.createDataFrame([(1, v) for v in (-1.0, 0.7, 3.3, 6.0)], grid.schema)))[1]
    assert np.allclose([v for _, v in out], f(np.array([-1.0, 0.7, 3.3, 6.0])))


def test_common_grid_is_the_first_ones(spark):
    r = np.random.default_rng(5)
    curves = {g: (np.cumsum(r.uniform(0.1, 0.3, 60)) + 0.1 * g, r.normal(size=60)) for g in range(4)}
    wide = spark.createDataFrame([(g, x.tolist(), y.tolist()) for g, (x, y) in curves.items()], "gid long, x array<double>, y array<double>")
    lo, hi = max(x[0] for x, _ in curves.values()), min(x[-1] for x, _ in curves.values())
    x0, y0 = curves[0]
    keep = slice(int(np.searchsorted(x0, lo, "right")) - 1, int(np.searchsorted(x0, hi, "right")))
    got = by_gid(resample.common_grid(wide))
    for g, (x, y) in curves.items():
        want = y0[keep] if g == 0 else splines.interp_cubic(x, y, x0[keep])
        assert np.allclose([a for a, _ in got[g]], x0[keep]) and np.allclose([b for _, b in got[g]], want)
    apart = spark.createDataFrame([(1, [0.0, 1.0], [1.0, 2.0]), (2, [5.0, 6.0], [1.0, 2.0])], wide.schema)
    assert resample.common_grid(apart).count() == 0 and resample.common_grid(wide.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_dense_systems(spark, n):
    r = np.random.default_rng(n)
    made = [np.hstack([a, r.normal(size=(n, 1))]) for a in r.normal(size=(6, n, n))]
    if n > 1:
        made[1][0, 0] = 0.0  # needs a swap
        made[2][1] = made[2][0]  # singular
    got = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(made)], "i int, m array<array<double>>").select("i", solve(F.col("m"), n).alias("x")).orderBy("i").collect()
    for row, m in zip(got, made):
        if n > 1 and row.i == 2:
            assert all(v is None for v in row.x)
        else:
            assert np.allclose(row.x, np.linalg.solve(m[:, :n], m[:, n]))


@pytest.mark.parametrize("degree", range(6))
def test_polynomials(spark, degree):
    curves = made(7, (1, 3, 8, 50))
    got = {g: c for g, c in leastsq.polyfit(spark.createDataFrame(long_rows(curves), CURVE), degree).collect()}
    for g, (x, y) in curves.items():
        if len(x) > degree:
            want = np.polynomial.Polynomial.fit(x, y, degree).convert().coef if len(x) > 1 else [y[0]]
            assert np.allclose(np.polynomial.Polynomial(got[g])(x), np.polynomial.Polynomial(want)(x), atol=1e-6), (g, degree)
        else:
            assert got[g] is None or None in got[g]


def test_combinations_of_four_components(spark):
    r = np.random.default_rng(11)
    comps, y = r.normal(size=(4, 30)), r.normal(size=(3, 30))
    df = spark.createDataFrame([(g, i, 0.0, float(v)) for g, row in enumerate(y) for i, v in enumerate(row)], CURVE)
    columns = [F.get(F.array(*(F.lit(float(v)) for v in c)), F.col("idx")) for c in comps]
    for row in leastsq.lcf(df, columns).collect():
        want = analysis.lincombo(y[row.gid], comps, True)
        assert np.allclose(row.weights, want["weights"], atol=1e-7) and abs(row.rfactor - want["rfactor"]) < 1e-7


def test_components_of_many_spectra_are_those_of_pairs(spark):
    r = np.random.default_rng(12)
    for n, size in ((12, 30), (40, 9), (5, 5)):
        rows = r.normal(size=(n, 3)) @ r.normal(size=(3, size)) + 0.1 * r.normal(size=(n, size))
        df = spark.createDataFrame([(v.tolist(),) for v in rows], "y array<double>").repartition(3)
        model, want = components.train(df), analysis.pca_train(rows)
        k = min(n, size) - 2
        assert np.allclose(model["mean"], want["mean"]) and np.allclose(model["eigenvalues"][:k], want["eigenvalues"][:k])
        assert np.allclose(np.abs(model["components"][:k]), np.abs(want["components"][:k]), atol=1e-9)
        assert np.allclose(model["ind"][:k], want["ind"][:k])
        a, b = (analysis.pca_fit(rows[0], m, 3) for m in (model, want))
        assert np.allclose(a["yfit"], b["yfit"]) and abs(a["chi_square"] - b["chi_square"]) < 1e-9
    with pytest.raises(ValueError):
        components.train(df.limit(0))


def test_components_of_more_spectra_than_pairs_could_take(spark):
    df = spark.range(5000).select(F.array(*(F.sin(F.col("id") * (0.01 * i + 0.1)) for i in range(16))).alias("y"))
    model = components.train(df)
    rows = np.array([x.y for x in df.collect()])
    z = rows - rows.mean(axis=0)
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, keepdims=True)
    assert np.allclose(model["eigenvalues"], np.linalg.eigvalsh(z.T @ z / 5000)[::-1], atol=1e-9)
