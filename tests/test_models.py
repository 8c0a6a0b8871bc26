"""Displacements as Columns, recurrences, constraint sets and images within a tolerance against kernels and plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelight.functions.displacement import sigma2_debye
from edgelight.kernels import paths as pt
from edgelight.kernels import reduction as rd
from edgelight.operators import lattice, ordered, param_sets

ATOM = "array<struct<x:double,y:double,z:double,mass:double>>"
SET = "set_id int, pos int, name string, kind string, value double, min double, max double, expr string"


def test_displacement_is_the_kernels_for_any_number_of_legs(spark):
    r = np.random.default_rng(3)
    rows = []
    for i, n in enumerate((0, 1, 2, 3, 4, 5)):
        geom = [{"x": float(a), "y": float(b), "z": float(c), "mass": float(m)} for (a, b, c), m in zip(r.normal(scale=2, size=(n, 3)), r.uniform(20, 90, n))]
        rows += [(i, float(t), float(theta), geom) for t, theta in ((300, 315), (10, 315), (0, 400), (900, 150))]
    df = spark.createDataFrame(rows, f"i int, t double, theta double, geom {ATOM}")
    for row, (_, t, theta, geom) in zip(df.select("i", sigma2_debye(F.col("t"), F.col("theta"), F.lit(2.63), F.col("geom")).alias("s")).collect(), rows):
        if len(geom) == 1:  # a leg to itself has no direction
            assert row.s is None
        else:
            assert row.s == pytest.approx(pt.sigma2_debye(t, theta, 2.63, geom), rel=1e-9, abs=1e-15)


def test_quadrature_has_settled():
    far, one = np.array([0.0, 2.5, 9.0, 25.0]), np.full(4, 64.0**2)
    for t, theta in ((300.0, 315.0), (4.0, 400.0), (1e-5, 300.0)):
        w, weight = pt.debye_nodes(600)
        want = pt.DEBYE_SCALE / theta * (np.sinc(np.multiply.outer(far, w) * pt.DEBYE_WAVE / (2.63 * np.pi)) @ (weight * w / np.tanh(w * theta / (2 * t)))) / 64.0
        assert np.allclose(pt.debye_correlation(far, theta, t, one, 2.63), want, rtol=1e-5, atol=1e-8)


@pytest.mark.parametrize("b, a", [([1.0], [1.0]), ([0.5, 0.5], [2.0]), ([0.2, 0.3], [1.0, -0.5, 0.25]), ([1.0, 0.0, 2.0], [0.5, 0.1])])
def test_recursive_filters(spark, b, a):
    y = np.random.default_rng(1).normal(size=30)
    got = {r.gid: r.z for r in ordered.iir(spark.createDataFrame([(1, y.tolist()), (2, []), (3, None), (4, [1.0, None, 2.0])], "gid int, y array<double>"), b, a).collect()}
    assert np.allclose(got[1], rd.iir(b, a, y)) and got[2] == [] and got[3] is None and len(got[4]) == 3
    with pytest.raises(ValueError):
        ordered.iir(spark.createDataFrame([(1, [1.0])], "gid int, y array<double>"), b, [0.0, 1.0])


def sets(spark, made):
    rows = []
    for i, own in made.items():
        for pos, (name, what) in enumerate(own.items()):
            rows.append((i, pos, name, "expr" if isinstance(what, str) else "vary", None if isinstance(what, str) else float(what), None, None, what if isinstance(what, str) else None))
    return spark.createDataFrame(rows, SET)


def test_order_and_values_of_constraints(spark):
    made = {
        1: {"c": "b + a", "b": "2 * a", "a": 3.0},
        2: {"p": "q + 1", "q": "sin(p)", "after": "p * x", "x": 1.0, "free": "x + 1"},
        3: {"self": "self + 1", "u": "1e3 + max(v, 2)", "v": "exp(0)"},
        4: {"alone": 1.0},
        5: {"bad": "1 +", "k": 1.0},
    }
    got = {}
    for r in param_sets.order(sets(spark, made)).collect():
        got.setdefault(r.set_id, {})[r.name] = (r.level, r.status)
    assert got == {1: {"b": (1, "ok"), "c": (2, "ok")}, 2: {"p": (None, "cycle"), "q": (None, "cycle"), "after": (None, "after"), "free": (1, "ok")}, 3: {"self": (None, "cycle"), "v": (1, "ok"), "u": (2, "ok")}, 5: {"bad": (1, "ok")}}
    values = {}
    for r in param_sets.resolve(sets(spark, made)).collect():
        values.setdefault(r.set_id, {})[r.name] = r.value if r.status == "ok" else r.error
    assert values[1] == {"a": 3.0, "b": 6.0, "c": 9.0} and values[4] == {"alone": 1.0}
    assert all(set(values[i]) == {None} for i in (2, 3, 5)) and "p" in values[2][None] and "q" in values[2][None]
    assert param_sets.order(sets(spark, made).limit(0)).count() == 0


def test_a_thousand_sets_at_once(spark):
    rows = spark.range(1000).select(F.col("id").cast("int").alias("set_id"), F.posexplode(F.array(*(F.struct(F.lit(f"n{i}").alias("name"), F.lit(f"n{i - 1} + 1" if i else None).cast("string").alias("expr")) for i in range(12)))).alias("pos", "r"))
    none = F.lit(None).cast("double")
    params = rows.select("set_id", "pos", "r.name", F.when(F.col("r.expr").isNull(), "fixed").otherwise("expr").alias("kind"), F.col("set_id").cast("double").alias("value"), none.alias("min"), none.alias("max"), "r.expr")
    assert {(r.name, r.level) for r in param_sets.order(params).where("set_id = 999").collect()} == {(f"n{i}", i) for i in range(1, 12)}
    last = param_sets.resolve(params).where("name = 'n11'").collect()
    assert len(last) == 1000 and all(r.value == r.set_id + 11 for r in last)


def test_sets_are_resolved_without_a_call_each(spark):
    """Many small sets are the usual case: no Python call for each of them; their ids and odd values are kept."""
    rows = [(s, p, n, k, v, low, None, e) for s in ("a", "b", None) for p, n, k, v, low, e in ((2, "y", "expr", None, None, "x * z"), (0, "x", "vary", 1.0, 2.0, None), (1, "z", "fixed", 5.0, None, None), (3, "z", "fixed", 7.0, None, None))]
    rows += [("nan", 0, "x", "vary", float("nan"), None, None, None), ("none", 0, "x", "fixed", None, None, None, None), ("last", None, "z", "fixed", 3.0, None, None, None), ("last", 9, "z", "fixed", 2.0, None, None, None)]
    found = param_sets.resolve(spark.createDataFrame(rows, SET.replace("set_id int", "set_id string")))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    values = {(r.set_id, r.name): r.value for r in got if r.status == "ok"}
    assert values == {(s, n): v for s in ("a", "b", None) for n, v in (("x", 2.0), ("z", 7.0), ("y", 14.0))} | {("last", "z"): 3.0}
    assert {(r.set_id, r.name, r.error.split(":")[0]) for r in got if r.status == "failed"} == {("nan", None, "TypeError"), ("none", None, "TypeError")}


def images_plain(sites, ops, tol=1e-4):
    kept = []
    for _, element, *f in sorted(sites):
        for _, m, s in sorted(ops):
            g = [s[i] + sum(m[3 * i + j] * f[j] for j in range(3)) for i in range(3)]
            g = [v - np.floor(v) for v in g]
            if not any(e == element and all(abs((p - q) - round(p - q)) < tol for p, q in zip(h, g)) for e, h in kept):
                kept.append((element, g))
    return sorted((e, *map(float, g)) for e, g in kept)


def test_images_within_a_tolerance(spark):
    r = np.random.default_rng(4)
    base = r.uniform(size=(12, 3)).round(2)
    sites = [(i, f"e{i % 2}", *map(float, base[i % 12] + r.normal(scale=2e-5, size=3))) for i in range(60)]
    # across a border of cells, across the border of the whole cell, and a chain in which each is near the next only
    sites += [(100, "b", 0.12345 - 5e-7, 0.5, 0.5), (101, "b", 0.12345 + 5e-7, 0.5, 0.5), (102, "b", 1e-7, 0.0, 0.3), (103, "b", -1e-7, 0.99999999, 0.3)]
    sites += [(110 + i, "chain", 0.4 + 0.8e-4 * i, 0.1, 0.2) for i in range(7)]
    ops = [(0, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], [0.0, 0.0, 0.0]), (1, [-1.0, 0, 0, 0, -1.0, 0, 0, 0, 1.0], [0.0, 0.0, 0.5]), (2, [0, 1.0, 0, 1.0, 0, 0, 0, 0, 1.0], [0.5, 0.0, 0.0])]
    got = lattice.expand_within(spark.createDataFrame(sites, "site_id int, element string, fx double, fy double, fz double"), spark.createDataFrame([(i, list(map(float, m)), s) for i, m, s in ops], "op int, rotation array<double>, shift array<double>"))
    found, want = sorted(map(tuple, got.collect())), images_plain(sites, ops)
    assert len(found) == len(want) and all(a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-12) for a, b in zip(found, want))
