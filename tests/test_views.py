"""Views over many curves against plain programs; kernels over many rows."""

import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from edgelight.operators import spectra, views


def wide_plain(curves):
    """Lines of curves {gid: [(x, y), ...]} side by side, each with its own x."""
    body = {i: "\t".join("%.6f\t%.6f" % c[i] if i < len(c) else "\t" for _, c in sorted(curves.items())) for i in range(max(map(len, curves.values())))}
    return body | {-1: "".join(f"u{g}_x\tu{g}\t" for g in sorted(curves))}


def test_many_curves_side_by_side_take_work_by_the_point(spark):
    """Every curve looked up among all of them took minutes here."""
    curves = {g: [(g + i / 7, (g % 11 - 5) * 0.37 + i) for i in range(1 + (g % 3 == 1) + (g in (1030, 5000) or g % 997 == 1))] for g in range(90000)}
    rows = spark.createDataFrame([(g, i, x, y) for g, c in curves.items() for i, (x, y) in enumerate(c)], "gid long, idx int, x double, y double").repartition(4).cache()
    rows.count()
    began = time.perf_counter()
    got = {r.line: r.text for r in views.wide_lines(rows.selectExpr("*", "concat('u', gid) label")).collect()}
    took = time.perf_counter() - began
    rows.unpersist()
    assert got == wide_plain(curves)
    assert took < 60, took


def test_a_curve_without_a_name_or_a_sample(spark):
    """Curves without gid come last; a missing value is blank in a pair, and absent on a common grid."""
    schema = "gid long, label string, idx int, x double, y double"
    pairs = [(2, "b", 0, 1.0, 2.0), (1, "a", 0, 3.0, None), (None, "c", 0, 5.0, 6.0), (None, "c", 1, 7.0, 8.0)]
    got = {r.line: r.text for r in views.wide_lines(spark.createDataFrame(pairs, schema)).collect()}
    assert got == {-1: "a_x\ta\tb_x\tb\tc_x\tc\t", 0: "3.000000\t\t1.000000\t2.000000\t5.000000\t6.000000", 1: "\t\t\t\t7.000000\t8.000000"}
    same = [(2, "b", 0, 1.0, 2.0), (1, "a", 0, 1.0, None), (None, "c", 0, 1.0, 6.0)]
    got = {r.line: r.text for r in views.wide_lines(spark.createDataFrame(same, schema)).collect()}
    assert got == {-1: "x\ta\tb\tc\t", 0: "1.000000\t2.000000\t6.000000"}
    assert views.wide_lines(spark.createDataFrame([], schema)).count() == 0


def test_kernel_results_go_back_in_bounded_batches(spark):
    """A batch of many rows, whose results are many times the inputs, comes back in frames of a few MB, with every row in its place."""
    schema = spark.createDataFrame([], "gid long, energy array<double>, note string").schema
    taken = {}
    table = SimpleNamespace(schema=schema, mapInPandas=lambda run, kind: taken.update(run=run, names=kind.names))

    def kernel(e):
        if e[0] % 100 == 7:
            raise ValueError("bad")
        return {"total": e.sum(), "wide": np.tile(e, 100)}

    spectra.rowwise(table, ["energy"], kernel, "total double, wide array<double>")
    arrays = [None if i % 1000 == 3 else np.full(30, float(i)) for i in range(2500)]
    frames = list(taken["run"](iter([pd.DataFrame({"gid": range(2500), "energy": arrays, "note": "n"}), pd.DataFrame({"gid": [], "energy": [], "note": []})])))
    assert max(sum(8 * len(a) for c in ("energy", "wide") for a in f[c] if a is not None) for f in frames) <= spectra.BATCH_BYTES + 100_000
    rows = pd.concat(frames)
    assert list(rows.columns) == taken["names"] and rows.gid.tolist() == list(range(2500))
    for i, status, total, wide in zip(rows.gid, rows.status, rows.total, rows.wide):
        assert status == ("skipped" if i % 1000 == 3 else "failed" if i % 100 == 7 else "ok")
        assert (wide is None and np.isnan(total)) if status != "ok" else (total == 30 * i and len(wide) == 3000 and (wide == i).all())


@pytest.mark.parametrize("name, inputs, count", [("reduce_all", ["energy", "mu"], 150), ("deconvolve", ["energy", "norm"], 600), ("convolve", ["energy", "norm"], 600)])
def test_queries_over_kernels_send_bounded_batches(spark, name, inputs, count):
    energy = 8829.0 + 2 * np.arange(481)
    mu = 0.6 + 0.5 + np.arctan((energy - 8979) / 1.5) / np.pi + 0.01 * np.sin(energy / 20)
    table, taken = SimpleNamespace(schema=spark.createDataFrame([], f"gid long, {inputs[0]} array<double>, {inputs[1]} array<double>").schema), {}
    table.mapInPandas = lambda run, kind: taken.update(run=run, kind=kind)
    getattr(spectra, name)(table)
    frames = list(taken["run"](iter([pd.DataFrame({"gid": range(count), inputs[0]: [energy] * count, inputs[1]: [mu] * count})])))
    arrays = [f.name for f in taken["kind"] if f.dataType.typeName() == "array"]
    assert max(sum(8 * len(a) for c in arrays for a in f[c]) for f in frames) <= spectra.BATCH_BYTES + 100_000
    rows = pd.concat(frames)
    assert rows.gid.tolist() == list(range(count)) and set(rows.status) == {"ok"} and len(frames) > 1
