"""Texts as columns: nulls, failures, clashing names, and noise against its kernel's definition."""

import math

import numpy as np
import pytest

from edgelight.kernels.fitting import Transform
from edgelight.operators import spectra, texts


def test_nulls_and_failures_are_rows(spark):
    rows = [(1, "1 2\n3 4\n"), (2, None), (3, ""), (4, "words"), (1, "1 2\n3 4\n")]
    got = texts.parse(spark.createDataFrame(rows, "id long, content string"), "chi").collect()
    assert [r.status for r in got] == ["ok", "skipped", "failed", "failed", "ok"]
    assert got[0].k == [1.0, 3.0] and got[0].chi == [2.0, 4.0] and got[1].k is None
    assert got[2].error == "NoData" and got[0].error is None


def test_empty_table(spark):
    got = texts.parse(spark.createDataFrame([], "id long, content string"), "columns")
    assert got.collect() == [] and "labels" in got.columns


def test_one_column_is_no_chi_file(spark):
    got = texts.parse(spark.createDataFrame([("1\n2\n",)], "content string"), "chi").head()
    assert got.status == "failed" and got.error == "BadColumn(1)"


def test_clashing_names_are_an_error_and_others_stay(spark):
    df = spark.createDataFrame([(5, "1 2\n", "own")], "a long, content string, label string")
    assert texts.parse(df, "chi").head().label == "own"
    with pytest.raises(ValueError, match="status"):
        texts.parse(df.withColumnRenamed("label", "Status"), "chi")


def test_long_text_is_whole(spark):
    content = "".join(f"{i} {i / 7}\n" for i in range(200_000))
    got = texts.parse(spark.createDataFrame([(content,)], "content string"), "chi").selectExpr("size(k) n", "element_at(chi, -1) last").head()
    assert got.n == 200_000 and got.last == pytest.approx(199_999 / 7)


def test_noise_grows_with_the_curve_and_fails_alone(spark):
    t = Transform(kmin=2, kmax=12, dk=1, window="hanning")
    k = (0.05 * np.arange(300)).tolist()
    rng = np.random.default_rng(1)
    chi = (1e-3 * rng.standard_normal(300)).tolist()
    df = spark.createDataFrame([(1, k, chi), (2, k, [10 * c for c in chi]), (3, k, None)], "gid long, k array<double>, chi array<double>")
    one, ten, none = spectra.noise(df, t).orderBy("gid").collect()
    assert ten.eps_r == pytest.approx(10 * one.eps_r) and ten.eps_k == pytest.approx(10 * one.eps_k)
    assert none.status == "skipped" and none.eps_k is None
    spread = math.pi * 5 / (0.05 * (12**5 - 2**5))
    assert one.eps_k == pytest.approx(one.eps_r * math.sqrt(2 * spread))
    short = spectra.noise(df.where("gid = 1"), Transform(kmin=2, kmax=12, nfft=128, kstep=0.2, dk=1, window="hanning")).head()
    assert short.status == "failed" and "15" in short.error
