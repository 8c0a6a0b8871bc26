"""Queries that run numerical kernels. Spectra are made from the embeddings by Column expressions: an edge, a slope and oscillations whose sizes come from each vector."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelight.kernels import reduction as rd
from edgelight.kernels.fitting import Transform
from edgelight.operators import fits
from edgelight.operators import spectra as sx
from edgelight.operators.spread import spread

QUERIES: dict = {}
E0 = 8979.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings, in enough tasks for kernels."""
    return spread(spark.read.parquet(f"{sf}/embeddings.parquet"))


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """gid, energy and mu: 481 points from 150 eV before to 810 eV after the edge."""
    e = F.transform(F.sequence(F.lit(0), F.lit(480)), lambda i: F.lit(E0 - 150) + i * F.lit(2.0))
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = vectors(spark, sf).select(F.col("vec_id").alias("gid"), "label", v(0).alias("a"), v(1).alias("b"), e.alias("energy"))

    def mu(x):
        d = x - E0
        k = F.sqrt(F.greatest(d, F.lit(0.0)) * 0.2625)
        wave = F.when(d > 0, (F.lit(0.1) + 0.2 * F.col("a")) * F.sin(4.6 * k) * F.exp(-0.01 * k * k) / (1 + k))
        return 0.6 - 3e-4 * d + (1 + 0.5 * F.col("b")) * (0.5 + F.atan(d / 1.5) / math.pi) * (1 - 2e-4 * d) + F.coalesce(wave, F.lit(0.0))

    return rows.withColumn("mu", F.transform("energy", mu)).select("gid", "label", "energy", "mu")


def sums(df: DataFrame, *arrays: str, scalars: tuple = ()) -> DataFrame:
    """Key, status and short digests of results."""
    total = [F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), 0.0).otherwise(x)), 4).alias(f"{a}_sum") for a in arrays]
    return df.select("gid", *(F.round(s, 4).alias(s) for s in scalars), *total, "status")


@query
def find_e0(spark, sf):
    return sums(sx.find_e0(spectra(spark, sf)), scalars=("e0",))


@query
def pre_edge(spark, sf):
    return sums(sx.pre_edge(spectra(spark, sf)), "norm", "flat", "dmude", scalars=("e0", "edge_step", "pre1", "norm2"))


@query
def autobk(spark, sf):
    return sums(sx.autobk(spectra(spark, sf), err_sigma=1.0), "bkg", "chi", scalars=("ek0", "edge_step"))


@query
def reduce_all(spark, sf):
    return sums(sx.reduce_all(spectra(spark, sf)), "norm", "chi", "chir_mag", scalars=("e0", "edge_step"))


@query
def xftf(spark, sf):
    k = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(0.25))
    df = vectors(spark, sf).select(F.col("vec_id").alias("gid"), k.alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("chi"))
    return sums(sx.xftf(df), "chir_re", "chir_mag")


@query
def xftr(spark, sf):
    k = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(0.25))
    df = vectors(spark, sf).select(F.col("vec_id").alias("gid"), k.alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("chi"))
    return sums(sx.xftr(sx.xftf(df)), "chiq_re", "chiq_mag")


@query
def rebin_xafs(spark, sf):
    return sums(sx.rebin(spectra(spark, sf), e0=E0), "mu", "energy")


@query
def smooth_mu(spark, sf):
    return sums(sx.smooth(spectra(spark, sf), sigma=2.0), "mu")


def _normed(spark, sf):
    return sx.pre_edge(spectra(spark, sf)).select("gid", "energy", "norm")


@query
def deconvolve(spark, sf):
    return sums(sx.deconvolve(_normed(spark, sf)), "deconv")


@query
def convolve(spark, sf):
    return sums(sx.convolve(_normed(spark, sf)), "conv")


def _with_f(spark, sf):
    f2 = F.transform("energy", lambda e: 0.5 + 3.4 * (0.5 + F.atan((e - E0) / 1.0) / math.pi) * F.pow(F.lit(E0) / e, F.lit(2.8)))
    return spectra(spark, sf).withColumn("f2", f2).withColumn("f1", F.transform("energy", lambda e: F.lit(-6.0) + F.ln(F.abs(e - E0) + 1) / 3))


@query
def mback(spark, sf):
    return sums(sx.mback(_with_f(spark, sf)), "fpp", "norm", scalars=("s", "edge_step"))


@query
def mback_norm(spark, sf):
    return sums(sx.mback_norm(_with_f(spark, sf)), "norm", scalars=("edge_step", "scale"))


@query
def diffkk(spark, sf):
    return sums(sx.diffkk(_with_f(spark, sf)), "fp", "fpp", scalars=("s",))


def _chi(spark, sf):
    return sx.autobk(spectra(spark, sf)).select("gid", "label", "k", "chi")


@query
def cauchy(spark, sf):
    return sums(sx.cauchy(_chi(spark, sf)), "mag")


@query
def morlet(spark, sf):
    return sums(sx.morlet(_chi(spark, sf), rows=64), "mag")


def _rows(spark, sf):
    return vectors(spark, sf).select(F.col("vec_id").alias("gid"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("y"))


@query
def lincombo_fit(spark, sf):
    grid = 0.05 * np.arange(64)
    return sums(sx.lincombo(_rows(spark, sf), [np.cos(3 * grid), np.sin(2 * grid), np.exp(-grid)]), "weights", scalars=("rfactor",))


def label_means(df: DataFrame) -> DataFrame:
    """(gid, y): the mean curve of each label over all its rows, as many curves as labels."""
    mean = df.select("label", F.posexplode("y").alias("idx", "v")).groupBy("label", "idx").agg(F.avg("v").alias("v"))
    return mean.groupBy(F.col("label").alias("gid")).agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).getField("v").alias("y"))


@query
def pca_fit(spark, sf):
    """Every spectrum by a model of the mean curves of all labels."""
    df = _rows(spark, sf)
    model = sx.pca_train(label_means(df))
    return sums(sx.pca_fit(df, model), "yfit", scalars=("scale", "chi_square"))


@query
def pca_fit_all(spark, sf):
    """Every spectrum by a model of all spectra."""
    df = _rows(spark, sf)
    return sums(sx.pca_fit(df, sx.pca_train(df)), "yfit", scalars=("scale", "chi_square"))


def demo_path(reff: float, degen: float) -> dict:
    """A smooth made-up path: enough to exercise a fit without instrument files."""
    k = np.concatenate([np.arange(0, 2, 0.1), np.arange(2, 20.1, 0.5)])
    pha = -0.8 * k + 3 - 4 / (1 + k)
    amp = 0.6 * k * np.exp(-k / 6) / (1 + 0.05 * k * k)
    geom = [{"label": "Cu", "iz": 29, "ipot": i, "mass": 63.546, "x": 0.0, "y": 0.0, "z": i * reff} for i in (0, 1)]
    return {"k": k.tolist(), "pha": pha.tolist(), "amp": amp.tolist(), "rep": (k + 0.2).tolist(), "lam": (8 + 0.5 * k).tolist(), "reff": reff, "degen": degen, "nleg": 2, "rnorman": 2.63, "gam_ch": 1.7, "rs_int": 2.0, "vint": -18.0, "vmu": -5.5, "vfermi": 12.4, "geom": geom}


PARAMS = [{"name": "amp", "kind": "vary", "value": 0.9}, {"name": "del_e0", "kind": "vary", "value": 0.0}, {"name": "alpha", "kind": "vary", "value": 0.0}, {"name": "sig1", "kind": "vary", "value": 0.004, "min": 0.0}, {"name": "sig2", "kind": "expr", "expr": "1.4*sig1"}]
SPECS = [{"s02": "amp", "e0": "del_e0", "deltar": "alpha*reff", "sigma2": f"sig{i}"} for i in (1, 2)]
FIT = Transform(kmin=3, kmax=14, kweight=(2,), dk=1, window="hanning", rmin=1.2, rmax=3.8)


def _fit_data(spark, sf):
    """chi(k) of two paths, one fit per label, at the mean distance of the label's vectors."""
    from edgelight.kernels import paths as pt

    paths = [demo_path(2.55, 12.0), demo_path(3.6, 6.0)]

    def made(pdfs):  # a row per label
        import pandas as pd

        k = 0.05 * np.arange(321)
        for pdf in pdfs:
            chis = [pt.summed(paths, [dict(degen=f["degen"], s02=0.9, e0=1.0, ei=0.0, deltar=0.02 * a * f["reff"], sigma2=s, third=0.0, fourth=0.0) for f, s in zip(paths, (0.004, 0.0056))], k)[1] for a in pdf["a"]]
            yield pd.DataFrame({"fit_id": pdf["gid"], "dsid": 0, "k": [k] * len(pdf), "chi": chis})

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy(F.col("label").cast("long").alias("gid")).agg(F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("a"))
    return rows.mapInPandas(made, "fit_id long, dsid int, k array<double>, chi array<double>"), paths


@query
def path_fit(spark, sf):
    data, paths = _fit_data(spark, sf)
    out = fits.path_fit(data, PARAMS, paths, SPECS, FIT, epsilon_k=1e-3)
    return out.where("kind in ('best', 'derived') or status <> 'ok'").select("fit_id", "kind", "name", F.round("value", 5).alias("value"), "status")


@query
def path_fit_eval(spark, sf):
    data, paths = _fit_data(spark, sf)
    return fits.path_fit(data, PARAMS, paths, SPECS, FIT, mode="none").select("fit_id", "kind", "name", F.round("value", 6).alias("value"), "status")


@query
def fit_items(spark, sf):
    data, paths = _fit_data(spark, sf)
    return fits.save_items(fits.path_fit(data, PARAMS, paths, SPECS, FIT, epsilon_k=1e-3), ["deltar", "sigma2"], 1, 2)


@query
def expr_column(spark, sf):
    """A constraint expression lowered to a Column."""
    from edgelight.functions import expressions as ex

    c = ex.column(ex.parse("sqrt(p*q) + log(p) * 2 ** 0.5 - p % 7 + min(p, q, 20)"), {"p": F.col("l_quantity"), "q": F.col("l_extendedprice")})
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", (F.round(c, 6) + 0.0).alias("v"))


SQL = {
    "expr_column": "SELECT l_orderkey, round(sqrt(l_quantity * l_extendedprice) + ln(l_quantity) * power(2, 0.5) - (l_quantity - 7 * floor(l_quantity / 7)) + least(l_quantity, l_extendedprice, 20), 6) + 0.0 v FROM lineitem",
}
