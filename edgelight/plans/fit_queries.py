"""Queries over fits whose parameters, paths and expressions are tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from edgelight.kernels import paths as pt
from edgelight.operators import fit_tables
from edgelight.plans.kernel_queries import FIT, demo_path
from edgelight.plans.native_queries import VECTORS, out

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A second shell is there for even fit ids only
SHELLS = [(2.55, 12.0, 0.004), (3.6, 6.0, 0.0056)]
FEFF = "k array<double>, pha array<double>, amp array<double>, rep array<double>, lam array<double>, reff double, degen double, nleg int, rnorman double, gam_ch double, rs_int double, vint double, vmu double, vfermi double, geom array<struct<label:string,iz:int,ipot:int,mass:double,x:double,y:double,z:double>>"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def tables(spark, sf):
    """(data, paths): a fit per label, of the shells it has, at a distance that follows from all its vectors."""
    import pandas as pd

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").cast("long").alias("fit_id"), F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v).alias("a"))
    rows = rows.groupBy("fit_id").agg(F.avg("a").alias("a"))

    def made(pdfs):
        k = 0.05 * np.arange(321)
        for pdf in pdfs:
            chis = []
            for fit_id, a in zip(pdf["fit_id"], pdf["a"]):
                own = SHELLS[: 2 - fit_id % 2]
                files = [demo_path(r, n) for r, n, _ in own]
                chis.append(pt.summed(files, [{"degen": n, "s02": 0.8, "e0": 1.0, "ei": 0.0, "deltar": 0.01 * np.tanh(a) * r, "sigma2": s, "third": 0.0, "fourth": 0.0} for r, n, s in own], k)[1])
            yield pd.DataFrame({"fit_id": pdf["fit_id"], "dsid": 0, "k": [k] * len(pdf), "chi": chis})

    data = rows.mapInPandas(made, "fit_id long, dsid int, k array<double>, chi array<double>")
    files = spark.createDataFrame([(i, demo_path(r, n)) for i, (r, n, _) in enumerate(SHELLS)], f"path int, feff struct<{FEFF.replace(' array', ':array').replace(' double', ':double').replace(' int', ':int')}>")
    paths = rows.select("fit_id").join(F.broadcast(files)).where("path < 2 - fit_id % 2").select("fit_id", F.lit(0).alias("dsid"), "path", "feff.*")
    return data, paths


TRUTH = """WITH a AS (SELECT label::BIGINT fit_id, 0.01 * tanh(avg(list_sum(embedding::DOUBLE[]))) alpha FROM embeddings GROUP BY label)
SELECT fit_id, unnest(['amp', 'del_e0', 'alpha', 'sig1']) "name", round(unnest([0.8, 1.0, alpha, 0.004]), 4) + 0.0 "value", 'ok' status FROM a
UNION ALL SELECT fit_id, 'sig2', 0.0056, 'ok' FROM a WHERE fit_id % 2 = 0"""


@query(TRUTH)
def path_fit_groups(spark, sf):
    """One fit per label, each with its own paths, wired the usual way; the data follow from known values, which the fits must find."""
    data, paths = tables(spark, sf)
    params, specs = fit_tables.wire(paths)
    found = fit_tables.run_fits(data, params, paths, specs, FIT, epsilon_k=1e-3).where("kind = 'best' or status <> 'ok'")
    return found.select("fit_id", "name", (F.round("value", 4) + 0.0).alias("value"), "status")


@query(None)
def fit_spaces(spark, sf):
    """Data, model and paths of the fits' starting models in k, r and q: the largest magnitude and the last phase of each."""
    data, paths = tables(spark, sf)
    params, specs = fit_tables.wire(paths)
    curves = fit_tables.run_fits(data, params, paths, specs, FIT, epsilon_k=1e-3, mode="none").select("fit_id", "name", "path", "k", "chi")
    rows = fit_tables.spaces(curves, FIT)
    return rows.groupBy("fit_id", "name", "path", "space").agg(F.round(F.max(F.coalesce("mag", "re")), 5).alias("largest"), F.round(F.max_by("phase", "idx"), 4).alias("phase"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {VECTORS} SELECT gid, CASE idx % 3 WHEN 0 THEN 'k' ELSE 'q' END axis, idx, round(x, 6) + 0.0 x, round(CASE idx % 3 WHEN 0 THEN y ELSE 2 * y END, 6) + 0.0 y FROM c WHERE idx % 3 <> 1")
def fit_view_kq(spark, sf):
    """The combined view of weighted k and of phases in q."""
    from edgelight import curves

    y, space = F.col("y"), F.element_at(F.array(F.lit("k"), F.lit("r"), F.lit("q")), F.col("idx") % 3 + 1)
    rows = curves.vector_curves(spark, sf).select("gid", space.alias("space"), "idx", "x", y.alias("re"), (-y).alias("im"), F.abs(y).alias("mag"), (2 * y).alias("phase"))
    return out(fit_tables.view(rows, "KQ", "phase"), ["gid", "axis", "idx"], "x", "y")


#: Lines of orders as rows of fit results: the first is a statistic, the next two are variables and the pair of them, the rest are parameters of paths
LINES = """l AS (SELECT l_orderkey fit_id, l_linenumber n, max(l_quantity)::DOUBLE q, max(l_discount)::DOUBLE d, max(l_tax)::DOUBLE t FROM lineitem GROUP BY ALL)"""


def order_results(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("fit_id"), F.col("l_linenumber").alias("n"))
    lines = lines.agg(F.max("l_quantity").cast("double").alias("q"), F.max("l_discount").cast("double").alias("d"), F.max("l_tax").cast("double").alias("t"))
    n, text = F.col("n"), lambda v: F.concat(F.lit(v), F.col("n").cast("string"))
    kind = F.when(n == 1, "stat").when(n <= 3, "best").when(n == 4, "corr").otherwise("path")
    name = F.when(n == 1, "rfactor").when(n <= 3, text("v")).when(n == 4, "v2, v3").otherwise("deltar")
    path = F.when(n > 4, (n - 4).cast("int"))
    return lines.select("fit_id", kind.alias("kind"), name.alias("name"), F.when(n > 4, 0).alias("dsid"), path.alias("path"), F.when(n == 4, -F.col("d")).otherwise(F.col("q")).alias("value"), F.when(n.isin(2, 3) | (n > 4), F.col("t")).alias("stderr"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))


@query(f"""WITH {LINES} SELECT fit_id, CASE WHEN n = 1 THEN 'Statistics' WHEN n <= 3 THEN 'Variables' WHEN n = 4 THEN 'Correlations' ELSE 'Paths' END part,
string_agg(CASE WHEN n = 1 THEN 'rfactor = ' || printf('%.6f', q) WHEN n <= 3 THEN 'v' || n || ' = ' || printf('%.6f', q) || ' +/- ' || printf('%.6f', t)
  WHEN n = 4 THEN 'v2, v3 = ' || printf('%.6f', -d) ELSE '0/' || (n - 4) || ' deltar = ' || printf('%.6f', q) || ' +/- ' || printf('%.6f', t) END, chr(10) ORDER BY n) "text" FROM l GROUP BY ALL
UNION ALL SELECT DISTINCT fit_id, 'Fixed', 'temp = ' || printf('%.6f', fit_id / 8::DOUBLE) FROM l WHERE fit_id % 2 = 0""")
def fit_reports(spark, sf):
    """Orders as fits: the parts of their reports."""
    results = order_results(spark, sf)
    params = results.select("fit_id").distinct().select("fit_id", F.lit("temp").alias("name"), F.when(F.col("fit_id") % 2 == 0, "fixed").otherwise("vary").alias("kind"), (F.col("fit_id") / 8).alias("value"))
    return fit_tables.reports(results, params)


@query(f"""WITH {LINES} SELECT fit_id, {", ".join(f"coalesce(max(round(q + (n - 4) / 4::DOUBLE, 6)) FILTER (WHERE n = {i + 4}), 0) + 0.0 path{i}, coalesce(max(round(t, 6)) FILTER (WHERE n = {i + 4}), 0) + 0.0 path{i}_err" for i in (1, 2, 3))} FROM l WHERE n > 4 GROUP BY fit_id""")
def saved_distances(spark, sf):
    """Orders as fits: half lengths with their shifts, for paths 3 to 1."""
    results = order_results(spark, sf)
    paths = results.where("path is not null").select("fit_id", "dsid", "path", (F.col("path") / 4).alias("reff"))
    wide = fit_tables.saved_items(results, "reff+delr", 3, 1, paths)
    return wide.select("fit_id", *((F.round(c, 6) + 0.0).alias(c) for c in wide.columns if c != "fit_id"))
