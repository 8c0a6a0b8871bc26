"""Operators that reduce a curve, or many curves, to values. Partial aggregation does the work before any shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelight.curves import by_curve
from edgelight.functions.pointwise import ratio


def index_of(at: float) -> Column:
    """Aggregate: largest index with x <= at, 0 if there is none; x need not be sorted."""
    return F.coalesce(F.max(F.when(F.col("x") <= at, F.col("idx"))), F.lit(0))


def index_nearest(at: float) -> Column:
    """Aggregate: first index of the least distance to at."""
    return F.min(F.struct(F.abs(F.col("x") - at), F.col("idx"))).getField("idx")


def first_max() -> Column:
    return F.min(F.struct(-F.col("y"), F.col("idx"), F.col("x"), F.col("y")))


def first_min() -> Column:
    return F.min(F.struct(F.col("y"), F.col("idx"), F.col("x")))


def peak_between_indices(df: DataFrame, lo: float, hi: float, valley: bool = False) -> DataFrame:
    """First largest (smallest) y between index_of(lo) and index_of(hi), both included."""
    every = Window.partitionBy("gid")
    df = df.withColumn("a", F.coalesce(F.max(F.when(F.col("x") <= lo, F.col("idx"))).over(every), F.lit(0)))
    df = df.withColumn("b", F.coalesce(F.max(F.when(F.col("x") <= hi, F.col("idx"))).over(every), F.lit(0)))
    best = first_min() if valley else first_max()
    got = df.where(F.col("idx").between(F.least("a", "b"), F.greatest("a", "b"))).groupBy("gid").agg(best.alias("p"))
    return got.select("gid", "p.idx", "p.x", "p.y" if valley else F.col("p.y").alias("y"))


def peak_in_range(df: DataFrame, lo: float, hi: float, y: str = "y") -> DataFrame:
    """First largest y with x in [lo, hi]; curves without such points give no row."""
    rows = df.where(F.col("x").between(lo, hi)).groupBy("gid").agg(F.min(F.struct(-F.col(y), F.col("idx"), F.col("x"))).alias("p"), F.count(F.lit(1)).alias("n"))
    return rows.select("gid", F.col("p.x").alias("x_peak"), (-F.col("p.col1")).alias("y_peak"), "n")


def x_at_y(df: DataFrame, level: Column | float) -> DataFrame:
    """Where the first segment that brackets the level crosses it, linear; a flat segment gives its low end."""
    w = by_curve()
    level = level if isinstance(level, Column) else F.lit(level)
    df = df.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w)).withColumn("level", level)
    hit = (F.least("y0", "y") <= F.col("level")) & (F.col("level") <= F.greatest("y0", "y"))
    at = F.when(F.col("y") == F.col("y0"), F.col("x0")).otherwise(F.col("x0") + (F.col("level") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("y") - F.col("y0")))
    return df.where("y0 is not null").where(hit).withColumn("at", at).groupBy("gid").agg(F.min(F.struct("idx", "at")).alias("p")).select("gid", F.col("p.at").alias("x_at"))


def half_max(df: DataFrame) -> DataFrame:
    """First crossing of half the largest y, on the rising side."""
    top = F.max("y").over(Window.partitionBy("gid"))
    return x_at_y(df.withColumn("half", top / 2), F.col("half"))


def centroid(df: DataFrame) -> DataFrame:
    rows = df.groupBy("gid").agg(F.sum(F.col("x") * F.col("y")).alias("a"), F.sum("y").alias("b"))
    return rows.where(F.abs("b") > 1e-300).select("gid", (F.col("a") / F.col("b")).alias("centroid"))


def polyfit(df: DataFrame, degree: int) -> DataFrame:
    """Least squares of degree 1 or 2 from sums of powers of u, x mapped to [-1, 1] for each curve; low to high coefficients of x."""
    every = Window.partitionBy("gid")
    df = df.withColumn("lo", F.min("x").over(every)).withColumn("hi", F.max("x").over(every))
    mid, half = (F.col("hi") + F.col("lo")) / 2, F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 2).otherwise(F.lit(1.0))
    df = df.withColumn("mid", mid).withColumn("half", half).withColumn("u", (F.col("x") - F.col("mid")) / F.col("half"))
    powers = [F.sum(F.pow("u", F.lit(float(p)))).alias(f"s{p}") for p in range(2 * degree + 1)]
    moments = [F.sum(F.col("y") * F.pow("u", F.lit(float(p)))).alias(f"t{p}") for p in range(degree + 1)]
    s = df.groupBy("gid").agg(*powers, *moments, F.first("mid").alias("m"), F.first("half").alias("h"))
    c = F.col
    if degree == 1:
        det = c("s0") * c("s2") - c("s1") * c("s1")
        a, b = ratio(c("t0") * c("s2") - c("t1") * c("s1"), det), ratio(c("s0") * c("t1") - c("s1") * c("t0"), det)
        return s.select("gid", (a - b * c("m") / c("h")).alias("c0"), (b / c("h")).alias("c1"))

    def det3(m):
        return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])

    m = [c(f"s{i + j}") for i in range(3) for j in range(3)]
    t = [c("t0"), c("t1"), c("t2")]
    det = det3(m)

    def solved(col):
        swapped = list(m)
        for row in range(3):
            swapped[3 * row + col] = t[row]
        return ratio(det3(swapped), det)

    s = s.withColumn("a", solved(0)).withColumn("b", solved(1)).withColumn("d", solved(2))
    z = c("m") / c("h")
    return s.select("gid", (c("a") - c("b") * z + c("d") * z * z).alias("c0"), ((c("b") - 2 * c("d") * z) / c("h")).alias("c1"), (c("d") / (c("h") * c("h"))).alias("c2"))


def rebin(df: DataFrame, width: float, method: str = "boxcar") -> DataFrame:
    """Means in bins of equal width: of y (boxcar), or sum(xy)/sum(x) (centroid); with the population deviation."""
    rows = df.groupBy("gid", F.floor(F.col("x") / width + 0.5).alias("bin"))
    mean = F.avg("y") if method == "boxcar" else F.sum(F.col("x") * F.col("y")) / F.sum("x")
    return rows.agg(mean.alias("y"), F.stddev_pop("y").alias("dy"), F.count(F.lit(1)).alias("n")).withColumn("x", F.col("bin") * F.lit(width)).select("gid", "x", "y", "dy", "n")


def lcf_two(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Weight of the first of two components that sum to one, in closed form; with r-factor."""
    d = first - second
    rows = df.groupBy("gid").agg(F.sum((F.col("y") - second) * d).alias("a"), F.sum(d * d).alias("b"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum((F.col("y") - second) * (F.col("y") - second)).alias("rr"))
    w = ratio(F.col("a"), F.col("b"))
    return rows.select("gid", w.alias("w1"), (1 - w).alias("w2"), ratio(F.col("rr") - w * F.col("a"), F.col("yy")).alias("rfactor"))


def number_independent(rmin: float, rmax: float, kmin: float, kmax: float) -> float:
    return 1 + 2 * (rmax - rmin) * (kmax - kmin) / math.pi


def fit_statistics(df: DataFrame, n_idp: float, n_var: int) -> DataFrame:
    """chi-square, reduced, r-factor, AIC and BIC by gid from rows with residual and data."""
    rows = df.groupBy("gid").agg(F.sum(F.col("residual") * F.col("residual")).alias("s"), F.sum(F.col("data") * F.col("data")).alias("d"), F.count(F.lit(1)).alias("n"))
    chi = F.col("s") * n_idp / F.col("n")
    rows = rows.withColumn("chi_square", chi)
    return rows.select("gid", "chi_square", (F.col("chi_square") / (n_idp - n_var)).alias("chi_reduced"), ratio(F.col("s"), F.col("d")).alias("rfactor"), (n_idp * F.ln(F.col("chi_square") / n_idp) + 2 * n_var).alias("aic"), (n_idp * F.ln(F.col("chi_square") / n_idp) + math.log(n_idp) * n_var).alias("bic"))


def pca_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("idx").agg(F.avg("y").alias("mean"))


def pca_gram(df: DataFrame, most: int = 2000) -> DataFrame:
    """Inner products of standardised curves over a common grid (population deviation): sum z_i z_j / n, i <= j.

    For a training set of at most `most` curves, whose number is checked: more are an error, not a sample. Curves come as
    one array each, and the second side of the pairs is broadcast.
    """
    if (n := df.select("gid").distinct().limit(most + 1).count()) > most:
        raise ValueError(f"over {n - 1} curves; a training set has {most} at most")
    z = df.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("idx", "y"))).getField("y").alias("y"))
    mean = F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / F.size("y")
    z = z.withColumn("m", mean).withColumn("z", F.transform("y", lambda v: v - F.col("m")))
    z = z.withColumn("s", F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v) / F.size("z"))).withColumn("z", F.transform("z", lambda v: ratio(v, F.col("s")))).select("gid", "z")
    a = z.select(F.col("gid").alias("i"), F.col("z").alias("zi"))
    b = z.select(F.col("gid").alias("j"), F.col("z").alias("zj"))
    pairs = a.join(F.broadcast(b), F.col("i") <= F.col("j"))  # `most` curves at most
    return pairs.select("i", "j", (F.aggregate(F.zip_with("zi", "zj", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) / F.size("zi")).alias("g"))
