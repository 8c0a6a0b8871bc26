"""Interpolation onto grids, averages on common grids, discrete Fourier sums and Kramers-Kronig sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelight.curves import by_curve


def interp_linear(df: DataFrame, grid: list[float], outside: str = "clamp") -> DataFrame:
    """Each curve on a grid: end values (clamp) or null outside.

    Segments look up the grid points they cover, so no union, range join or sort of the grid is needed: one window.
    """
    w = by_curve()
    points = F.array(*map(F.lit, map(float, grid)))
    seg = df.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).withColumn("first", F.lag("x").over(w).isNull())
    last = F.col("x1").isNull()
    covered = F.filter(points, lambda g: (((g >= F.col("x")) | F.col("first")) & ((g < F.col("x1")) | last)))
    rows = seg.withColumn("g", F.explode(covered))
    inside = (F.col("g") >= F.col("x")) & F.col("x1").isNotNull()
    edge = F.col("y") if outside == "clamp" else F.when(F.col("g") == F.col("x"), F.col("y"))
    value = F.when(inside, F.col("y") + (F.col("g") - F.col("x")) * (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x"))).otherwise(edge)
    return rows.select("gid", F.col("g").alias("x"), value.alias("y"))


def overlap(df: DataFrame) -> DataFrame:
    """The range all curves share: (lo, hi), one row."""
    return df.groupBy("gid").agg(F.min("x").alias("a"), F.max("x").alias("b")).agg(F.max("a").alias("lo"), F.min("b").alias("hi"))


def average(df: DataFrame, grid: list[float]) -> DataFrame:
    """Mean over curves of their values on a common grid."""
    return interp_linear(df, grid).groupBy("x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def dft_forward(df: DataFrame, r: list[float], kstep: float) -> DataFrame:
    """chi(R) of weighted chi(k) rows (gid, x, y) as explicit sums: kstep/sqrt(pi) sum y exp(-2ikR)."""
    rows = df.withColumn("r", F.explode(F.array(*map(F.lit, map(float, r)))))
    phase = 2 * F.col("x") * F.col("r")
    scale = kstep / math.sqrt(math.pi)
    return rows.groupBy("gid", "r").agg((F.sum(F.col("y") * F.cos(phase)) * scale).alias("re"), (-F.sum(F.col("y") * F.sin(phase)) * scale).alias("im"))


def dft_reverse(df: DataFrame, q: list[float], rstep: float) -> DataFrame:
    """chi(q) of rows (gid, r, re, im): rstep * 2/sqrt(pi) * half of the sum of chi(R) exp(2iqR)."""
    rows = df.withColumn("q", F.explode(F.array(*map(F.lit, map(float, q)))))
    phase = 2 * F.col("q") * F.col("r")
    scale = 2 * rstep / math.sqrt(math.pi) * 0.5
    c, s = F.cos(phase), F.sin(phase)
    return rows.groupBy("gid", "q").agg((F.sum(F.col("re") * c - F.col("im") * s) * scale).alias("re"), (F.sum(F.col("re") * s + F.col("im") * c) * scale).alias("im"))


def kk_sum(df: DataFrame, step: float) -> DataFrame:
    """Maclaurin Kramers-Kronig sum on a curve of even length: even points sum over odd ones (and j = -1, the last) and the reverse."""
    pts = df.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    rows = pts.withColumn("n", F.size("p")).withColumn("c", F.explode("p"))
    partners = F.filter("p", lambda o, j: F.when(F.col("c.idx") % 2 == 1, j % 2 == 0).otherwise(j % 2 == 1))

    def term(o):
        den = o["x"] * o["x"] - F.col("c.x") * F.col("c.x")
        safe = F.when(F.abs(den) <= 1e-20, F.lit(1e-20)).otherwise(den)
        return o["x"] * o["y"] / safe

    total = F.aggregate(F.transform(partners, term), F.lit(0.0), lambda s, v: s + v)
    return rows.select("gid", F.col("c.idx").alias("idx"), (total * (-4.0 / math.pi * step)).alias("kk"))


def stack(df: DataFrame, offset: float) -> DataFrame:
    """Curves above each other by rank of gid. The ranks come from the distinct ids, not from the points."""
    return df.join(ordinal(df), "gid").withColumn("ys", F.col("y") + F.col("ordinal") * offset)


def ordinal(df: DataFrame) -> DataFrame:
    """(gid, ordinal) in order of gid, from 0. Distinct ids are counted in runs, then numbered inside their run."""
    ids = df.select("gid").distinct().withColumn("run", F.floor(F.col("gid") / 4096))
    before = ids.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("run")) - F.col("n"))  # a row per 4096 ids
    inside = F.row_number().over(Window.partitionBy("run").orderBy("gid")) - 1
    return ids.withColumn("inside", inside).join(before, "run").select("gid", (F.col("inside") + F.col("before")).alias("ordinal"))
