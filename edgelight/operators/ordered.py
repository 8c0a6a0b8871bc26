"""Operators along a curve: derivatives, smoothing, unwrapping, cleaning, order. Each is one window over gid, so one shuffle at most."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelight.constants import TINY_ENERGY
from edgelight.curves import by_curve
from edgelight.functions.pointwise import ratio


def gradient(y: str | Column) -> Column:
    """Central differences at unit spacing, one-sided at the ends; a single point has gradient 0."""
    y, w = F.col(y) if isinstance(y, str) else y, by_curve()
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - y).when(after.isNull(), y - before).otherwise((after - before) / 2)


def dmude(df: DataFrame, out: str = "dmude", y: str = "y") -> DataFrame:
    return df.withColumn("gy", gradient(y)).withColumn("gx", gradient("x")).withColumn(out, ratio(F.col("gy"), F.col("gx"))).drop("gy", "gx")


def overlay_derivative(df: DataFrame) -> DataFrame:
    """(next - previous) of y over that of x, ends one-sided, 0 where x stands still."""
    w = by_curve()
    y2, y1 = F.coalesce(F.lead("y").over(w), F.col("y")), F.coalesce(F.lag("y").over(w), F.col("y"))
    x2, x1 = F.coalesce(F.lead("x").over(w), F.col("x")), F.coalesce(F.lag("x").over(w), F.col("x"))
    return df.withColumn("dy", F.when(x2 == x1, F.lit(0.0)).otherwise((y2 - y1) / (x2 - x1)))


def smooth5(df: DataFrame) -> DataFrame:
    return df.withColumn("ys", F.avg("y").over(by_curve().rowsBetween(-2, 2)))


def phase_unwrap(df: DataFrame) -> DataFrame:
    """Cumulative correction by multiples of pi: round-half-even of the jump's size, with its sign."""
    w = by_curve()
    jump = F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))
    turns = F.bround(F.abs(jump) / math.pi) * F.signum(jump)
    df = df.withColumn("turns", turns)
    return df.withColumn("unwrapped", F.col("y") - math.pi * F.sum("turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("turns")


def time_rebase(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.col("x") - F.first("x", ignorenulls=True).over(by_curve().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def drop_nonfinite(df: DataFrame) -> DataFrame:
    return df.where(finite(F.col("x")) & finite(F.col("y")))


def trim(df: DataFrame, lo: float, hi: float) -> DataFrame:
    return df.where(F.col("x").between(min(lo, hi), max(lo, hi)))


def nearest_rank(e: float) -> Column:
    return F.row_number().over(by_curve(F.abs(F.col("x") - e), "idx"))


def deglitch_point(df: DataFrame, e: float) -> DataFrame:
    """Without the point nearest to e (the first of equals)."""
    return df.withColumn("near", nearest_rank(e)).where("near <> 1").drop("near")


def nearest_index(df: DataFrame, *at: float) -> DataFrame:
    """Per curve the index nearest to each position: i1, i2, ..."""
    return df.groupBy("gid").agg(*(F.min(F.struct(F.abs(F.col("x") - e), F.col("idx"))).getField("idx").alias(f"i{j + 1}") for j, e in enumerate(at)))


def deglitch_range(df: DataFrame, side: str, lo: float, hi: float | None = None) -> DataFrame:
    """Drop all above, below or between positions, by nearest index; one window instead of a join."""
    every = Window.partitionBy("gid")

    def near(e):
        return F.min(F.struct(F.abs(F.col("x") - e), F.col("idx"))).over(every).getField("idx")

    df = df.withColumn("i1", near(lo)).withColumn("i2", near(lo if hi is None else hi))
    a, b = F.least("i1", "i2"), F.greatest("i1", "i2")
    gone = {"above": F.col("idx") >= F.col("i1"), "below": F.col("idx") < F.col("i1"), "between": (F.col("idx") >= a) & (F.col("idx") < b)}[side]
    return df.where(~gone).drop("i1", "i2")


def sort_spectrum(df: DataFrame) -> DataFrame:
    """Ascending x, stable; idx anew."""
    return df.withColumn("idx", F.row_number().over(by_curve("x", "idx")) - 1)


def remove_dups(df: DataFrame, tiny: float = TINY_ENERGY) -> DataFrame:
    """In a run of steps under tiny every point is raised by tiny times its place in the run, if the least step is within 10 tiny."""
    w = by_curve()
    df = df.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("least", F.min("dx").over(Window.partitionBy("gid")))
    df = df.withColumn("run", F.sum(F.when(F.col("dx").isNull() | (F.abs("dx") >= tiny), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("gid", "run").orderBy("idx")) - 1
    return df.withColumn("x", F.when(F.col("least") <= 10 * tiny, F.col("x") + tiny * place).otherwise(F.col("x"))).drop("dx", "least", "run")


def energy_step(df: DataFrame, frac_ignore: float = 0.01, nave: int = 10) -> DataFrame:
    """Mean of `nave` of the smallest steps after skipping a share of points at both ends and of the smallest steps."""
    n = F.count(F.lit(1)).over(Window.partitionBy("gid"))
    df = df.withColumn("n", n).withColumn("skip", F.floor(F.col("n") * frac_ignore).cast("int"))
    df = df.where((F.col("idx") >= F.col("skip")) & (F.col("idx") < F.col("n") - F.col("skip")))
    df = df.withColumn("dx", F.col("x") - F.lag("x").over(by_curve())).where("dx is not null")
    df = df.withColumn("r", F.row_number().over(by_curve("dx", "idx")) - 1)
    return df.where((F.col("r") >= F.col("skip")) & (F.col("r") < F.col("skip") + nave)).groupBy("gid").agg(F.avg("dx").alias("estep"))


def ordered_indices(df: DataFrame) -> DataFrame:
    """Points whose successor in x order is their successor in the curve; the last point of a sorted curve is not one."""
    df = df.withColumn("next", F.lead("idx").over(by_curve("x", "idx")))
    return df.where(F.col("next") - F.col("idx") == 1).drop("next")


def same_height(df: DataFrame) -> DataFrame:
    every = Window.partitionBy("gid")
    lo, hi = F.min("y").over(every), F.max("y").over(every)
    return df.withColumn("lo", lo).withColumn("hi", hi).withColumn("ys", F.when(F.col("hi") == F.col("lo"), F.col("y")).otherwise((F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def convolve_full(df: DataFrame, kernel: list[float]) -> DataFrame:
    """Full convolution with a short kernel: each point spreads over len(kernel) places and is summed."""
    spread = F.posexplode(F.array(*map(F.lit, kernel))).alias("j", "w")
    return df.select("gid", "idx", "y", spread).groupBy("gid", (F.col("idx") + F.col("j")).alias("idx")).agg(F.sum(F.col("y") * F.col("w")).alias("y"))


def savitzky_golay(df: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted sum over a fixed odd window by position; null within half a window of the ends (views.savitzky_golay() reflects them)."""
    half, w = len(weights) // 2, by_curve()
    n = F.count(F.lit(1)).over(Window.partitionBy("gid"))
    df = df.withColumn("n", n)
    total = F.lit(0.0)
    for j, c in enumerate(weights):
        d = j - half
        near = F.lag("y", -d).over(w) if d < 0 else F.lead("y", d).over(w)
        near = F.col("y") if d == 0 else near
        total = total + F.lit(c) * F.coalesce(near, F.lit(0.0))
    return df.withColumn("ys", F.when(F.col("idx").between(half, F.col("n") - 1 - half), total)).drop("n")


def iir(df: DataFrame, b: list[float], a: list[float]) -> DataFrame:
    """Linear recursive filter of curves (gid, y array) from rest: a0 z[i] = sum b_j y[i-j] - sum a_j z[i-j], j > 0 in the second sum.

    Without a recursive part it is a weighted sum. A null in y makes all that follows null. One fold per curve; a curve is one row.
    """
    if not a or a[0] == 0:
        raise ValueError("the first coefficient of the recursive part must not be zero")
    ahead, behind = [v / a[0] for v in b], [v / a[0] for v in a[1:]]

    def step(z: Column, i: Column) -> Column:
        own = F.lit(0.0)
        for j, v in enumerate(ahead):
            own = own + v * F.when(i >= j, F.get("y", i - j)).otherwise(0.0)
        for j, v in enumerate(behind, 1):
            own = own - v * F.when(i >= j, F.get(z, i - j)).otherwise(0.0)
        return F.array_append(z, own)

    none = F.array().cast("array<double>")
    z = F.when(F.size("y") == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.size("y") - 1), none, step))
    return df.withColumn("z", z)
