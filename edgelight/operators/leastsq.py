"""Linear least squares by curve as sums and one small dense solve: polynomials of any low degree, combinations of several components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelight.functions.dense import solve


def _double(x: Column) -> Column:
    return x.cast("double")


def binomial(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def polyfit(df: DataFrame, degree: int) -> DataFrame:
    """(gid, c array): coefficients of x, low to high, of the least-squares polynomial of degree 0 to 5 of each curve (gid, x, y).

    x is mapped to [-1, 1] for the sums of powers, and the coefficients are mapped back. Fewer different x than coefficients give
    null coefficients; null points do not count.
    """
    if not 0 <= degree <= 5:
        raise ValueError("a degree of 0 to 5")
    every = Window.partitionBy("gid")
    df = df.where("x is not null and y is not null").withColumn("lo", F.min("x").over(every)).withColumn("hi", F.max("x").over(every))
    half = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 2).otherwise(F.lit(1.0))
    df = df.select("gid", "y", ((F.col("hi") + F.col("lo")) / 2).alias("mid"), half.alias("half"), "x").withColumn("u", (F.col("x") - F.col("mid")) / F.col("half"))
    power = [F.lit(1.0)]
    for _ in range(2 * degree):
        power.append(power[-1] * F.col("u"))
    sums = [F.sum(p).alias(f"s{i}") for i, p in enumerate(power)] + [F.sum(F.col("y") * p).alias(f"t{i}") for i, p in enumerate(power[: degree + 1])]
    s = df.groupBy("gid").agg(*sums, F.first("mid").alias("mid"), F.first("half").alias("half"))
    rows = F.array(*(F.array(*(F.col(f"s{i + j}") for j in range(degree + 1)), F.col(f"t{i}")) for i in range(degree + 1)))
    s = s.select("gid", "mid", "half", solve(rows, degree + 1).alias("a"))
    # a_n (x - mid)^n / half^n by powers of x
    back = []
    for k in range(degree + 1):
        terms = [F.get("a", F.lit(n)) * binomial(n, k) * F.pow(-F.col("mid"), F.lit(float(n - k))) / F.pow("half", F.lit(float(n))) for n in range(k, degree + 1)]
        back.append(sum(terms[1:], terms[0]))
    return s.select("gid", F.array(*back).alias("c"))


def polyval(c: Column, x: Column) -> Column:
    """A polynomial's value from its coefficients, low to high."""
    return F.aggregate(F.reverse(c), F.lit(0.0), lambda acc, a: acc * x + a)


def lcf(df: DataFrame, components: list[Column]) -> DataFrame:
    """(gid, weights array, rfactor): weights of two or more components that sum to one, for curves (gid, y) and components as Columns of their rows.

    The last weight is one less the others, so the fit is of y less the last component by differences from it. Components that
    depend on each other give null weights.
    """
    n = len(components) - 1
    if n < 1:
        raise ValueError("two components at least")
    last = _double(components[-1])
    names = [f"_d{i}" for i in range(n)]
    rows = df.select("gid", "y", (F.col("y") - last).alias("_r"), *((_double(c) - last).alias(d) for c, d in zip(components, names)))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(names) for b in [*names[i:], "_r"]]
    s = rows.groupBy("gid").agg(*sums, F.sum(F.col("_r") * F.col("_r")).alias("rr"), F.sum(F.col("y") * F.col("y")).alias("yy"))

    def product(i: int, j: int) -> Column:
        return F.col(names[min(i, j)] + names[max(i, j)])

    s = s.withColumn("w", solve(F.array(*(F.array(*(product(i, j) for j in range(n)), F.col(f"{names[i]}_r")) for i in range(n))), n))
    w = [F.get("w", F.lit(i)) for i in range(n)]
    gained = sum((x * F.col(f"{d}_r") for x, d in zip(w, names)), F.lit(0.0))
    rest = sum((-x for x in w), F.lit(1.0))
    return s.select("gid", F.array(*w, rest).alias("weights"), F.try_divide(F.col("rr") - gained, F.col("yy")).alias("rfactor"))
