"""Curves onto grids that are tables: each grid point meets the last segment that starts at or before it.

Segments and grid points of a curve are merged in one sorted window (an as-of join), so the work is that of a sort,
whatever the number of points and grids; no grid becomes literals in the plan or rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelight.curves import by_curve


def as_of(segments: DataFrame, grid: DataFrame) -> DataFrame:
    """grid rows (gid, x) with seg of the curve's last segment (gid, start, idx, seg) at or before x, null where there is none."""
    kind = segments.schema["seg"].dataType
    left = segments.select("gid", F.col("start").cast("double").alias("x"), F.lit(0).alias("late"), "idx", "seg")
    right = grid.select("gid", F.col("x").cast("double").alias("x"), F.lit(1).alias("late"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast(kind).alias("seg"))
    w = Window.partitionBy("gid").orderBy("x", "late", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("seg", F.last("seg", ignorenulls=True).over(w))
    return found.where("late = 1").select("gid", "x", "seg")


def shared(df: DataFrame, grid: DataFrame) -> DataFrame:
    """A grid of its own (gid, x) for every curve of df from one grid (x) for all; the grid travels as one array."""
    points = grid.where("x is not null").agg(F.sort_array(F.collect_list("x")).alias("grid"))
    return df.select("gid").distinct().join(F.broadcast(points)).select("gid", F.explode("grid").alias("x"))


def linear(df: DataFrame, grid: DataFrame, outside: str = "clamp") -> DataFrame:
    """Curves (gid, idx, x, y), x ascending in idx, at the points of their own grids (gid, x): linear inside; outside end values (clamp) or null.

    Of points with equal x the last one holds from there on. A grid of a curve that is not there, and null grid points, give null; null
    points of curves do not count.
    """
    if outside not in ("clamp", "null"):
        raise ValueError(f"outside is clamp or null, not {outside}")
    w = by_curve()
    own = df.where("x is not null and y is not null")
    seg = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    rows = own.select("gid", "idx", seg.alias("seg"), F.lag("x").over(w).isNull().alias("first"))
    # the first segment also stands for all that is left of it
    start = F.col("seg.x0")
    rows = rows.withColumn("start", F.explode(F.when(F.col("first"), F.array(F.lit(float("-inf")), start)).otherwise(F.array(start))))
    met, g = as_of(rows, grid), F.col("x")
    x0, y0, x1, y1 = (F.col(f"seg.{c}") for c in ("x0", "y0", "x1", "y1"))
    inside = y0 + (g - x0) * F.try_divide(y1 - y0, x1 - x0)
    edge = y0 if outside == "clamp" else F.when(g == x0, y0)
    return met.select("gid", "x", F.when(g.isNull(), None).when((g >= x0) & x1.isNotNull(), inside).otherwise(edge).alias("y"))


def with_slopes(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """df with the slopes at the points of the interpolating cubic through arrays x and y, both third-derivative jumps next to the ends being none.

    A tridiagonal system, solved by one fold forward and one back. Two points give a line, three a parabola, one slope zero; equal
    neighbours in x give nulls.
    """
    n = F.size(x)
    inner = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))))
    df = df.withColumn("_h", F.transform(inner, lambda i: F.get(x, i) - F.get(x, i - 1)))
    df = df.withColumn("_s", F.transform(inner, lambda i: F.try_divide(F.get(y, i) - F.get(y, i - 1), F.get("_h", i - 1))))
    h, s = (lambda i: F.get("_h", i)), (lambda i: F.get("_s", i))

    def row(lower: Column, diag: Column, upper: Column, rhs: Column) -> Column:
        return F.struct(lower.cast("double").alias("lower"), diag.cast("double").alias("diag"), upper.cast("double").alias("upper"), rhs.cast("double").alias("rhs"))

    def end(a: Column, b: Column, sa: Column, sb: Column) -> Column:
        return F.try_divide(b * (3 * a + 2 * b) * sa + a * a * sb, a + b)

    zero = F.lit(0.0)
    first = row(zero, h(F.lit(1)), h(F.lit(0)) + h(F.lit(1)), end(h(F.lit(0)), h(F.lit(1)), s(F.lit(0)), s(F.lit(1))))
    last = row(h(n - 2) + h(n - 3), h(n - 3), zero, end(h(n - 2), h(n - 3), s(n - 2), s(n - 3)))
    middle = F.transform(F.sequence(F.lit(1), n - 2), lambda i: row(h(i), 2 * (h(i) + h(i - 1)), h(i - 1), 3 * (h(i) * s(i - 1) + h(i - 1) * s(i))))
    df = df.withColumn("_rows", F.when(n > 3, F.concat(F.array(first), middle, F.array(last))))

    def forward(acc: Column, r: Column) -> Column:
        past = F.get(acc, F.size(acc) - 1)
        den = r["diag"] - r["lower"] * F.coalesce(past["c"], zero)
        return F.array_append(acc, F.struct(F.try_divide(r["upper"], den).alias("c"), F.try_divide(r["rhs"] - r["lower"] * F.coalesce(past["d"], zero), den).alias("d")))

    df = df.withColumn("_rows", F.aggregate("_rows", F.array().cast("array<struct<c:double,d:double>>"), forward))
    back = F.aggregate(F.reverse("_rows"), F.array().cast("array<double>"), lambda acc, r: F.array_append(acc, r["d"] - r["c"] * F.coalesce(F.get(acc, F.size(acc) - 1), zero)))
    # the parabola's slopes
    bend = F.try_divide(s(F.lit(1)) - s(F.lit(0)), h(F.lit(0)) + h(F.lit(1)))
    three = F.array(s(F.lit(0)) - bend * h(F.lit(0)), s(F.lit(0)) + bend * h(F.lit(0)), s(F.lit(1)) + bend * h(F.lit(1)))
    slopes = F.when(n > 3, F.reverse(back)).when(n == 3, three).when(n == 2, F.array(s(F.lit(0)), s(F.lit(0)))).when(n == 1, F.array(zero))
    return df.withColumn(out, slopes).drop("_h", "_s", "_rows")


def cubic(curves: DataFrame, grid: DataFrame) -> DataFrame:
    """Curves (gid, x array, y array), x ascending, at the points of their grids (gid, x) by the interpolating cubic.

    Left and right of a curve the cubic through its first or last five points goes on. A curve of one point is constant; a grid of a curve
    that is not there, or of one without points, gives null.
    """
    d = curves.select("gid", "x", "y").where("size(x) > 0 and size(x) = size(y)")
    few = F.least(F.size("x"), F.lit(5))
    for side, at in (("a", F.lit(1)), ("b", F.size("x") - few + 1)):
        d = d.withColumn(f"x{side}", F.slice("x", at, few)).withColumn(f"y{side}", F.slice("y", at, few))
        d = with_slopes(d, f"x{side}", f"y{side}", f"m{side}")
    d = with_slopes(d, "x", "y", "m")

    def segment(start: Column, idx: Column, x: str, y: str, m: str, i: Column) -> Column:
        own = [F.get(v, i + j).alias(f"{n}{j}") for j in (0, 1) for n, v in (("x", x), ("y", y), ("m", m))]
        return F.struct(start.alias("start"), idx.cast("int").alias("idx"), F.struct(*own).alias("seg"))

    n = F.size("x")
    left = segment(F.lit(float("-inf")), F.lit(-1), "xa", "ya", "ma", F.lit(0))
    right = segment(F.element_at("x", -1), n, "xb", "yb", "mb", F.greatest(few - 2, F.lit(0)))
    inside = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: segment(F.get("x", i), i, "x", "y", "m", i))).otherwise(F.array())
    segments = d.select("gid", F.explode(F.concat(F.array(left), inside, F.array(right))).alias("s")).select("gid", "s.*")
    met, g = as_of(segments, grid), F.col("x")
    x0, y0, m0, x1, y1, m1 = (F.col(f"seg.{c}") for c in ("x0", "y0", "m0", "x1", "y1", "m1"))
    h = x1 - x0
    u = F.try_divide(g - x0, h)
    value = y0 * (1 + 2 * u) * (1 - u) * (1 - u) + m0 * h * u * (1 - u) * (1 - u) + y1 * u * u * (3 - 2 * u) + m1 * h * u * u * (u - 1)
    return met.select("gid", "x", F.when(x1.isNull(), F.when(g.isNotNull(), y0)).otherwise(value).alias("y"))


def common_grid(curves: DataFrame) -> DataFrame:
    """Every curve (gid, x array, y array) on the first one's own grid inside the range that all share: (gid, x, y).

    The first curve (smallest gid) keeps its values; the others go through cubic(). No shared range gives no rows.
    """
    wide = curves.where("size(x) > 0")
    span = wide.agg(F.max(F.array_min("x")).alias("lo"), F.min(F.array_max("x")).alias("hi"), F.min("gid").alias("first"))
    own = wide.join(F.broadcast(span), F.col("gid") == F.col("first")).where("lo < hi")
    # from the last point at or before the range's start
    own = own.withColumn("lo", F.coalesce(F.array_max(F.filter("x", lambda v: v <= F.col("lo"))), F.get("x", F.lit(0))))
    own = own.select("gid", F.explode(F.filter(F.arrays_zip("x", "y"), lambda p: (p["x"] >= F.col("lo")) & (p["x"] <= F.col("hi")))).alias("p")).select("gid", "p.x", "p.y")
    grid = own.select("x")
    others = wide.join(F.broadcast(span), F.col("gid") != F.col("first"), "left_semi")
    return own.unionByName(cubic(others, shared(others, grid)))
