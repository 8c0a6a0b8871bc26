"""Selections, projections and common grids over tables of curves (gid, idx, x, y). Column expressions and joins only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelight.curves import by_curve
from edgelight.functions import pointwise as p
from edgelight.operators import grids
from edgelight.operators import ordered as od
from edgelight.operators.texts import fixed

#: Curves whose values of a line are put together at once
BLOCK = 1024


def run_target(df: DataFrame, checked: Column, current: Column) -> DataFrame:
    """The checked spectra, or the current one if none is checked."""
    any_checked = df.agg(F.coalesce(F.max(checked.cast("int")), F.lit(0)).alias("any_checked"))
    return df.crossJoin(F.broadcast(any_checked)).where(F.when(F.col("any_checked") == 1, checked).otherwise(current)).drop("any_checked")  # one row


def mask_columns(df: DataFrame, keep: Column, derived: list[str]) -> DataFrame:
    """Points that `keep` allows; derived columns become null in curves that have lost a point."""
    every = Window.partitionBy("gid")
    lost = F.count(F.when(~keep | keep.isNull(), 1)).over(every) > 0
    df = df.withColumn("lost", lost).where(keep)
    return df.select(*(F.when(~F.col("lost"), F.col(c)).alias(c) if c in derived else c for c in df.columns if c != "lost"))


def remove_segment(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Curves without the points with x in [lo, hi], idx counted anew."""
    rows = df.where(~F.col("x").between(lo, hi))
    return rows.withColumn("idx", F.row_number().over(by_curve()) - 1)


def half_max_rising(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Where the curve first crosses half its largest y in [lo, hi], between the region's first point and that peak."""
    inside = df.where(F.col("x").between(lo, hi))
    peak = inside.groupBy("gid").agg(F.min(F.struct(-F.col("y"), F.col("idx"))).alias("p")).select("gid", (-F.col("p.col1") / 2).alias("half"), F.col("p.idx").alias("last"))
    w = by_curve()
    rows = inside.join(peak, "gid").where(F.col("idx") <= F.col("last"))
    rows = rows.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w))
    hit = rows.where((F.col("y0") <= F.col("half")) & (F.col("half") <= F.col("y")))
    at = F.when(F.col("y") == F.col("y0"), F.col("x0")).otherwise(F.col("x0") + (F.col("half") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("y") - F.col("y0")))
    return hit.groupBy("gid").agg(F.min(F.struct(F.col("idx"), at.alias("at"))).alias("p")).select("gid", F.col("p.at").alias("x_at"))


def baseline_peaks(df: DataFrame, amp: float, center: float, sigma: float, slope: float, intercept: float) -> DataFrame:
    """Step plus line as `baseline`, and what stands on it as `peaks`."""
    df = df.withColumn("baseline", p.arctan_step(F.col("x"), amp, center, sigma) + slope * F.col("x") + intercept)
    return df.withColumn("peaks", F.col("y") - F.col("baseline"))


def overlap_points(df: DataFrame, n: int) -> list[float]:
    """n uniform points over the range that all curves share; none if there is no such range or n is under 2."""
    r = grids.overlap(df).head()
    if r is None or r.lo is None or not r.lo < r.hi or n < 2:
        return []
    return [r.lo + (r.hi - r.lo) * i / (n - 1) for i in range(n)]


def common_matrix(df: DataFrame, n: int) -> DataFrame:
    """Every curve on n uniform points of the shared range: (gid, x, y)."""
    return grids.interp_linear(df, overlap_points(df, n))


def first_grid(df: DataFrame) -> list[float]:
    """The x of the first curve (smallest gid) inside the range that all curves share; one curve's points."""
    r, first = grids.overlap(df).head(), df.agg(F.min("gid").alias("gid")).head().gid
    if r is None or first is None or not r.lo < r.hi:
        return []
    points = [x.x for x in df.where((F.col("gid") == first) & F.col("x").between(r.lo, r.hi)).orderBy("idx").select("x").collect()]
    return points if len(points) > 1 else []


def average_on_first(df: DataFrame) -> DataFrame:
    """Mean of all curves on the first one's grid: (x, y, n); no rows without a shared range of two points."""
    return grids.average(df, first_grid(df))


def rebin_to(df: DataFrame, centers: list[float], centroid: bool = False) -> DataFrame:
    """Points in bins around ascending centers, cut half-way between them: x (center, or mean of x), mean y, population deviation, n."""
    edges = [(a + b) / 2 for a, b in zip(centers[:-1], centers[1:])]
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("x")))
    mean = F.sum(F.col("x") * F.col("y")) / F.sum("x") if centroid else F.avg("y")
    rows = df.withColumn("bin", at).groupBy("gid", "bin").agg(F.avg("x").alias("xm"), mean.alias("y"), F.stddev_pop("y").alias("dy"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("x", F.get(F.array(*map(F.lit, centers)), "bin"))


def savitzky_golay(df: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted sum over an odd window; beyond an end stand the points mirrored at the end point and reflected about its value."""
    half = len(weights) // 2
    rows = df.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("idx", "y"))).alias("c")).select("gid", F.col("c.y").alias("y"))
    n, y = F.size("y"), F.col("y")
    head = F.transform(F.sequence(F.lit(half), F.lit(1), F.lit(-1)), lambda i: F.get(y, F.lit(0)) - F.abs(F.get(y, i) - F.get(y, F.lit(0))))
    tail = F.transform(F.sequence(F.lit(1), F.lit(half)), lambda i: F.get(y, n - 1) + F.abs(F.get(y, n - 1 - i) - F.get(y, n - 1)))
    rows = rows.where(n > half).withColumn("all", F.concat(head, y, tail))
    total = lambda i: F.aggregate(F.zip_with(F.slice("all", i + 1, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.select("gid", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), total)).alias("idx", "ys"))


def normalised_weights(df: DataFrame) -> DataFrame:
    return df.withColumn("w", p.ratio(F.col("y"), F.sum("y").over(Window.partitionBy("gid"))))


def epsilon_r(eps_k: Column, kweight: int, kmin: float, kmax: float, kstep: float) -> Column:
    """Noise in R from noise in k, explicit form."""
    w = 2 * kweight + 1
    return eps_k / (2 * math.sqrt(math.pi * w / (kstep * (kmax**w - kmin**w))))


def graph_views(df: DataFrame) -> DataFrame:
    """Rows of every view (view, gid, idx, x, y) of curves: as they are, weighted, magnitude, first and second derivative."""
    df = od.dmude(df)
    df = od.dmude(df, "second", "dmude")
    views = {"mu": F.col("y"), "k2chi": p.k_weight(F.col("x"), F.col("y"), 2), "magnitude": F.abs("y"), "derivative": F.col("dmude"), "second": F.col("second")}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("view"), v.cast("double").alias("y")) for k, v in views.items())))
    return df.select("gid", "idx", "x", rows.alias("v")).select("v.view", "gid", "idx", "x", "v.y")


def fit_series(df: DataFrame, parts: tuple[str, ...] = ("mag", "re", "im", "phase")) -> DataFrame:
    """Rows (gid, idx, series, part, value) of complex data and model columns data_re, data_im, model_re, model_im."""
    def of(side: str) -> list[Column]:
        re, im = F.col(f"{side}_re"), F.col(f"{side}_im")
        mag, pha = p.polar(re, im)
        values = {"mag": mag, "re": re, "im": im, "phase": pha}
        return [F.struct(F.lit(side).alias("series"), F.lit(k).alias("part"), values[k].cast("double").alias("value")) for k in parts]

    return df.select("gid", "idx", F.explode(F.array(*of("data"), *of("model"))).alias("v")).select("gid", "idx", "v.*")


def image_of(element: Column, at: list[Column], site_element: Column, site: list[Column], tolerance: float = 1e-3) -> Column:
    """Whether fractional coordinates are those of a site, up to whole cells and a tolerance, with the same element."""
    near = element == site_element
    for a, b in zip(at, site):
        d = a - b
        near = near & (F.abs(d - F.round(d)) <= tolerance)
    return near


def label_index(labels: Column, name: Column) -> Column:
    """Index of a column label, letter case aside; null if there is none."""
    found = F.array_position(F.transform(labels, F.lower), F.lower(name))
    return F.when(found > 0, found - 1)


def xmu_text(label: Column, x: Column, y: Column) -> Column:
    """A two-column file's content from co-indexed arrays, in fixed form."""
    line = lambda a, b: F.format_string("%14.6f %18.10f\n", a, b)
    return F.concat(F.lit("# "), label, F.lit("\n# energy mu\n"), F.array_join(F.zip_with(x, y, line), ""))


def blocks_text(x_label: Column, y_label: Column, labels: Column, xs: Column, ys: Column) -> Column:
    """A file of several curves: axis lines, and a titled block for each of them."""
    line = lambda a, b: F.format_string("%14.6f %18.10f\n", a, b)
    block = lambda i: F.concat(F.format_string("# curve %d: ", i + 1), F.get(labels, i), F.lit("\n"), F.array_join(F.zip_with(F.get(xs, i), F.get(ys, i), line), ""), F.lit("\n"))
    return F.concat(F.lit("# x-axis: "), x_label, F.lit("\n# y-axis: "), y_label, F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.size(labels) - 1), block), ""))


def data_rows(content: Column) -> Column:
    """Numeric lines of a column file as arrays of numbers; comment and empty lines do not count."""
    own = F.filter(F.split(content, "\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*[-+.0-9]")))
    return F.transform(own, lambda x: F.transform(F.split(F.trim(x), r"[ \t,]+"), lambda v: v.try_cast("double")))


def header_lines(content: Column) -> Column:
    return F.transform(F.filter(F.split(content, "\r?\n"), lambda x: x.startswith("#")), lambda x: F.trim(F.regexp_replace(x, "^#+", "")))


def _side_by_side(own: Column, blank: Column) -> Column:
    """Texts of ascending places (array of first, last, text) in one, separated by tabs, with `blank` for every place between; null without texts."""
    ends = F.concat(F.array(F.lit(None).cast("int")), F.transform(own, lambda c: c["last"]))  # of the place before
    joined = F.zip_with(own, ends, lambda c, end: F.concat(F.when(end.isNull(), "").otherwise(F.concat(F.lit("\t"), F.repeat(blank, c["first"] - end - 1))), c["text"]))
    return F.when(F.size(own) > 0, F.array_join(joined, ""))


def wide_lines(df: DataFrame) -> DataFrame:
    """Lines (line, text) of a wide table of curves (gid, label, idx, x, y), in order of gid; line -1 is the head.

    If all curves have the same x, one x column and a y column for each; else a pair of columns for each, blank where a curve has ended. Tabs,
    six decimals, a tab after the head. Any number of curves: points are put together by blocks of curves and blocks by line, so work grows with
    the points and the text; a line holds one value of each, as its text does; the labels are one row.
    """
    heads = df.groupBy("gid").agg(F.first("label").alias("label"), F.sum(F.xxhash64("idx", "x").cast("decimal(20,0)")).alias("grid"), F.count(F.lit(1)).alias("n"))
    curve = F.struct(F.col("gid").isNull().alias("unnamed"), "gid", "label")
    facts = heads.agg(F.sort_array(F.collect_list(curve)).alias("curves"), ((F.min("grid") == F.max("grid")) & (F.min("n") == F.max("n"))).alias("same"))
    places = facts.select(F.posexplode("curves").alias("place", "c")).select("place", F.col("c.gid").alias("owner"))
    mode = F.broadcast(facts.select("same", F.size("curves").alias("curves")))  # one row
    blank = F.when(F.col("same"), "").otherwise("\t\t")
    cells = df.join(mode).select("gid", "idx", "same", F.when(F.col("same"), F.col("x")).alias("x"), fixed(F.when(~F.col("same"), F.col("x")), 6).alias("left"), fixed(F.col("y"), 6).alias("right"))
    pair = F.concat(F.coalesce("left", F.lit("")), F.lit("\t"), F.coalesce("right", F.lit("")))
    cells = cells.select("gid", "idx", "x", F.when(F.col("same"), F.col("right")).otherwise(pair).alias("text"))
    cells = cells.join(places, F.col("gid").eqNullSafe(F.col("owner")))
    cell = F.struct(F.col("place").alias("first"), F.col("place").alias("last"), "text")
    parts = cells.groupBy("idx", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), cell))).alias("own"), F.min("x").alias("x")).join(mode)
    part = F.struct(F.get("own", F.lit(0))["first"].alias("first"), F.get("own", F.size("own") - 1)["last"].alias("last"), _side_by_side(F.col("own"), blank).alias("text"))
    rows = parts.select("idx", "x", F.when(F.size("own") > 0, part).alias("part")).groupBy("idx").agg(F.sort_array(F.collect_list("part")).alias("own"), F.min("x").alias("x")).join(mode)
    alone = F.concat(fixed(F.col("x"), 6), F.lit("\t"), _side_by_side(F.col("own"), blank))
    pairs = F.concat(F.repeat(blank, F.get("own", F.lit(0))["first"]), _side_by_side(F.col("own"), blank), F.repeat(blank, F.col("curves") - 1 - F.get("own", F.size("own") - 1)["last"]))
    head = F.when(F.col("same"), F.concat(F.lit("x\t"), F.array_join("curves.label", "\t"))).otherwise(F.array_join(F.transform("curves", lambda c: F.concat(c["label"], F.lit("_x\t"), c["label"])), "\t"))
    lines = rows.select(F.col("idx").cast("int").alias("line"), F.when(F.col("same"), alone).otherwise(pairs).alias("text"))
    return facts.where("size(curves) > 0").select(F.lit(-1).alias("line"), F.concat(head, F.lit("\t")).alias("text")).union(lines)
