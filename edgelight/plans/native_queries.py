"""Queries over curves made from the driver's tables, each with the SQL that gives the same rows.

Outputs are rounded to 6 decimals on both sides, and zero is added so that -0.0 does not show.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from edgelight import constants as K
from edgelight import curves
from edgelight.functions import ftwindow as fw
from edgelight.functions import pointwise as p
from edgelight.operators import aggregates as ag
from edgelight.operators import grids, lattice
from edgelight.operators import ordered as od

QUERIES: dict = {}
SQL: dict[str, str] = {}

EVENTS = "c AS (SELECT user_id gid, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 idx, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE x, value y FROM events)"
VECTORS = "c AS (SELECT vec_id gid, i idx, i * 0.05::DOUBLE x, embedding[i + 1]::DOUBLE y FROM embeddings, generate_series(0, 63) g(i))"
W = "WINDOW w AS (PARTITION BY gid ORDER BY idx)"
DAY = 86400.0
GRID = [float(i) * 2 * DAY for i in range(1, 14)]
R_GRID = [i * 0.1 for i in range(0, 40)]
Q_GRID = [i * 0.5 for i in range(0, 8)]


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c):
    """c to 6 decimals as round() of the SQL takes them: by the scaled double, not by the digits it prints."""
    scaled = F.round(c * F.lit(1e6)) / F.lit(1e6)
    return F.when(F.abs(c) < F.lit(1e302), scaled).otherwise(c) + F.lit(0.0)


def out(df, keys, *values):
    return df.select(*keys, *(r6(F.col(v)).alias(v) for v in values))


def items(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def i0():
    return F.col("l_extendedprice")


def it():
    return F.col("l_quantity")


@query("SELECT l_orderkey, round(ln(l_extendedprice / l_quantity), 6) mu FROM lineitem")
def mu_transmission(spark, sf):
    return out(items(spark, sf).select("l_orderkey", p.mu_transmission(i0(), it()).alias("mu")), ["l_orderkey"], "mu")


@query("SELECT l_orderkey, round(ln(l_quantity / l_extendedprice), 6) mu FROM lineitem")
def mu_reference(spark, sf):
    return out(items(spark, sf).select("l_orderkey", p.mu_reference(it(), i0()).alias("mu")), ["l_orderkey"], "mu")


@query("SELECT l_orderkey, round((l_discount + l_tax + l_quantity) / l_extendedprice, 6) + 0.0 mu FROM lineitem")
def mu_fluorescence(spark, sf):
    return out(items(spark, sf).select("l_orderkey", p.mu_fluorescence(i0(), F.col("l_discount"), F.col("l_tax"), it()).alias("mu")), ["l_orderkey"], "mu")


@query("SELECT l_orderkey, round(l_quantity, 6) + 0.0 mu FROM lineitem")
def mu_raw(spark, sf):
    return out(items(spark, sf).select("l_orderkey", it().alias("mu")), ["l_orderkey"], "mu")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '_' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') WHEN c_custkey % 3 = 1 THEN c_name ELSE c_name END name FROM customer")
def name_from_path(spark, sf):
    n = F.col("c_custkey")
    path = F.concat(F.lit("/data/run 1/"), F.col("c_name"), F.when(n % 3 == 0, F.concat(F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))).when(n % 3 == 1, ".xmu").otherwise(""))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", p.name_from_path(path).alias("name"))


@query(f"WITH {VECTORS} SELECT gid, idx, round(y * x * x, 6) + 0.0 chi FROM c")
def kweight(spark, sf):
    return out(curves.vector_curves(spark, sf).withColumn("chi", p.k_weight(F.col("x"), F.col("y"), 2)), ["gid", "idx"], "chi")


E_OF_X = "7112.0::DOUBLE + (o_totalprice % 900) - 100"


@query(f"SELECT o_orderkey, round(CASE WHEN e < 7112 THEN 0 ELSE sqrt(abs(e - 7112) * {K.ETOK!r}::DOUBLE) END, 6) + 0.0 k, round(sign(e - 7112) * sqrt({K.ETOK!r}::DOUBLE * abs(e - 7112)), 6) + 0.0 ks FROM (SELECT o_orderkey, {E_OF_X} e FROM orders)")
def k_of_e(spark, sf):
    e = F.lit(7112.0) + F.col("o_totalprice") % 900 - 100
    return out(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", p.k_of_e(e, 7112.0).alias("k"), p.signed_k(e, 7112.0).alias("ks")), ["o_orderkey"], "k", "ks")


@query(f"SELECT o_orderkey, round(k * k * {K.KTOE!r}::DOUBLE, 6) + 0.0 e FROM (SELECT o_orderkey, (o_totalprice % 20) k FROM orders)")
def e_of_k(spark, sf):
    return out(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", p.e_of_k(F.col("o_totalprice") % 20).alias("e")), ["o_orderkey"], "e")


@query(f"WITH {EVENTS} SELECT gid, idx, round(3 * (0.5 + atan((x - 1000000) / 50000::DOUBLE) / pi()), 6) + 0.0 step, round(exp(-((x - 1000000) / 200000) * ((x - 1000000) / 200000) / 2) / (200000 * sqrt(2 * pi())) * 1e6, 6) + 0.0 gauss, round(1e6 / ((1 + ((x - 1000000) / 200000) * ((x - 1000000) / 200000)) * (pi() * 200000)), 6) + 0.0 lorentz, round(y - (3 * (0.5 + atan((x - 1000000) / 50000::DOUBLE) / pi()) + 1e-6 * x + 2), 6) + 0.0 peaks FROM c")
def lineshapes(spark, sf):
    df, x = curves.event_curves(spark, sf), F.col("x")
    step = p.arctan_step(x, 3.0, 1e6, 50000.0)
    df = df.withColumns({"step": step, "gauss": p.gaussian(x, 1e6, 2e5) * 1e6, "lorentz": p.lorentzian(x, 1e6, 2e5) * 1e6, "peaks": F.col("y") - (step + 1e-6 * x + 2)})
    return out(df, ["gid", "idx"], "step", "gauss", "lorentz", "peaks")


@query(f"WITH {EVENTS} SELECT gid, idx, round(y + (dense_rank() OVER (ORDER BY gid) - 1) * 100.0, 6) + 0.0 ys FROM c")
def stack_offset(spark, sf):
    return out(grids.stack(curves.event_curves(spark, sf), 100.0), ["gid", "idx"], "ys")


@query("WITH p AS (SELECT vec_id gid, i idx, embedding[i + 1]::DOUBLE re, embedding[i + 33]::DOUBLE im FROM embeddings, generate_series(0, 31) g(i)) SELECT gid, idx, round(sqrt(re * re + im * im), 6) + 0.0 mag, round(atan2(im, re), 6) + 0.0 pha FROM p")
def complex_polar(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.posexplode(F.arrays_zip(F.slice("embedding", 1, 32).alias("re"), F.slice("embedding", 33, 32).alias("im"))).alias("idx", "v"))
    mag, pha = p.polar(F.col("v.re").cast("double"), F.col("v.im").cast("double"))
    return out(rows.select("gid", "idx", mag.alias("mag"), pha.alias("pha")), ["gid", "idx"], "mag", "pha")


@query("SELECT vec_id gid, i idx, round(embedding[i + 1]::DOUBLE + CASE WHEN i < 40 THEN embedding[i + 1]::DOUBLE ELSE 0 END, 6) + 0.0 total FROM embeddings, generate_series(0, 63) g(i)")
def channel_sum(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.posexplode(p.channel_sum(e, F.slice(e, 1, 40))).alias("idx", "total"))
    return out(rows, ["gid", "idx"], "total")


@query(f"WITH {EVENTS} SELECT gid, idx, round(x, 6) + 0.0 x, round(y, 6) + 0.0 y FROM c WHERE isfinite(x) AND isfinite(CASE WHEN idx % 7 = 3 THEN 'nan'::DOUBLE WHEN idx % 11 = 5 THEN 'inf'::DOUBLE ELSE y END)")
def drop_nonfinite(spark, sf):
    df = curves.event_curves(spark, sf)
    y = F.when(F.col("idx") % 7 == 3, F.lit(float("nan"))).when(F.col("idx") % 11 == 5, F.lit(float("inf"))).otherwise(F.col("y"))
    return out(od.drop_nonfinite(df.withColumn("y", y)), ["gid", "idx"], "x", "y")


@query(f"WITH {EVENTS} SELECT gid, idx, round(x, 6) + 0.0 x, round(y, 6) + 0.0 y FROM c WHERE x BETWEEN 500000 AND 1500000")
def trim(spark, sf):
    return out(od.trim(curves.event_curves(spark, sf), 1.5e6, 5e5), ["gid", "idx"], "x", "y")


@query(f"WITH {EVENTS} SELECT gid, idx, round(y, 6) + 0.0 y FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY abs(x - 1000000), idx) r FROM c) WHERE r <> 1")
def deglitch_point(spark, sf):
    return out(od.deglitch_point(curves.event_curves(spark, sf), 1e6), ["gid", "idx"], "y")


def _range_sql(keep: str) -> str:
    return f"WITH {EVENTS}, n AS (SELECT gid, min_by(idx, (abs(x - 800000), idx)) i1, min_by(idx, (abs(x - 1600000), idx)) i2 FROM c GROUP BY gid) SELECT gid, idx, round(y, 6) + 0.0 y FROM c JOIN n USING (gid) WHERE NOT ({keep})"


@query(_range_sql("idx >= i1"))
def deglitch_above(spark, sf):
    return out(od.deglitch_range(curves.event_curves(spark, sf), "above", 8e5), ["gid", "idx"], "y")


@query(_range_sql("idx < i1"))
def deglitch_below(spark, sf):
    return out(od.deglitch_range(curves.event_curves(spark, sf), "below", 8e5), ["gid", "idx"], "y")


@query(_range_sql("idx >= least(i1, i2) AND idx < greatest(i1, i2)"))
def deglitch_between(spark, sf):
    return out(od.deglitch_range(curves.event_curves(spark, sf), "between", 8e5, 1.6e6), ["gid", "idx"], "y")


@query(f"WITH {EVENTS} SELECT gid, coalesce(max(CASE WHEN x <= 900000 THEN idx END), 0) i_of, min_by(idx, (abs(x - 900000), idx)) i_near FROM c GROUP BY gid")
def index_of(spark, sf):
    return curves.event_curves(spark, sf).groupBy("gid").agg(ag.index_of(9e5).cast("long").alias("i_of"), ag.index_nearest(9e5).cast("long").alias("i_near"))


@query(f"WITH {EVENTS} SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY y, idx) - 1 idx, round(y, 6) + 0.0 y FROM c")
def sort_spectrum(spark, sf):
    df = curves.event_curves(spark, sf).select("gid", "idx", F.col("y").alias("x"))
    return od.sort_spectrum(df).select("gid", F.col("idx").cast("long").alias("idx"), r6(F.col("x")).alias("y"))


@query(f"""WITH {EVENTS}, q AS (SELECT gid, idx, floor(x / 300000)::DOUBLE x FROM c), s AS (SELECT *, x - lag(x) OVER w d FROM q {W}),
t AS (SELECT *, min(d) OVER (PARTITION BY gid) m, sum(CASE WHEN d IS NULL OR abs(d) >= 0.0005 THEN 1 ELSE 0 END) OVER w run FROM s {W})
SELECT gid, idx, round(CASE WHEN m <= 0.005 THEN x + 0.0005 * (row_number() OVER (PARTITION BY gid, run ORDER BY idx) - 1) ELSE x END, 6) + 0.0 x FROM t""")
def remove_dups(spark, sf):
    df = curves.event_curves(spark, sf).withColumn("x", F.floor(F.col("x") / 300000).cast("double"))
    return out(od.remove_dups(df), ["gid", "idx"], "x")


@query(f"""WITH {EVENTS}, s AS (SELECT *, floor(count(*) OVER (PARTITION BY gid) * 0.05::DOUBLE)::INT k, count(*) OVER (PARTITION BY gid) n FROM c),
t AS (SELECT *, x - lag(x) OVER w d FROM s WHERE idx >= k AND idx < n - k {W}), u AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d, idx) - 1 r FROM t WHERE d IS NOT NULL)
SELECT gid, round(avg(d), 6) + 0.0 estep FROM u WHERE r >= k AND r < k + 10 GROUP BY gid""")
def energy_step(spark, sf):
    return out(od.energy_step(curves.event_curves(spark, sf), 0.05, 10), ["gid"], "estep")


@query(f"WITH {EVENTS}, s AS (SELECT *, lead(idx) OVER (PARTITION BY gid ORDER BY y, idx) nx FROM c) SELECT gid, idx FROM s WHERE nx - idx = 1")
def ordered_indices(spark, sf):
    df = curves.event_curves(spark, sf).select("gid", "idx", F.col("y").alias("x"))
    return od.ordered_indices(df).select("gid", F.col("idx").cast("long").alias("idx"))


GRAD = "CASE WHEN lag({0}) OVER w IS NULL AND lead({0}) OVER w IS NULL THEN 0 WHEN lag({0}) OVER w IS NULL THEN lead({0}) OVER w - {0} WHEN lead({0}) OVER w IS NULL THEN {0} - lag({0}) OVER w ELSE (lead({0}) OVER w - lag({0}) OVER w) / 2 END"


@query(f"WITH {EVENTS} SELECT gid, idx, round({GRAD.format('y')}, 6) + 0.0 g FROM c {W}")
def gradient(spark, sf):
    return out(curves.event_curves(spark, sf).withColumn("g", od.gradient("y")), ["gid", "idx"], "g")


D1 = f"d AS (SELECT *, ({GRAD.format('y')}) / ({GRAD.format('x')}) d FROM c {W})"


@query(f"WITH {VECTORS}, {D1}, e AS (SELECT *, ({GRAD.format('d')}) / ({GRAD.format('x')}) d2 FROM d {W}) SELECT gid, idx, round(d, 6) + 0.0 d1, round(d2, 6) + 0.0 d2 FROM e")
def derivatives(spark, sf):
    df = od.dmude(od.dmude(curves.vector_curves(spark, sf), "d1"), "d2", "d1")
    return out(df, ["gid", "idx"], "d1", "d2")


@query(f"""WITH {EVENTS}, s AS (SELECT *, coalesce(lead(y) OVER w, y) y2, coalesce(lag(y) OVER w, y) y1, coalesce(lead(x) OVER w, x) x2, coalesce(lag(x) OVER w, x) x1 FROM c {W})
SELECT gid, idx, round(CASE WHEN x2 = x1 THEN 0 ELSE (y2 - y1) / (x2 - x1) END * 1000, 6) + 0.0 dy FROM s""")
def overlay_derivative(spark, sf):
    df = od.overlay_derivative(curves.event_curves(spark, sf))
    return out(df.withColumn("dy", F.col("dy") * 1000), ["gid", "idx"], "dy")


@query(f"WITH {EVENTS} SELECT gid, idx, round(avg(y) OVER (PARTITION BY gid ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 ys FROM c")
def smooth5(spark, sf):
    return out(od.smooth5(curves.event_curves(spark, sf)), ["gid", "idx"], "ys")


@query(f"""WITH {EVENTS}, s AS (SELECT *, coalesce(y - lag(y) OVER w, 0) j FROM c {W}), t AS (SELECT *, round_even(abs(j) / pi(), 0) * sign(j) n FROM s)
SELECT gid, idx, round(y - pi() * sum(n) OVER (PARTITION BY gid ORDER BY idx), 6) + 0.0 unwrapped FROM t""")
def phase_unwrap(spark, sf):
    return out(od.phase_unwrap(curves.event_curves(spark, sf)), ["gid", "idx"], "unwrapped")


@query(f"WITH {EVENTS} SELECT gid, idx, round(x - first_value(x) OVER w, 6) + 0.0 t FROM c {W}")
def time_rebase(spark, sf):
    return out(od.time_rebase(curves.event_curves(spark, sf)), ["gid", "idx"], "t")


@query(f"""WITH {EVENTS}, s AS (SELECT gid, idx, avg(y) OVER (PARTITION BY gid ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) y, x FROM c WHERE x BETWEEN 200000 AND 2400000)
SELECT gid, round(arg_min(x, (-y, idx)), 6) + 0.0 x_peak, round(max(y), 6) + 0.0 y_peak, count(*) n FROM s GROUP BY gid""")
def peak_in_range(spark, sf):
    df = od.smooth5(od.trim(od.drop_nonfinite(curves.event_curves(spark, sf)), 2e5, 2.4e6))
    return out(ag.peak_in_range(df, 2e5, 2.4e6, "ys"), ["gid", "n"], "x_peak", "y_peak")


@query(f"""WITH {EVENTS}, n AS (SELECT gid, coalesce(max(CASE WHEN x <= 400000 THEN idx END), 0) a, coalesce(max(CASE WHEN x <= 1800000 THEN idx END), 0) b FROM c GROUP BY gid)
SELECT gid, min_by(idx, (-y, idx)) idx, round(max(y), 6) + 0.0 y FROM c JOIN n USING (gid) WHERE idx BETWEEN least(a, b) AND greatest(a, b) GROUP BY gid""")
def peak(spark, sf):
    df = ag.peak_between_indices(curves.event_curves(spark, sf), 4e5, 1.8e6)
    return df.select("gid", F.col("idx").cast("long").alias("idx"), r6(F.col("y")).alias("y"))


@query(f"""WITH {EVENTS}, n AS (SELECT gid, coalesce(max(CASE WHEN x <= 400000 THEN idx END), 0) a, coalesce(max(CASE WHEN x <= 1800000 THEN idx END), 0) b FROM c GROUP BY gid)
SELECT gid, min_by(idx, (y, idx)) idx, round(min(y), 6) + 0.0 y FROM c JOIN n USING (gid) WHERE idx BETWEEN least(a, b) AND greatest(a, b) GROUP BY gid""")
def valley(spark, sf):
    df = ag.peak_between_indices(curves.event_curves(spark, sf), 4e5, 1.8e6, valley=True)
    return df.select("gid", F.col("idx").cast("long").alias("idx"), r6(F.col("y")).alias("y"))


CROSS = "s AS (SELECT *, lag(x) OVER w x0, lag(y) OVER w y0 FROM {0} {1}), t AS (SELECT gid, idx, CASE WHEN y = y0 THEN x0 ELSE x0 + ({2} - y0) * (x - x0) / (y - y0) END a FROM s WHERE y0 IS NOT NULL AND least(y0, y) <= {2} AND {2} <= greatest(y0, y)) SELECT gid, round(arg_min(a, idx), 6) + 0.0 x_at FROM t GROUP BY gid"


@query(f"WITH {EVENTS}, " + CROSS.format("c", W, "60.0"))
def x_at_y(spark, sf):
    return out(ag.x_at_y(curves.event_curves(spark, sf), 60.0), ["gid"], "x_at")


@query(f"WITH {EVENTS}, h AS (SELECT *, max(y) OVER (PARTITION BY gid) / 2 lv FROM c), " + CROSS.format("h", W, "lv"))
def half_max(spark, sf):
    return out(ag.half_max(curves.event_curves(spark, sf)), ["gid"], "x_at")


@query(f"WITH {EVENTS} SELECT gid, round(sum(x * y) / sum(y), 6) + 0.0 centroid FROM c GROUP BY gid")
def centroid(spark, sf):
    return out(ag.centroid(curves.event_curves(spark, sf)), ["gid"], "centroid")


@query(f"WITH {EVENTS}, s AS (SELECT *, min(y) OVER (PARTITION BY gid) a, max(y) OVER (PARTITION BY gid) b FROM c) SELECT gid, idx, round(CASE WHEN a = b THEN y ELSE (y - a) / (b - a) END, 6) + 0.0 ys FROM s")
def same_height(spark, sf):
    return out(od.same_height(curves.event_curves(spark, sf)), ["gid", "idx"], "ys")


@query(f"WITH {EVENTS}, s AS (SELECT gid, x / 1e6 x, y FROM c) SELECT gid, round(regr_intercept(y, x), 6) + 0.0 c0, round(regr_slope(y, x), 6) + 0.0 c1 FROM s GROUP BY gid")
def polyfit1(spark, sf):
    return out(ag.polyfit(curves.event_curves(spark, sf).withColumn("x", F.col("x") / 1e6), 1), ["gid"], "c0", "c1")


@query(f"""WITH {VECTORS}, s AS (SELECT gid, (x - 1.575) / 1.575 u, y FROM c),
m AS (SELECT gid, count(*)::DOUBLE s0, sum(u) s1, sum(u * u) s2, sum(u * u * u) s3, sum(u * u * u * u) s4, sum(y) t0, sum(y * u) t1, sum(y * u * u) t2 FROM s GROUP BY gid),
d AS (SELECT gid, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) det,
 t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2) a, s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2) b,
 s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2) c FROM m)
SELECT gid, round(a / det - b / det + c / det, 6) + 0.0 c0, round((b / det - 2 * c / det) / 1.575, 6) + 0.0 c1, round(c / det / (1.575 * 1.575), 6) + 0.0 c2 FROM d""")
def polyfit2(spark, sf):
    return out(ag.polyfit(curves.vector_curves(spark, sf), 2), ["gid"], "c0", "c1", "c2")


@query(f"""WITH {EVENTS}, s AS (SELECT gid, idx, x / 1e6 x, y FROM c),
a AS (SELECT gid, regr_intercept(y, x) p0, regr_slope(y, x) p1 FROM s WHERE x BETWEEN 0.2 AND 1.0 GROUP BY gid),
b AS (SELECT gid, regr_intercept(y - p0 - p1 * x, x) q0, regr_slope(y - p0 - p1 * x, x) q1 FROM s JOIN a USING (gid) WHERE x BETWEEN 1.4 AND 2.5 GROUP BY gid)
SELECT gid, idx, round(p0 + p1 * x, 6) + 0.0 pre, round(p0 + p1 * x + q0 + q1 * x, 6) + 0.0 post, round((y - p0 - p1 * x) / greatest(abs(q0 + q1 * 1.2), 1e-12), 6) + 0.0 norm FROM s JOIN a USING (gid) JOIN b USING (gid)""")
def pre_edge_fixed(spark, sf):
    df = curves.event_curves(spark, sf).withColumn("x", F.col("x") / 1e6)
    c = F.col
    pre = ag.polyfit(df.where(c("x").between(0.2, 1.0)), 1).select("gid", c("c0").alias("p0"), c("c1").alias("p1"))
    df = df.join(pre, "gid").withColumn("pre", c("p0") + c("p1") * c("x"))
    post = ag.polyfit(df.where(c("x").between(1.4, 2.5)).withColumn("y", c("y") - c("pre")), 1).select("gid", c("c0").alias("q0"), c("c1").alias("q1"))
    df = df.join(post, "gid").withColumn("post", c("pre") + c("q0") + c("q1") * c("x"))
    step = F.greatest(F.abs(c("q0") + c("q1") * 1.2), F.lit(1e-12))
    return out(df.withColumn("norm", (c("y") - c("pre")) / step), ["gid", "idx"], "pre", "post", "norm")


def _grid_sql(points) -> str:
    return "g AS (SELECT unnest([" + ", ".join(f"{v!r}::DOUBLE" for v in points) + "]) g)"


LERP = f"""{_grid_sql(GRID)}, s AS (SELECT *, lead(x) OVER w x1, lead(y) OVER w y1, lag(x) OVER w IS NULL f FROM c {W}),
v AS (SELECT gid, g x, CASE WHEN g >= s.x AND x1 IS NOT NULL THEN y + (g - s.x) * (y1 - y) / (x1 - s.x) ELSE y END y,
      CASE WHEN g >= s.x AND x1 IS NOT NULL THEN y + (g - s.x) * (y1 - y) / (x1 - s.x) WHEN g = s.x THEN y END yn
      FROM s JOIN g ON (g >= s.x OR f) AND (g < x1 OR x1 IS NULL))"""


@query(f"WITH {EVENTS}, {LERP} SELECT gid, round(x, 6) + 0.0 x, round(y, 6) + 0.0 y FROM v")
def interp_linear(spark, sf):
    return out(grids.interp_linear(curves.event_curves(spark, sf), GRID), ["gid"], "x", "y")


@query(f"WITH {EVENTS}, {LERP} SELECT gid, round(x, 6) + 0.0 x, round(yn, 6) + 0.0 y FROM v")
def interp_inside(spark, sf):
    return out(grids.interp_linear(curves.event_curves(spark, sf), GRID, outside="null"), ["gid"], "x", "y")


@query(f"WITH {EVENTS}, {LERP} SELECT round(x, 6) + 0.0 x, round(avg(y), 6) + 0.0 y, count(*) n FROM v GROUP BY v.x")
def average_curves(spark, sf):
    return out(grids.average(curves.event_curves(spark, sf), GRID), ["n"], "x", "y")


@query(f"WITH {EVENTS} SELECT count(*) n, round(max(a), 6) + 0.0 lo, round(min(b), 6) + 0.0 hi FROM (SELECT gid, min(x) a, max(x) b FROM c GROUP BY gid)")
def grid_overlap(spark, sf):
    df = curves.event_curves(spark, sf).groupBy("gid").agg(F.min("x").alias("a"), F.max("x").alias("b")).agg(F.count("*").alias("n"), F.max("a").alias("lo"), F.min("b").alias("hi"))
    return out(df, ["n"], "lo", "hi")


@query(f"WITH {EVENTS} SELECT gid, round(floor(x / 200000 + 0.5) * 200000, 6) + 0.0 x, round(avg(y), 6) + 0.0 y, round(stddev_pop(y), 6) + 0.0 dy, count(*) n FROM c GROUP BY gid, floor(x / 200000 + 0.5)")
def rebin_boxcar(spark, sf):
    return out(ag.rebin(curves.event_curves(spark, sf), 2e5), ["gid", "n"], "x", "y", "dy")


@query(f"WITH {EVENTS} SELECT gid, round(floor(x / 200000 + 0.5) * 200000, 6) + 0.0 x, round(sum(x * y) / sum(x), 6) + 0.0 y, round(stddev_pop(y), 6) + 0.0 dy, count(*) n FROM c GROUP BY gid, floor(x / 200000 + 0.5)")
def rebin_centroid(spark, sf):
    return out(ag.rebin(curves.event_curves(spark, sf), 2e5, "centroid"), ["gid", "n"], "x", "y", "dy")


#: The vectors' points at steps of 0.2, so that all window edges lie inside
WINDOW_GRID = [i * 0.2 for i in range(64)]
WINDOWED = "(SELECT gid, idx i, idx * 0.2::DOUBLE x, y FROM c)"


def _window_sql(kind: str) -> str:
    c = fw.shape(WINDOW_GRID, kind, 2.0, 10.0, 1.0 if kind != "fha" else 0.3)
    flat = f"CASE WHEN i >= {c.up.last} AND i < {c.down.first} THEN 1.0 ELSE 0.0 END"
    up, down = f"((x - {c.up.lo!r}) / {c.up.hi - c.up.lo!r})", f"((x - {c.down.lo!r}) / {c.down.hi - c.down.lo!r})"
    if kind == "gaussian":
        w = f"exp(-power(x - {c.middle!r}, 2) / {2 * c.width * c.width!r})"
    elif kind == "sine":
        w = f"CASE WHEN i BETWEEN {c.up.first} AND {c.down.last} THEN sin(pi() * ({c.down.hi!r} - x) / {c.down.hi - c.up.lo!r}) ELSE {flat} END"
    else:
        rise, fall = {"parzen": (up, f"1 - {down}"), "welch": (f"1 - power((x - {c.up.hi!r}) / {c.up.hi - c.up.lo!r}, 2)", f"1 - power({down}, 2)")}.get(kind, (f"power(sin(pi() / 2 * {up}), 2)", f"power(cos(pi() / 2 * {down}), 2)"))
        w = f"CASE WHEN i BETWEEN {c.down.first} AND {c.down.last} THEN {fall} WHEN i BETWEEN {c.up.first} AND {c.up.last} THEN {rise} ELSE {flat} END"
    return f"WITH {VECTORS} SELECT gid, i idx, round(y * ({w}), 6) + 0.0 w FROM {WINDOWED}"


def _register_window(kind: str) -> None:
    def run(spark, sf):
        c = fw.shape(WINDOW_GRID, kind, 2.0, 10.0, 1.0 if kind != "fha" else 0.3)
        df = curves.vector_curves(spark, sf).withColumn("x", F.col("idx") * F.lit(0.2))
        return df.select("gid", "idx", r6(F.col("y") * fw.weight(F.col("idx"), F.col("x"), kind, c)).alias("w"))

    QUERIES[f"window_{kind}"], SQL[f"window_{kind}"] = run, _window_sql(kind)


for _kind in ("hanning", "fha", "parzen", "welch", "sine", "gaussian"):
    _register_window(_kind)


@query(f"""WITH {VECTORS}, {_grid_sql(R_GRID)} SELECT gid, round(g, 6) + 0.0 r, round(sum(y * cos(2 * x * g)) * {0.05 / math.sqrt(math.pi)!r}, 6) + 0.0 re, round(-sum(y * sin(2 * x * g)) * {0.05 / math.sqrt(math.pi)!r}, 6) + 0.0 im FROM c, g GROUP BY gid, g""")
def xftf_dft(spark, sf):
    return out(grids.dft_forward(curves.vector_curves(spark, sf), R_GRID, 0.05), ["gid"], "r", "re", "im")


@query(f"""WITH {VECTORS}, {_grid_sql(Q_GRID)}, z AS (SELECT a.gid, a.x r, a.y re, b.y im FROM c a JOIN c b ON a.gid = b.gid AND a.idx < 32 AND b.idx = a.idx + 32)
SELECT gid, round(g, 6) + 0.0 q, round(sum(re * cos(2 * g * r) - im * sin(2 * g * r)) * {0.05 / math.sqrt(math.pi)!r}, 6) + 0.0 re, round(sum(re * sin(2 * g * r) + im * cos(2 * g * r)) * {0.05 / math.sqrt(math.pi)!r}, 6) + 0.0 im FROM z, g GROUP BY gid, g""")
def xftr_dft(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("gid"), F.posexplode(F.arrays_zip(F.slice("embedding", 1, 32).alias("re"), F.slice("embedding", 33, 32).alias("im"))).alias("idx", "v"))
    rows = rows.select("gid", (F.col("idx") * F.lit(0.05)).alias("r"), F.col("v.re").cast("double").alias("re"), F.col("v.im").cast("double").alias("im"))
    return out(grids.dft_reverse(rows, Q_GRID, 0.05), ["gid"], "q", "re", "im")


@query(f"WITH {VECTORS}, w AS (SELECT unnest([0, 1, 2]) j, unnest([0.25, 0.5, 0.25]) w) SELECT gid, idx + j idx, round(sum(y * w), 6) + 0.0 y FROM c, w GROUP BY gid, idx + j")
def convolve_full(spark, sf):
    return out(od.convolve_full(curves.vector_curves(spark, sf), [0.25, 0.5, 0.25]), ["gid", "idx"], "y")


@query(f"""WITH {VECTORS} SELECT gid, idx, CASE WHEN idx BETWEEN 2 AND 61 THEN round((-3 * lag(y, 2) OVER w + 12 * lag(y) OVER w + 17 * y + 12 * lead(y) OVER w - 3 * lead(y, 2) OVER w) / 35, 6) + 0.0 END ys FROM c {W}""")
def savitzky_golay(spark, sf):
    return out(od.savitzky_golay(curves.vector_curves(spark, sf), [v / 35 for v in (-3, 12, 17, 12, -3)]), ["gid", "idx"], "ys")


@query(f"""WITH {VECTORS}, k AS (SELECT gid, idx, idx * 0.5 + 10 x, y FROM c), s AS (SELECT a.gid, a.idx, b.x * b.y / CASE WHEN abs(b.x * b.x - a.x * a.x) <= 1e-20 THEN 1e-20 ELSE b.x * b.x - a.x * a.x END t
FROM k a JOIN k b ON a.gid = b.gid AND (a.idx % 2) <> (b.idx % 2)) SELECT gid, idx, round(sum(t) * {-4 / math.pi * 0.5!r}, 6) + 0.0 kk FROM s GROUP BY gid, idx""")
def kk_sum(spark, sf):
    df = curves.vector_curves(spark, sf).withColumn("x", F.col("idx") * F.lit(0.5) + 10)
    return out(grids.kk_sum(df, 0.5), ["gid", "idx"], "kk")


@query(f"WITH {VECTORS} SELECT idx, round(avg(y), 6) + 0.0 mean FROM c GROUP BY idx")
def pca_mean(spark, sf):
    return out(ag.pca_mean(curves.vector_curves(spark, sf)), ["idx"], "mean")


@query(f"""WITH {VECTORS}, m AS (SELECT label gid, idx, avg(y) y FROM c JOIN embeddings e ON e.vec_id = c.gid GROUP BY 1, 2),
s AS (SELECT gid, idx, (y - avg(y) OVER (PARTITION BY gid)) / stddev_pop(y) OVER (PARTITION BY gid) z FROM m)
SELECT a.gid i, b.gid j, round(sum(a.z * b.z) / 64, 6) + 0.0 g FROM s a JOIN s b ON a.idx = b.idx AND a.gid <= b.gid GROUP BY 1, 2""")
def pca_gram(spark, sf):
    """The Gram matrix of a training set: the mean curve of each label over all rows."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.posexplode("embedding").alias("idx", "v"))
    means = rows.groupBy(F.col("label").alias("gid"), "idx").agg(F.avg(F.col("v").cast("double")).alias("y"))
    return out(ag.pca_gram(means), ["i", "j"], "g")


@query(f"""WITH {VECTORS}, s AS (SELECT gid, y, cos(3 * x) a, sin(2 * x) b FROM c), m AS (SELECT gid, sum((y - b) * (a - b)) n, sum((a - b) * (a - b)) d, sum(y * y) yy, sum((y - b) * (y - b)) rr FROM s GROUP BY gid)
SELECT gid, round(n / d, 6) + 0.0 w1, round(1 - n / d, 6) + 0.0 w2, round((rr - n / d * n) / yy, 6) + 0.0 rfactor FROM m""")
def lcf_two(spark, sf):
    x = F.col("x")
    return out(ag.lcf_two(curves.vector_curves(spark, sf), F.cos(3 * x), F.sin(2 * x)), ["gid"], "w1", "w2", "rfactor")


@query(f"""WITH {VECTORS}, s AS (SELECT gid, sum((y - 0.01 * idx) * (y - 0.01 * idx)) s, sum(y * y) d, count(*) n FROM c GROUP BY gid), t AS (SELECT *, s * 9.0 / n chi FROM s)
SELECT gid, round(chi, 6) + 0.0 chi_square, round(chi / 6, 6) + 0.0 chi_reduced, round(s / d, 6) + 0.0 rfactor, round(9 * ln(chi / 9) + 6, 6) + 0.0 aic, round(9 * ln(chi / 9) + {math.log(9.0)!r} * 3, 6) + 0.0 bic FROM t""")
def fit_stats(spark, sf):
    df = curves.vector_curves(spark, sf).select("gid", (F.col("y") - 0.01 * F.col("idx")).alias("residual"), F.col("y").alias("data"))
    return out(ag.fit_statistics(df, 9.0, 3), ["gid"], "chi_square", "chi_reduced", "rfactor", "aic", "bic")


@query(f"WITH {VECTORS} SELECT gid, round(sqrt(sum(y * y) / count(*)), 6) + 0.0 rms FROM c WHERE idx >= 40 GROUP BY gid")
def noise_rms(spark, sf):
    df = curves.vector_curves(spark, sf).where("idx >= 40").groupBy("gid").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rms"))
    return out(df, ["gid"], "rms")


@query("SELECT p_size, round(24.254367090467216 * ((exp(t / 600) + exp(-t / 600)) / (exp(t / 600) - exp(-t / 600))) / (t * m), 6) + 0.0 s2 FROM (SELECT DISTINCT p_size, 100.0::DOUBLE + 5 * p_size t, greatest(0.1, p_size / 2.0::DOUBLE) m FROM part)")
def sigma2_einstein(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_size").distinct()
    return out(df.withColumn("s2", p.sigma2_einstein(F.lit(300.0), 100.0 + 5 * F.col("p_size"), F.col("p_size") / 2.0)), ["p_size"], "s2")


@query("SELECT gid, round(1 / sum(1 / greatest(1, abs(v) * 100)), 6) + 0.0 rmass FROM (SELECT vec_id gid, unnest(embedding[1:3])::DOUBLE v FROM embeddings) GROUP BY gid")
def reduced_mass(spark, sf):
    m = F.transform(F.slice("embedding", 1, 3), lambda v: F.abs(v.cast("double")) * 100)
    return out(spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("gid"), p.reduced_mass(m).alias("rmass")), ["gid"], "rmass")


@query("SELECT p_partkey, round(p_size * 0.5 / p_retailprice * 1000, 6) + 0.0 mg FROM part")
def powder_mass(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", p.powder_mass(F.col("p_size").cast("double"), F.lit(0.5), F.col("p_retailprice")).alias("mg"))
    return out(df, ["p_partkey"], "mg")


FCC = [("Cu", 0.0, 0.0, 0.0), ("Cu", 0.0, 0.5, 0.5), ("Cu", 0.5, 0.0, 0.5), ("Cu", 0.5, 0.5, 0.0)]
CELL = (3.61, 3.61, 3.61, 90.0, 90.0, 90.0)
#: A cell whose sites are the suppliers, at coordinates that follow from their keys
BOX = (16.0, 16.0, 16.0, 90.0, 90.0, 90.0)
SITES_SQL = "s AS (SELECT s_suppkey site_id, (s_suppkey * 0.37::DOUBLE) % 1 fx, (s_suppkey * 0.61::DOUBLE) % 1 fy, (s_suppkey * 0.83::DOUBLE) % 1 fz FROM supplier), h AS (SELECT fx hx, fy hy, fz hz FROM s WHERE site_id = 7), a AS (SELECT site_id, (fx + i - hx) * 16 x, (fy + j - hy) * 16 y, (fz + k - hz) * 16 z FROM s, h, generate_series(-2, 2) p(i), generate_series(-2, 2) q(j), generate_series(-2, 2) u(k)), b AS (SELECT *, sqrt(x * x + y * y + z * z) r FROM a)"


def fcc(spark):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(FCC)], "site_id int, element string, fx double, fy double, fz double")


def supplier_sites(spark, sf):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("site_id"), F.lit("Cu").alias("element"), *((k * F.lit(v) % 1).alias(f"f{n}") for n, v in zip("xyz", (0.37, 0.61, 0.83))))


@query(f"WITH {SITES_SQL} SELECT site_id, round(x, 6) + 0.0 x, round(y, 6) + 0.0 y, round(z, 6) + 0.0 z, round(r, 6) + 0.0 r FROM b WHERE r <= 9.00000001")
def cluster(spark, sf):
    return out(lattice.cluster(supplier_sites(spark, sf), BOX, 7, 9.0), ["site_id"], "x", "y", "z", "r")


@query(f"""WITH RECURSIVE {SITES_SQL}, n AS (SELECT r, row_number() OVER (ORDER BY r) n FROM b WHERE r <= 9.00000001 AND r > 1e-8),
w AS (SELECT n, r, r head, 1 shell FROM n WHERE n = 1 UNION ALL SELECT n.n, n.r, CASE WHEN n.r - head <= 0.05 THEN head ELSE n.r END, shell + CASE WHEN n.r - head <= 0.05 THEN 0 ELSE 1 END FROM w JOIN n ON n.n = w.n + 1)
SELECT shell::INT shell, round(min(r), 6) + 0.0 r, count(*) n FROM w WHERE shell <= 10 GROUP BY shell""")
def shell_counts(spark, sf):
    return out(lattice.shells(lattice.cluster(supplier_sites(spark, sf), BOX, 7, 9.0)), ["shell", "n"], "r")


@query(f"WITH {EVENTS} SELECT idx, round(max(CASE WHEN gid % 3 = 0 THEN y END), 6) + 0.0 g0, round(max(CASE WHEN gid % 3 = 1 THEN y END), 6) + 0.0 g1, round(max(CASE WHEN gid % 3 = 2 THEN y END), 6) + 0.0 g2 FROM c GROUP BY idx")
def wide_table(spark, sf):
    df = curves.event_curves(spark, sf).withColumn("label", F.concat(F.lit("g"), (F.col("gid") % 3).cast("string")))
    return out(df.groupBy("idx").pivot("label", ["g0", "g1", "g2"]).agg(F.max("y")), ["idx"], "g0", "g1", "g2")


@query("SELECT l_orderkey fit_id, " + ", ".join(f"coalesce(round({sign}max(CASE WHEN l_linenumber = {i} THEN {v} END), 6), 0) + 0.0 {n}{i}{e}" for n, own in (("deltar", ""), ("sigma2", "-")) for i in range(1, 8) for sign, v, e in ((own, "l_quantity", ""), ("", "l_discount", "_err"))) + " FROM lineitem GROUP BY l_orderkey")
def save_items(spark, sf):
    """Path values of fits by columns: an order is a fit, its lines are paths."""
    from edgelight.operators import fits

    value = lambda name, v: F.struct(F.concat(F.lit("0/"), (F.col("l_linenumber") - 1).cast("string"), F.lit(f"/{name}")).alias("name"), v.cast("double").alias("value"), F.col("l_discount").cast("double").alias("stderr"))
    lines = items(spark, sf).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    results = lines.select(F.col("l_orderkey").alias("fit_id"), F.lit("path").alias("kind"), F.explode(F.array(value("deltar", it()), value("sigma2", -it()))).alias("v")).select("fit_id", "kind", "v.*")
    wide = fits.save_items(results, ["deltar", "sigma2"], 1, 7)
    names = {f"0_{i - 1}_{n}{e}": f"{n}{i}{e}" for n in ("deltar", "sigma2") for i in range(1, 8) for e in ("", "_err")}
    return wide.select("fit_id", *(r6(F.col(c)).alias(n) for c, n in names.items()))


@query("SELECT label, idx, line, intensity FROM (SELECT label, idx, round(i, 6) + 0.0 intensity, row_number() OVER (PARTITION BY label ORDER BY i DESC, idx) AS line FROM (SELECT label, vec_id idx, abs(embedding[1]::DOUBLE) i FROM embeddings) WHERE i >= 0.01) WHERE line <= 8")
def emission_lines(spark, sf):
    """The eight strongest lines of each label; a top-k report."""
    from pyspark.sql import Window

    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.col("vec_id").alias("idx"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("intensity")).where("intensity >= 0.01")
    df = df.withColumn("line", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("intensity"), "idx"))).where("line <= 8")
    return out(df.withColumn("line", F.col("line").cast("long")), ["label", "idx", "line"], "intensity")



@query("SELECT count(*) n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT built, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT written, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT failed FROM events")
def status_counts(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("built"), F.count_if(F.col("value") > 100).alias("written"), F.count_if(F.col("value").isNull()).alias("failed"))


@query("SELECT label, count(*) n, min(vec_id) first_id FROM embeddings GROUP BY label")
def atom_counts(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("SELECT o_orderkey, n_name, round(o_totalprice, 6) + 0.0 total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def dimension_lookup(spark, sf):
    """Rows with an attribute of a small dimension table, as masses are looked up by element."""
    o, c, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer", "nation"))
    df = o.select("o_orderkey", "o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return out(df.join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("o_totalprice", "total"), ["o_orderkey", "n_name"], "total")


@query(f"WITH {VECTORS} SELECT label dsid, idx, round(sum(y), 6) + 0.0 chi FROM c JOIN embeddings e ON e.vec_id = c.gid GROUP BY label, idx")
def sum_paths(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").alias("dsid"), F.posexplode("embedding").alias("idx", "v"))
    return out(rows.groupBy("dsid", "idx").agg(F.sum(F.col("v").cast("double")).alias("chi")), ["dsid", "idx"], "chi")
