"""Queries over grids that are tables, cubic interpolation, small dense fits and moments, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelight import curves
from edgelight.operators import components, leastsq, resample
from edgelight.plans.native_queries import EVENTS, VECTORS, W, out

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Vectors on a grid of uneven steps, shifted from curve to curve
UNEVEN = "c AS (SELECT vec_id gid, i idx, i * 0.05::DOUBLE + (i % 3) * 0.004::DOUBLE + (vec_id % 7) * 0.01::DOUBLE x, embedding[i + 1]::DOUBLE y FROM embeddings, generate_series(0, 63) t(i))"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def uneven(spark, sf):
    return curves.vector_curves(spark, sf).withColumn("x", F.col("x") + F.col("idx") % 3 * F.lit(0.004) + F.col("gid") % 7 * F.lit(0.01))


#: Each curve's own grid: half-way to a day after every third of its points, and one point far left
OWN_GRID = "g AS (SELECT gid, x + 43200 x FROM c WHERE idx % 3 = 0 UNION ALL SELECT gid, -1000::DOUBLE FROM c WHERE idx = 0)"
AS_OF = f"s AS (SELECT *, lead(x) OVER w x1, lead(y) OVER w y1, first(y) OVER w y0 FROM c {W})"


def own_grid(df):
    return df.where("idx % 3 = 0").select("gid", (F.col("x") + 43200).alias("x")).unionByName(df.where("idx = 0").select("gid", F.lit(-1000.0).alias("x")))


@query(f"""WITH {EVENTS}, {OWN_GRID}, {AS_OF}, f AS (SELECT gid, y y0 FROM c WHERE idx = 0)
SELECT g.gid, round(g.x, 6) + 0.0 x, round(CASE WHEN s.x IS NULL THEN f.y0 WHEN s.x1 IS NULL THEN s.y ELSE s.y + (g.x - s.x) * (s.y1 - s.y) / (s.x1 - s.x) END, 6) + 0.0 y
FROM g ASOF LEFT JOIN s ON g.gid = s.gid AND g.x >= s.x JOIN f ON f.gid = g.gid""")
def interp_own_grids(spark, sf):
    """Every curve at the points of a grid of its own."""
    df = curves.event_curves(spark, sf)
    return out(resample.linear(df, own_grid(df)), ["gid"], "x", "y")


@query(f"""WITH {EVENTS}, {OWN_GRID}, {AS_OF}
SELECT g.gid, round(g.x, 6) + 0.0 x, round(CASE WHEN s.x1 IS NULL THEN CASE WHEN s.x = g.x THEN s.y END ELSE s.y + (g.x - s.x) * (s.y1 - s.y) / (s.x1 - s.x) END, 6) + 0.0 y
FROM g ASOF LEFT JOIN s ON g.gid = s.gid AND g.x >= s.x""")
def interp_own_grids_inside(spark, sf):
    df = curves.event_curves(spark, sf)
    return out(resample.linear(df, own_grid(df), outside="null"), ["gid"], "x", "y")


def _sweep(name: str, source: str) -> str:
    """CTEs name_a (forward) and name_m (slopes m of gid, idx) of the interpolating cubic through source (gid, idx, x, y)."""
    return f"""{name}_n AS (SELECT gid, max(idx) n FROM {source} GROUP BY gid),
{name}_h AS (SELECT c.*, n, lead(x) OVER w - x h, (lead(y) OVER w - y) / (lead(x) OVER w - x) s FROM {source} c JOIN {name}_n USING (gid) {W}),
{name}_e AS (SELECT *, lag(h) OVER w hp, lag(s) OVER w sp, lead(h) OVER w hn, lead(s) OVER w sn, lag(h, 2) OVER w hq, lag(s, 2) OVER w sq FROM {name}_h {W}),
{name}_r AS (SELECT gid, idx, n, CASE WHEN idx = 0 THEN 0 WHEN idx = n THEN hp + hq ELSE h END lo, CASE WHEN idx = 0 THEN hn WHEN idx = n THEN hq ELSE 2 * (h + hp) END di,
  CASE WHEN idx = 0 THEN h + hn WHEN idx = n THEN 0 ELSE hp END up,
  CASE WHEN idx = 0 THEN (hn * (3 * h + 2 * hn) * s + h * h * sn) / (h + hn) WHEN idx = n THEN (hq * (3 * hp + 2 * hq) * sp + hp * hp * sq) / (hp + hq) ELSE 3 * (h * sp + hp * s) END rhs FROM {name}_e),
{name}_a AS (SELECT gid, idx, n, up / di c, rhs / di d FROM {name}_r WHERE idx = 0 UNION ALL
  SELECT r.gid, r.idx, r.n, r.up / (r.di - r.lo * a.c), (r.rhs - r.lo * a.d) / (r.di - r.lo * a.c) FROM {name}_a a JOIN {name}_r r ON r.gid = a.gid AND r.idx = a.idx + 1),
{name}_m AS (SELECT gid, idx, d m FROM {name}_a WHERE idx = n UNION ALL
  SELECT a.gid, a.idx, a.d - a.c * m.m FROM {name}_m m JOIN {name}_a a ON a.gid = m.gid AND a.idx = m.idx - 1)"""


CUBIC = f"""WITH RECURSIVE {UNEVEN}, ca AS (SELECT * FROM c WHERE idx < 5), cb AS (SELECT gid, idx - 59 idx, x, y FROM c WHERE idx >= 59),
{_sweep("o", "c")}, {_sweep("a", "ca")}, {_sweep("b", "cb")},
p AS (SELECT gid, idx, x, y, m FROM c JOIN o_m USING (gid, idx)), pa AS (SELECT gid, idx, x, y, m FROM ca JOIN a_m USING (gid, idx)), pb AS (SELECT gid, idx, x, y, m FROM cb JOIN b_m USING (gid, idx)),
seg AS (SELECT gid, x start, x x0, y y0, m m0, lead(x) OVER w x1, lead(y) OVER w y1, lead(m) OVER w m1 FROM p {W}),
segs AS (SELECT * FROM seg WHERE x1 IS NOT NULL
  UNION ALL SELECT l.gid, -1e9, l.x, l.y, l.m, r.x, r.y, r.m FROM pa l JOIN pa r ON r.gid = l.gid AND r.idx = 1 WHERE l.idx = 0
  UNION ALL SELECT l.gid, r.x, l.x, l.y, l.m, r.x, r.y, r.m FROM pb l JOIN pb r ON r.gid = l.gid AND r.idx = 4 WHERE l.idx = 3),
g AS (SELECT gid, x FROM (SELECT DISTINCT gid FROM c), (SELECT i * 0.11::DOUBLE - 0.1 x FROM generate_series(0, 30) t(i))),
v AS (SELECT g.gid, g.x, segs.*, (g.x - x0) / (x1 - x0) u FROM g ASOF JOIN segs ON g.gid = segs.gid AND g.x >= segs.start)
SELECT gid, round(x, 6) + 0.0 x, round(y0 * (1 + 2 * u) * (1 - u) * (1 - u) + m0 * (x1 - x0) * u * (1 - u) * (1 - u) + y1 * u * u * (3 - 2 * u) + m1 * (x1 - x0) * u * u * (u - 1), 6) + 0.0 y FROM v"""


@query(CUBIC)
def interp_cubic(spark, sf):
    """Every vector at points of one shared grid, some of them outside of it, by the interpolating cubic."""
    df = curves.wide(uneven(spark, sf))
    grid = spark.range(31).select((F.col("id") * F.lit(0.11) - 0.1).alias("x"))
    return out(resample.cubic(df, resample.shared(df, grid)), ["gid"], "x", "y")


@query(CUBIC.replace("g AS (SELECT gid, x FROM (SELECT DISTINCT gid FROM c), (SELECT i * 0.11::DOUBLE - 0.1 x FROM generate_series(0, 30) t(i)))", """z AS (SELECT max(a) lo, min(b) hi, min(gid) first FROM (SELECT gid, min(x) a, max(x) b FROM c GROUP BY gid)),
own AS (SELECT gid, x, y FROM c, z WHERE gid = first AND x <= hi AND x >= (SELECT coalesce(max(x) FILTER (x <= lo), min(x)) FROM c, z WHERE gid = first)),
g AS (SELECT d.gid, own.x FROM (SELECT DISTINCT gid FROM c) d, own WHERE d.gid <> own.gid)""") + " UNION ALL SELECT gid, round(x, 6) + 0.0, round(y, 6) + 0.0 FROM own")
def common_grid(spark, sf):
    """Every vector on the first one's grid."""
    return out(resample.common_grid(curves.wide(uneven(spark, sf))), ["gid"], "x", "y")


def _orthogonal(degree: int) -> str:
    """Least-squares values by orthogonal polynomials: p_k+1 = (u - a) p_k - b p_k-1, each curve with its own sums."""
    own = "PARTITION BY gid"
    steps = [f"q0 AS (SELECT gid, idx, y, (x - (max(x) OVER v + min(x) OVER v) / 2) / ((max(x) OVER v - min(x) OVER v) / 2) u, 1::DOUBLE p, 0::DOUBLE q, 1::DOUBLE qq, 0::DOUBLE f FROM c WINDOW v AS ({own}))"]
    for k in range(degree + 1):
        steps.append(f"r{k} AS (SELECT gid, idx, y, u, p, q, qq, sum(p * p) OVER v pp, sum(u * p * p) OVER v up, f + p * sum(y * p) OVER v / sum(p * p) OVER v f FROM q{k} WINDOW v AS ({own}))")
        steps.append(f"q{k + 1} AS (SELECT gid, idx, y, u, (u - up / pp) * p - {'pp / qq' if k else '0'} * q p, p q, pp qq, f FROM r{k})")
    return f"WITH {EVENTS}, n AS (SELECT gid FROM c GROUP BY gid HAVING count(DISTINCT x) > {degree}), " + ", ".join(steps) + f" SELECT gid, idx, round(f, 4) + 0.0 fit FROM r{degree} SEMI JOIN n USING (gid)"


def _polynomial(spark, sf, degree):
    df = curves.event_curves(spark, sf).withColumn("x", F.col("x") / 86400)
    fit = leastsq.polyfit(df, degree)
    rows = df.join(fit, "gid").withColumn("fit", leastsq.polyval(F.col("c"), F.col("x"))).where("fit is not null")
    return rows.select("gid", "idx", (F.round("fit", 4) + 0.0).alias("fit"))


@query(_orthogonal(3))
def polyfit3(spark, sf):
    return _polynomial(spark, sf, 3)


@query(_orthogonal(4))
def polyfit4(spark, sf):
    return _polynomial(spark, sf, 4)


@query(_orthogonal(5))
def polyfit5(spark, sf):
    return _polynomial(spark, sf, 5)


@query(f"""WITH {VECTORS}, d AS (SELECT gid, y, cos(3 * x) - exp(-x) a, sin(2 * x) - exp(-x) b, y - exp(-x) r FROM c),
s AS (SELECT gid, sum(a * a) aa, sum(a * b) ab, sum(b * b) bb, sum(a * r) ar, sum(b * r) br, sum(r * r) rr, sum(y * y) yy FROM d GROUP BY gid),
w AS (SELECT *, (ar * bb - br * ab) / (aa * bb - ab * ab) w1, (br * aa - ar * ab) / (aa * bb - ab * ab) w2 FROM s)
SELECT gid, round(w1, 6) + 0.0 w1, round(w2, 6) + 0.0 w2, round(1 - w1 - w2, 6) + 0.0 w3, round((rr - w1 * ar - w2 * br) / yy, 6) + 0.0 rfactor FROM w""")
def lcf_three(spark, sf):
    """Weights of three components that sum to one."""
    x = F.col("x")
    fit = leastsq.lcf(curves.vector_curves(spark, sf), [F.cos(3 * x), F.sin(2 * x), F.exp(-x)])
    rows = fit.select("gid", "rfactor", *(F.get("weights", F.lit(i)).alias(f"w{i + 1}") for i in range(3)))
    return out(rows, ["gid"], "w1", "w2", "w3", "rfactor")


@query(f"""WITH {VECTORS}, m AS (SELECT idx, avg(y) mean FROM c GROUP BY idx), d AS (SELECT gid, idx, y - mean z FROM c JOIN m USING (idx)),
z AS (SELECT gid, idx, (z - avg(z) OVER v) / stddev_pop(z) OVER v z FROM d WINDOW v AS (PARTITION BY gid))
SELECT a.idx i, b.idx j, round(avg(a.z * b.z), 6) + 0.0 m FROM z a JOIN z b ON a.gid = b.gid AND a.idx <= b.idx GROUP BY 1, 2""")
def pca_moments(spark, sf):
    """Second moments of all vectors, standardised."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("y"))
    means = [r["mean"] for r in components.point_means(rows).orderBy("idx").limit(components.MOST_POINTS).collect()]
    return out(components.second_moments(rows, means), ["i", "j"], "m")
