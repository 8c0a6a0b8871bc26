"""Kernels of reduction and analysis point by point, each with SQL that computes the same from its definition."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from edgelight.constants import KTOE
from edgelight.kernels import fourier as ft
from edgelight.kernels import reduction as rd
from edgelight.operators import spectra as sx
from edgelight.plans.file_queries import points, vectors
from edgelight.plans.kernel_queries import E0, spectra
from edgelight.plans.native_queries import VECTORS, out
from edgelight.plans.view_queries import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


#: The spectra of kernel_queries.spectra: gid, i, energy e and mu
SPECTRA = f"""v AS (SELECT vec_id gid, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b FROM embeddings),
s AS (SELECT gid, i, {E0}::DOUBLE - 150 + 2 * i e, 0.6::DOUBLE - 3e-4::DOUBLE * (2 * i - 150) + (1 + 0.5::DOUBLE * b) * (0.5::DOUBLE + atan((2 * i - 150) / 1.5::DOUBLE) / pi()) * (1 - 2e-4::DOUBLE * (2 * i - 150))
  + CASE WHEN i > 75 THEN (0.1::DOUBLE + 0.2::DOUBLE * a) * sin(4.6::DOUBLE * sqrt((2 * i - 150) * 0.2625::DOUBLE)) * exp(-0.01::DOUBLE * (2 * i - 150) * 0.2625::DOUBLE) / (1 + sqrt((2 * i - 150) * 0.2625::DOUBLE)) ELSE 0 END mu FROM v, generate_series(0, 480) g(i))"""


@query(f"""WITH {SPECTRA}, l AS (SELECT gid, regr_slope(mu, e - 8979) m, regr_intercept(mu, e - 8979) c FROM s WHERE i BETWEEN 15 AND 54 GROUP BY gid),
d AS (SELECT s.gid, i, e, mu, c + m * (e - 8979) pre, i - 274.5::DOUBLE u FROM s JOIN l USING (gid)), q AS (SELECT avg(u * u) m2 FROM d WHERE i BETWEEN 125 AND 424),
f AS (SELECT gid, avg(mu - pre) c0, sum(u * (mu - pre)) / sum(u * u) c1, sum((u * u - m2) * (mu - pre)) / sum((u * u - m2) * (u * u - m2)) c2 FROM d, q WHERE i BETWEEN 125 AND 424 GROUP BY gid),
p AS (SELECT d.*, c0 + c1 * u + c2 * (u * u - m2) rise, abs(c0 - 199.5::DOUBLE * c1 + c2 * (199.5::DOUBLE * 199.5::DOUBLE - m2)) step, c0 - 199.5::DOUBLE * c1 + c2 * (199.5::DOUBLE * 199.5::DOUBLE - m2) at_edge FROM d JOIN f USING (gid), q),
n AS (SELECT gid, i, e, step, (mu - pre) / step norm, (rise - at_edge) / step bend FROM p)
SELECT gid, i idx, round(step, 6) + 0.0 edge_step, round(norm, 6) + 0.0 norm, round(CASE WHEN i < 75 THEN norm ELSE norm - bend END, 6) + 0.0 flat,
  round((coalesce(lead(norm) OVER w, norm) - coalesce(lag(norm) OVER w, norm)) / (coalesce(lead(e) OVER w, e) - coalesce(lag(e) OVER w, e)), 6) + 0.0 dmude FROM n WINDOW w AS (PARTITION BY gid ORDER BY i)""")
def pre_edge_points(spark, sf):
    """Normalised, flattened and differentiated spectra over fixed ranges."""
    done = sx.pre_edge(spectra(spark, sf), rd.PreEdgeParams(e0=E0, pre1=-120.0, pre2=-40.0, norm1=100.0, norm2=700.0, nnorm=2))
    return out(points(done.select("gid", "edge_step", "norm", "flat", "dmude"), "norm", "flat", "dmude"), ["gid", "idx"], "edge_step", "norm", "flat", "dmude")


K = f"{KTOE!r}::DOUBLE"


@query(f"""WITH {SPECTRA}, g0 AS (SELECT i r, 8979 + (-150 + 2 * i)::DOUBLE g FROM generate_series(0, 59) t(i) UNION ALL SELECT 100 + i, 8979 + (-30 + i * 45 / 128::DOUBLE) FROM generate_series(0, 127) t(i)),
k AS (SELECT sqrt(15 / {K}) a, sqrt(810 / {K}) b), c AS (SELECT a, b, floor(0.1::DOUBLE + (b - a) / 0.05::DOUBLE)::BIGINT n FROM k),
g1 AS (SELECT * FROM g0 UNION ALL SELECT 1000 + i, 8979 + power(a + i * (b - a) / n, 2) * {K} FROM c, generate_series(0, 5000) t(i) WHERE i < n),
g AS (SELECT row_number() OVER (ORDER BY r) - 1 idx, g, least(480, greatest(0, floor((g - 8829) / 2)))::BIGINT p FROM g1),
t AS (SELECT idx, g, p, coalesce((p + lead(p) OVER (ORDER BY idx) + 1) // 2, 480) top FROM g),
b AS (SELECT *, coalesce(lag(top) OVER (ORDER BY idx), 0) low FROM t), x AS (SELECT *, CASE WHEN least(top + 1, 481) - low < 3 THEN least(least(top + 1, 481) + 1, 481) ELSE least(top + 1, 481) END stop FROM b),
y AS (SELECT *, top - low < 3 AND 8829 + 2 * (stop - 1) < g again FROM x), z AS (SELECT idx, g, p, top, low - CASE WHEN again AND low > 0 THEN 1 ELSE 0 END low, top - low < 3 few FROM y),
m AS (SELECT s.gid, z.idx, z.g, avg(mu) FILTER (WHERE i >= low AND i < top) mean, stddev_pop(mu) FILTER (WHERE i >= low AND i < top) dev, any_value(few) few,
  max(mu) FILTER (WHERE i = p) y0, max(mu) FILTER (WHERE i = p + 1) y1, any_value(p) p FROM z JOIN s ON s.i BETWEEN least(low, p) AND greatest(top, p + 1) GROUP BY s.gid, z.idx, z.g)
SELECT gid, idx, round(g, 6) + 0.0 energy, round(CASE WHEN few THEN y0 + (coalesce(y1, y0) - y0) * (g - (8829 + 2 * p)) / 2 ELSE mean END, 6) + 0.0 mu, round(dev, 6) + 0.0 delta_mu FROM m""")
def rebin_points(spark, sf):
    """Spectra in bins of three regions, those of fewer than three points interpolated; a bin without points has no deviation."""
    done = points(sx.rebin(spectra(spark, sf), e0=E0).select("gid", "energy", "mu", "delta_mu"), "energy", "mu", "delta_mu")
    return out(done.withColumn("delta_mu", F.when(~F.isnan("delta_mu"), F.col("delta_mu"))), ["gid", "idx"], "energy", "mu", "delta_mu")


@query(f"""WITH {SPECTRA}, f AS (SELECT gid, 5 + i + 1 j, (mu + lead(mu) OVER (PARTITION BY gid ORDER BY i)) / 2 y, i FROM s),
flat AS (SELECT gid, j, y FROM f WHERE i < 480 UNION ALL SELECT gid, j, mu FROM s, generate_series(0, 5) t(j) WHERE i = 0 UNION ALL SELECT gid, j, mu FROM s, generate_series(486, 490) t(j) WHERE i = 480),
l AS (SELECT t, 1 / ((t - 491)::DOUBLE * (t - 491) + 1) w FROM generate_series(0, 981) a(t)), a AS (SELECT sum(w) total FROM l),
o AS (SELECT j o, CASE WHEN 981 + j - t < 490 THEN 490 - (981 + j - t) WHEN 981 + j - t < 981 THEN 981 + j - t - 490 ELSE 1471 - (981 + j - t) END j, w / total w FROM l, a, generate_series(0, 490) b(j)),
m AS (SELECT i, o.j, sum(w) / 2 w FROM o JOIN generate_series(0, 480) c(i) ON o.o IN (5 + i, 6 + i) GROUP BY i, o.j)
SELECT gid, i idx, round(sum(w * y), 6) + 0.0 mu FROM m JOIN flat USING (j) GROUP BY gid, i""")
def smooth_points(spark, sf):
    """Spectra convolved with a Lorentzian as wide as their step."""
    return out(points(sx.smooth(spectra(spark, sf), sigma=2.0).select("gid", "mu"), "mu"), ["gid", "idx"], "mu")


KWIN = {"kmin": 0.5, "kmax": 2.5, "dk": 0.5, "nfft": 256}


def _forward_sql() -> str:
    weights = [float(v) for v in ft.k_window(64, 0.05, "hanning", 0.5, 2.5, 0.5, None) * (0.05 * np.arange(64)) ** 2]
    turn, scale = "(2 * pi() * idx * m / 256)", f"{0.05 / math.sqrt(math.pi)!r}::DOUBLE"
    return f"""WITH {VECTORS}, w AS (SELECT unnest({weights}) w, unnest(generate_series(0, 63)) idx), m AS (SELECT unnest(range(0, 17)) m),
h AS (SELECT gid, m, sum(y * w * cos{turn}) * {scale} re, -sum(y * w * sin{turn}) * {scale} im FROM c JOIN w USING (idx), m GROUP BY gid, m)
SELECT gid, m idx, round(m * {math.pi / (0.05 * 256)!r}::DOUBLE, 6) + 0.0 r, round(re, 6) + 0.0 chir_re, round(im, 6) + 0.0 chir_im, round(sqrt(re * re + im * im), 6) + 0.0 chir_mag FROM h"""


@query(_forward_sql())
def xftf_points(spark, sf):
    """The transform to R of every vector as chi(k)."""
    done = sx.xftf(vectors(spark, sf).withColumnRenamed("y", "chi"), rmax_out=4.0, **KWIN)
    names = ("r", "chir_re", "chir_im", "chir_mag")
    return out(points(done.select("gid", *names), *names), ["gid", "idx"], *names)


def _reverse_sql() -> str:
    weights = [float(v) for v in ft.window(0.05 * np.arange(256), "hanning", 0.3, 1.3, 0.2, None)[:32]]
    kstep = math.pi / (0.05 * 256)
    top = 4.0
    n = int(1.05 + top / kstep)
    turn, scale = "(2 * pi() * idx * m / 256)", f"{2 * math.sqrt(math.pi) / kstep / 256!r}::DOUBLE"
    return f"""WITH {VECTORS}, z AS (SELECT a.gid, a.idx, a.y re, b.y im FROM c a JOIN c b ON a.gid = b.gid AND a.idx < 32 AND b.idx = a.idx + 32),
w AS (SELECT unnest({weights}) w, unnest(generate_series(0, 31)) idx), m AS (SELECT unnest(range(0, {n})) m),
h AS (SELECT gid, m, sum(w * (re * cos{turn} - im * sin{turn})) * {scale} re, sum(w * (re * sin{turn} + im * cos{turn})) * {scale} im FROM z JOIN w USING (idx), m GROUP BY gid, m)
SELECT gid, m idx, round(m * {top / (n - 1)!r}::DOUBLE, 6) + 0.0 q, round(re, 6) + 0.0 chiq_re, round(im, 6) + 0.0 chiq_im, round(sqrt(re * re + im * im), 6) + 0.0 chiq_mag FROM h"""


@query(_reverse_sql())
def xftr_points(spark, sf):
    """The transform back from R of every vector, whose halves are the real and imaginary parts."""
    y = F.transform("embedding", lambda v: v.cast("double"))
    r = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i * F.lit(0.05))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gid"), r.alias("r"), F.slice(y, 1, 32).alias("chir_re"), F.slice(y, 33, 32).alias("chir_im"))
    names = ("q", "chiq_re", "chiq_im", "chiq_mag")
    done = sx.xftr(rows, rmin=0.3, rmax=1.3, dr=0.2, qmax_out=4.0, nfft=256)
    return out(points(done.select("gid", *names), *names), ["gid", "idx"], *names)


@query(f"""WITH {VECTORS}, d AS (SELECT gid, y, exp(-x) z, cos(3 * x) - exp(-x) p, sin(2 * x) - exp(-x) q FROM c),
n AS (SELECT gid, sum(p * p) pp, sum(p * q) pq, sum(q * q) qq, sum(p * (y - z)) py, sum(q * (y - z)) qy, sum((y - z) * (y - z)) yy, sum(y * y) total FROM d GROUP BY gid),
w AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) w1, (qy * pp - py * pq) / (pp * qq - pq * pq) w2 FROM n)
SELECT gid, round(w1, 5) + 0.0 w1, round(w2, 5) + 0.0 w2, round(1 - w1 - w2, 5) + 0.0 w3, round((yy - w1 * py - w2 * qy) / total, 5) + 0.0 rfactor FROM w""")
def lincombo_points(spark, sf):
    """Weights of three curves that sum to one, for every vector."""
    x = 0.05 * np.arange(64)
    done = sx.lincombo(vectors(spark, sf), [np.cos(3 * x), np.sin(2 * x), np.exp(-x)])
    return done.select("gid", *((F.round(F.get("weights", F.lit(i)), 5) + 0.0).alias(f"w{i + 1}") for i in range(3)), (F.round("rfactor", 5) + 0.0).alias("rfactor"))
