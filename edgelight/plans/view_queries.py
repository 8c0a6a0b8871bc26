"""Queries over the selections, projections, common grids and text forms of operators.views, with the SQL of the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from edgelight import curves
from edgelight.functions import ftwindow as fw
from edgelight.functions import pointwise as p
from edgelight.operators import aggregates as ag
from edgelight.operators import grids, lattice, spectra, views
from edgelight.plans.native_queries import EVENTS, VECTORS, W, WINDOW_GRID, WINDOWED, out

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Vectors whose grids are shifted against each other
SHIFTED = "c AS (SELECT vec_id gid, i idx, i * 0.05::DOUBLE + (vec_id % 7) * 0.01::DOUBLE x, embedding[i + 1]::DOUBLE y FROM embeddings, generate_series(0, 63) g(i))"
RANGE = "r AS (SELECT max(a) lo, min(b) hi FROM (SELECT min(x) a, max(x) b FROM c GROUP BY gid))"
INTERP = """s AS (SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM c WINDOW w AS (PARTITION BY gid ORDER BY idx)),
v AS (SELECT s.gid, g.g, CASE WHEN x1 IS NULL THEN y ELSE y + (g.g - x) * (y1 - y) / (x1 - x) END y FROM s JOIN g ON g.g >= x AND (g.g < x1 OR x1 IS NULL))"""
CENTERS = [float(i) for i in range(0, 28 * 86400, 3 * 86400)]
WEIGHTS = [-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def shifted(spark, sf):
    return curves.vector_curves(spark, sf).withColumn("x", F.col("x") + F.col("gid") % 7 * F.lit(0.01))


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(f"WITH {EVENTS} SELECT gid, min({{d: abs(x - 1000000), i: idx}}).i idx FROM c GROUP BY gid")
def index_nearest(spark, sf):
    return curves.event_curves(spark, sf).groupBy("gid").agg(ag.index_nearest(1e6).alias("idx"))


@query(f"WITH {EVENTS} SELECT gid, idx, round(2.5 * (0.5 + atan(-(x - 1200000) / 30000::DOUBLE) / pi()), 6) + 0.0 step FROM c")
def arctan_step(spark, sf):
    return out(curves.event_curves(spark, sf).withColumn("step", p.arctan_step(F.col("x"), 2.5, 1.2e6, -3e4)), ["gid", "idx"], "step")


BASE = "1.5 * (0.5 + atan((x - 1500000) / 80000::DOUBLE) / pi()) + 2e-6 * x + 0.25"


@query(f"WITH {EVENTS} SELECT gid, idx, round({BASE}, 6) + 0.0 baseline, round(y - ({BASE}), 6) + 0.0 peaks FROM c")
def baseline_peaks(spark, sf):
    return out(views.baseline_peaks(curves.event_curves(spark, sf), 1.5, 1.5e6, 8e4, 2e-6, 0.25), ["gid", "idx"], "baseline", "peaks")


@query("SELECT o_orderkey, round(1 + 2 * (3.0 - 1.0) * (3 + o_totalprice % 12 - 3) / pi(), 6) n_idp, round(1 + 2 * 1.2 * (o_totalprice % 12) / pi(), 6) n_bkg FROM orders")
def n_idp(spark, sf):
    k = F.col("o_totalprice") % 12
    n = lambda lo, hi: ag.number_independent(lo, hi, F.lit(3.0), 3 + k)
    return out(table(spark, sf, "orders").select("o_orderkey", n(1.0, 3.0).alias("n_idp"), ag.number_independent(0.0, 1.2, F.lit(0.0), k).alias("n_bkg")), ["o_orderkey"], "n_idp", "n_bkg")


@query("SELECT o_orderkey, round((o_totalprice * 1e-6) / (2 * sqrt(pi() * 5 / (0.05 * (power(12.0, 5) - power(3.0, 5))))), 6) eps_r FROM orders")
def epsilon_r(spark, sf):
    return out(table(spark, sf, "orders").select("o_orderkey", views.epsilon_r(F.col("o_totalprice") * 1e-6, 2, 3.0, 12.0, 0.05).alias("eps_r")), ["o_orderkey"], "eps_r")


@query(f"WITH {SHIFTED}, {RANGE}, g AS (SELECT x g FROM c, r WHERE gid = (SELECT min(gid) FROM c) AND x BETWEEN lo AND hi), {INTERP} SELECT round(g, 6) x, round(avg(y), 6) + 0.0 y, count(*) n FROM v GROUP BY g")
def average_on_first(spark, sf):
    return out(views.average_on_first(shifted(spark, sf)), ["n"], "x", "y")


@query(f"WITH {SHIFTED}, {RANGE}, g AS (SELECT lo + (hi - lo) * i / 20 g FROM r, generate_series(0, 20) t(i)), {INTERP} SELECT gid, round(g, 6) x, round(y, 6) + 0.0 y FROM v")
def resample_matrix(spark, sf):
    return out(views.common_matrix(shifted(spark, sf), 21), ["gid"], "x", "y")


@query(f"WITH {EVENTS} SELECT gid, row_number() OVER (PARTITION BY gid ORDER BY idx) - 1 idx, round(x, 6) x, round(y, 6) + 0.0 y FROM c WHERE NOT x BETWEEN 500000 AND 900000")
def remove_segment(spark, sf):
    return out(views.remove_segment(curves.event_curves(spark, sf), 5e5, 9e5), ["gid", "idx"], "x", "y")


@query(f"""WITH {EVENTS}, i AS (SELECT * FROM c WHERE x BETWEEN 200000 AND 2000000), k AS (SELECT gid, max(y) / 2 half, min({{y: -y, i: idx}}).i last FROM i GROUP BY gid),
s AS (SELECT gid, idx, x, y, half, lag(x) OVER w x0, lag(y) OVER w y0 FROM i JOIN k USING (gid) WHERE idx <= last {W})
SELECT gid, round(min({{i: idx, a: CASE WHEN y = y0 THEN x0 ELSE x0 + (half - y0) * (x - x0) / (y - y0) END}}).a, 6) x_at FROM s WHERE y0 <= half AND half <= y GROUP BY gid""")
def half_max_rising(spark, sf):
    return out(views.half_max_rising(curves.event_curves(spark, sf), 2e5, 2e6), ["gid"], "x_at")


@query("WITH n AS (SELECT DISTINCT user_id gid FROM events) SELECT gid, row_number() OVER (ORDER BY gid) - 1 ordinal FROM n")
def ordinal(spark, sf):
    return grids.ordinal(curves.event_curves(spark, sf))


@query("SELECT c_custkey FROM customer WHERE CASE WHEN (SELECT bool_or(c_acctbal > 9000) FROM customer) THEN c_acctbal > 9000 ELSE c_custkey = 1 END")
def checked_target(spark, sf):
    return views.run_target(table(spark, sf, "customer"), F.col("c_acctbal") > 9000, F.col("c_custkey") == 1).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE CASE WHEN (SELECT bool_or(c_acctbal > 1e9) FROM customer) THEN c_acctbal > 1e9 ELSE c_custkey = 1 END")
def current_target(spark, sf):
    return views.run_target(table(spark, sf, "customer"), F.col("c_acctbal") > 1e9, F.col("c_custkey") == 1).select("c_custkey")


@query(f"WITH {VECTORS}, m AS (SELECT *, count(CASE WHEN y > 0.3 THEN 1 END) OVER (PARTITION BY gid) lost FROM c) SELECT gid, idx, round(y, 6) + 0.0 y, CASE WHEN lost = 0 THEN round(y * 2, 6) + 0.0 END norm FROM m WHERE NOT y > 0.3")
def mask_derived(spark, sf):
    df = curves.vector_curves(spark, sf).withColumn("norm", F.col("y") * 2)
    return out(views.mask_columns(df, ~(F.col("y") > 0.3), ["norm"]), ["gid", "idx"], "y", "norm")


@query(f"""WITH {EVENTS}, b AS (SELECT *, {' + '.join(f'CASE WHEN x >= {(a + b) / 2} THEN 1 ELSE 0 END' for a, b in zip(CENTERS[:-1], CENTERS[1:]))} bin FROM c)
SELECT gid, round({CENTERS}[bin + 1]::DOUBLE, 6) x, round(avg(y), 6) + 0.0 y, round(stddev_pop(y), 6) + 0.0 dy, count(*) n FROM b GROUP BY gid, bin""")
def rebin_halfway(spark, sf):
    return out(views.rebin_to(curves.event_curves(spark, sf), CENTERS), ["gid", "n"], "x", "y", "dy")


@query(f"""WITH {VECTORS}, a AS (SELECT gid, list(y ORDER BY idx) y FROM c GROUP BY gid),
e AS (SELECT gid, list_concat([y[1] - abs(y[3] - y[1]), y[1] - abs(y[2] - y[1])], y, [y[64] + abs(y[63] - y[64]), y[64] + abs(y[62] - y[64])]) z FROM a)
SELECT gid, i idx, round(z[i + 1] * {WEIGHTS[0]!r}::DOUBLE + z[i + 2] * {WEIGHTS[1]!r}::DOUBLE + z[i + 3] * {WEIGHTS[2]!r}::DOUBLE + z[i + 4] * {WEIGHTS[3]!r}::DOUBLE + z[i + 5] * {WEIGHTS[4]!r}::DOUBLE, 6) + 0.0 ys FROM e, generate_series(0, 63) g(i)""")
def savitzky_golay_ends(spark, sf):
    return out(views.savitzky_golay(curves.vector_curves(spark, sf), WEIGHTS), ["gid", "idx"], "ys")


@query(f"WITH {EVENTS} SELECT gid, idx, round(y / sum(y) OVER (PARTITION BY gid), 6) + 0.0 w FROM c")
def normalised_weights(spark, sf):
    return out(views.normalised_weights(curves.event_curves(spark, sf)), ["gid", "idx"], "w")


GRADIENT = "CASE WHEN lag({y}) OVER w IS NULL THEN lead({y}) OVER w - {y} WHEN lead({y}) OVER w IS NULL THEN {y} - lag({y}) OVER w ELSE (lead({y}) OVER w - lag({y}) OVER w) / 2 END"


def dmu(y: str) -> str:
    return f"({GRADIENT.format(y=y)}) / ({GRADIENT.format(y='x')})"


@query(f"""WITH {VECTORS}, d AS (SELECT *, {dmu('y')} d FROM c {W}), e AS (SELECT *, {dmu('d')} s FROM d {W}),
v AS (SELECT gid, idx, x, unnest(['mu', 'k2chi', 'magnitude', 'derivative', 'second']) view, unnest([y, y * x * x, abs(y), d, s]) y FROM e)
SELECT view, gid, idx, round(x, 6) x, round(y, 6) + 0.0 y FROM v""")
def graph_views(spark, sf):
    return out(views.graph_views(curves.vector_curves(spark, sf)), ["view", "gid", "idx"], "x", "y")


@query("""WITH q AS (SELECT vec_id gid, i idx, embedding[i + 1]::DOUBLE dr, embedding[i + 17]::DOUBLE di, embedding[i + 33]::DOUBLE mr, embedding[i + 49]::DOUBLE mi FROM embeddings, generate_series(0, 15) g(i)),
v AS (SELECT gid, idx, unnest(['data', 'data', 'data', 'data', 'model', 'model', 'model', 'model']) series, unnest(['mag', 're', 'im', 'phase', 'mag', 're', 'im', 'phase']) part,
unnest([sqrt(dr * dr + di * di), dr, di, atan2(di, dr), sqrt(mr * mr + mi * mi), mr, mi, atan2(mi, mr)]) value FROM q)
SELECT gid, idx, series, part, round(value, 6) + 0.0 value FROM v""")
def fit_series(spark, sf):
    cut = [F.slice("embedding", 16 * i + 1, 16).alias(n) for i, n in enumerate(("data_re", "data_im", "model_re", "model_im"))]
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gid"), F.posexplode(F.arrays_zip(*cut)).alias("idx", "v"))
    rows = rows.select("gid", "idx", *(F.col(f"v.{n}").cast("double").alias(n) for n in ("data_re", "data_im", "model_re", "model_im")))
    return out(views.fit_series(rows), ["gid", "idx", "series", "part"], "value")


FRACTIONS = "SELECT p_partkey, p_size % 3 el, (p_retailprice * 0.37) % 5 fx, (p_size * 0.25) % 2 fy, (p_partkey * 0.125) % 3 fz FROM part"


@query(f"SELECT p_partkey, el = 1 AND abs(fx - 0.5 - round(fx - 0.5)) <= 0.05 AND abs(fy - 0.25 - round(fy - 0.25)) <= 0.05 AND abs(fz - 0.125 - round(fz - 0.125)) <= 0.05 image FROM ({FRACTIONS})")
def absorber_image(spark, sf):
    at = [F.col("p_retailprice") * 0.37 % 5, F.col("p_size") * 0.25 % 2, F.col("p_partkey") * 0.125 % 3]
    near = views.image_of(F.col("p_size") % 3, at, F.lit(1), [F.lit(0.5), F.lit(0.25), F.lit(0.125)], 0.05)
    return table(spark, sf, "part").select("p_partkey", near.alias("image"))


@query("""WITH s AS (SELECT p_size element, (p_partkey % 8) * 0.125::DOUBLE fx, (p_partkey % 3) * 0.25::DOUBLE fy, (p_size % 5) * 0.2::DOUBLE fz FROM part),
o(sx, sy, sz, t) AS (VALUES (1, 1, 1, 0.0::DOUBLE), (-1, -1, 1, 0.0::DOUBLE), (1, 1, 1, 0.5::DOUBLE)),
i AS (SELECT element, sx * fx + t fx, sy * fy + t fy, sz * fz + t fz FROM s, o),
w AS (SELECT element, fx - floor(fx) fx, fy - floor(fy) fy, fz - floor(fz) fz FROM i)
SELECT DISTINCT element, round(CASE WHEN round(fx, 4) >= 1 THEN 0 ELSE fx END, 4) + 0.0 fx, round(CASE WHEN round(fy, 4) >= 1 THEN 0 ELSE fy END, 4) + 0.0 fy, round(CASE WHEN round(fz, 4) >= 1 THEN 0 ELSE fz END, 4) + 0.0 fz FROM w""")
def symmetry_sites(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    sites = table(spark, sf, "part").select(s.alias("element"), (k % 8 * 0.125).alias("fx"), (k % 3 * 0.25).alias("fy"), (s % 5 * 0.2).alias("fz"))
    one = lambda a, b, c, t: ([a, 0.0, 0.0, 0.0, b, 0.0, 0.0, 0.0, c], [t, t, t])
    ops = spark.createDataFrame([one(1.0, 1.0, 1.0, 0.0), one(-1.0, -1.0, 1.0, 0.0), one(1.0, 1.0, 1.0, 0.5)], "rotation array<double>, shift array<double>")
    rows = lattice.expand(sites, ops)
    return rows.select("element", *((F.round(c, 4) + 0.0).alias(c) for c in ("fx", "fy", "fz")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END::BIGINT AS place FROM customer")
def label_lookup(spark, sf):
    labels, names = F.array(*map(F.lit, ("Energy", "I0", "muTrans"))), F.array(*map(F.lit, ("ENERGY", "i0", "mutrans", "none")))
    return table(spark, sf, "customer").select("c_custkey", views.label_index(labels, F.get(names, (F.col("c_custkey") % 4).cast("int"))).alias("place"))


def _curves_of_users(spark, sf):
    return curves.wide(curves.event_curves(spark, sf))


@query(f"WITH {EVENTS} SELECT gid, idx, round(x, 6) x, round(y, 6) + 0.0 y FROM c")
def xmu_round_trip(spark, sf):
    files = _curves_of_users(spark, sf).select("gid", views.xmu_text(F.col("gid").cast("string"), F.col("x"), F.col("y")).alias("content"))
    rows = files.select("gid", F.posexplode(views.data_rows(F.col("content"))).alias("idx", "v"))
    return out(rows.select("gid", "idx", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y")), ["gid", "idx"], "x", "y")


@query("SELECT vec_id gid, ['x-axis: k', 'y-axis: chi', 'curve 1: a', 'curve 2: b'] head, 64::INT n, round(embedding[1]::DOUBLE, 6) + 0.0 y_first, round(embedding[64]::DOUBLE * 2, 6) + 0.0 y_last FROM embeddings")
def blocks_round_trip(spark, sf):
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gid"), F.transform("embedding", lambda v: v.cast("double")).alias("y"))
    x = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i * F.lit(0.05))
    ys = F.array(F.slice("y", 1, 32), F.transform(F.slice("y", 33, 32), lambda v: v * 2))
    files = df.select("gid", views.blocks_text(F.lit("k"), F.lit("chi"), F.array(F.lit("a"), F.lit("b")), F.array(x, x), ys).alias("content"))
    rows = files.select("gid", views.header_lines(F.col("content")).alias("head"), views.data_rows(F.col("content")).alias("v"))
    rows = rows.select("gid", "head", F.size("v").alias("n"), F.get(F.get("v", F.lit(0)), F.lit(1)).alias("y_first"), F.get(F.get("v", F.lit(63)), F.lit(1)).alias("y_last"))
    return out(rows, ["gid", "head", "n"], "y_first", "y_last")


def _bessel(x: str) -> str:
    return f"list_sum(list_transform(range(0, 20), lambda k: power(({x}) * ({x}) / 4, k) / power(factorial(k::INT)::DOUBLE, 2)))"


def _window(kind: str):
    c = fw.shape(WINDOW_GRID, kind, 3.0, 10.0, 2.0)
    u = f"2 * (x - {c.middle!r}::DOUBLE) / {c.down.hi - c.up.lo!r}::DOUBLE"
    bell, top = _bessel(f"{c.width!r} * sqrt(greatest(0, 1 - ({u}) * ({u})))"), fw._i0(c.width)
    value = f"({bell} - 1) / {top - 1!r}::DOUBLE" if kind == "kaiser" else f"CASE WHEN x <= {c.up.lo!r} OR x >= {c.down.hi!r} THEN 0 ELSE {bell} / {top!r}::DOUBLE END"
    sql = f"WITH {VECTORS} SELECT gid, i idx, round(y * ({value}), 6) + 0.0 w FROM {WINDOWED}"

    def run(spark, sf):
        rows = curves.vector_curves(spark, sf).withColumn("x", F.col("idx") * F.lit(0.2))
        return out(rows.select("gid", "idx", (F.col("y") * fw.weight(F.col("idx"), F.col("x"), kind, c)).alias("w")), ["gid", "idx"], "w")

    run.__name__ = f"window_{kind}"
    return query(sql)(run)


for _kind in ("kaiser", "bes"):
    _window(_kind)


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 idx, l_orderkey % 4 k FROM lineitem)
SELECT l_orderkey file, idx, round(l_extendedprice, 6) + 0.0 energy, round(CASE k WHEN 0 THEN ln(l_quantity / (l_discount + 1)) WHEN 1 THEN l_tax + 1 ELSE (l_discount + 1 + l_tax + 1) / l_quantity END, 6) + 0.0 mu, NULL error FROM m WHERE k < 3
UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, NULL, 'BadColumn(9)' FROM m WHERE k = 3""")
def build_mu(spark, sf):
    """Orders as column files (energy, i0 and two signals, a row per line), each quarter of them in another mode, the last one with a column that is not there."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("c0"), F.col("l_quantity").alias("c1"), (F.col("l_discount") + 1).alias("c2"), (F.col("l_tax") + 1).alias("c3"))
    files = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    files = files.select(F.concat(F.lit("/in/"), F.col("l_orderkey").cast("string"), F.lit(".dat")).alias("path"), (F.col("l_orderkey") % 4).alias("k"), F.array(*(F.col(f"l.c{i}").cast("array<double>") for i in range(4))).alias("columns"), F.lit(None).cast("string").alias("error"))
    specs = [("transmission", {"energy": 0, "i0": 1, "it": 2}), ("raw", {"energy": 0, "mu": 3}), ("fluorescence", {"energy": 0, "i0": 1, "channels": (2, 3)}), ("raw", {"energy": 0, "mu": 9})]
    done = [spectra.build_mu(files.where(F.col("k") == k), mode, **spec) for k, (mode, spec) in enumerate(specs)]
    rows = done[0].union(done[1]).union(done[2]).union(done[3])
    rows = rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("file"), F.posexplode_outer(F.arrays_zip("energy", "mu")).alias("idx", "p"), "error")
    return out(rows.select("file", F.col("idx").cast("long").alias("idx"), "p.energy", "p.mu", "error"), ["file", "idx", "error"], "energy", "mu")


@query(f"""WITH {VECTORS}, l AS (SELECT list_sort(list(DISTINCT gid)) ids FROM c)
SELECT -1 line, 'x' || chr(9) || array_to_string(list_transform(ids, lambda i: 'v' || i), chr(9)) || chr(9) "text" FROM l
UNION ALL SELECT idx, printf('%.6f', any_value(x)) || chr(9) || string_agg(printf('%.6f', y), chr(9) ORDER BY gid) FROM c GROUP BY idx""")
def wide_lines(spark, sf):
    """All vectors side by side over their common grid, as the lines of a text table."""
    return views.wide_lines(curves.vector_curves(spark, sf).withColumn("label", F.concat(F.lit("v"), F.col("gid").cast("string"))))


@query(f"""WITH {EVENTS}, l AS (SELECT list_sort(list(DISTINCT gid)) ids, max(idx) top FROM c),
n AS (SELECT i gid, t.idx FROM (SELECT unnest(ids) i FROM l), (SELECT unnest(generate_series(0, top)) idx FROM l) t)
SELECT -1 line, array_to_string(list_transform(ids, lambda i: 'u' || i || '_x' || chr(9) || 'u' || i), chr(9)) || chr(9) "text" FROM l
UNION ALL SELECT n.idx, string_agg(coalesce(printf('%.6f', x), '') || chr(9) || coalesce(printf('%.6f', y), ''), chr(9) ORDER BY n.gid) FROM n LEFT JOIN c ON c.gid = n.gid AND c.idx = n.idx GROUP BY n.idx""")
def wide_lines_pairs(spark, sf):
    """All event curves side by side, each with its own x, as the lines of a text table."""
    return views.wide_lines(curves.event_curves(spark, sf).withColumn("label", F.concat(F.lit("u"), F.col("gid").cast("string"))))
