"""Queries over path geometry, constraint sets, recurrences and symmetry images, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelight import curves
from edgelight.functions.displacement import sigma2_debye as debye
from edgelight.operators import lattice, ordered, param_sets
from edgelight.plans.native_queries import VECTORS, out

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""WITH p AS (SELECT p_partkey, 1.8 + p_size * 0.045 r, 150 + p_retailprice / 10 theta, 50 + (p_partkey % 300)::DOUBLE t, 27.0 + p_size ma, 63.546 mb FROM part),
n AS (SELECT *, theta / t tx, 4.5693349700844 * r / 2.63 rx FROM p),
f AS (SELECT p_partkey, ma, mb, theta, CASE WHEN i % 1000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3000::DOUBLE s, i / 1000::DOUBLE w, tx, rx FROM n, generate_series(0, 1000) g(i)),
v AS (SELECT p_partkey, ma, mb, theta, s, CASE WHEN w = 0 THEN 2 / tx ELSE w / tanh(w * tx / 2) END h, CASE WHEN w = 0 THEN 1 ELSE sin(w * rx) / (w * rx) END q FROM f),
c AS (SELECT p_partkey, sum(s * h) / any_value(theta) * 72.7630804732553 own, sum(s * h * q) / any_value(theta) * 72.7630804732553 cross, any_value(ma) ma, any_value(mb) mb FROM v GROUP BY p_partkey)
SELECT p_partkey, round(own / ma + own / mb - 2 * "cross" / sqrt(ma * mb), 6) + 0.0 sigma2 FROM c""".replace(" cross,", ' "cross",'))
def sigma2_debye(spark, sf):
    """Displacement of a path from one atom to another and back, for atoms at distances and temperatures from the parts table."""
    r = F.lit(1.8) + F.col("p_size") * F.lit(0.045)

    def atom(*at, mass):
        return F.struct(*(v.cast("double").alias(n) for v, n in zip(at, "xyz")), mass.cast("double").alias("mass"))

    geom = F.array(atom(F.lit(0.0), F.lit(0.0), F.lit(0.0), mass=27.0 + F.col("p_size")), atom(r * 0.6, F.lit(0.0), r * 0.8, mass=F.lit(63.546)))
    value = debye(50 + (F.col("p_partkey") % 300).cast("double"), 150 + F.col("p_retailprice") / 10, F.lit(2.63), geom)
    return out(table(spark, sf, "part").select("p_partkey", value.alias("sigma2")), ["p_partkey"], "sigma2")


@query(f"""WITH RECURSIVE {VECTORS}, r AS (SELECT gid, idx, 0.2 * y z, 0::DOUBLE z1, y y1 FROM c WHERE idx = 0
UNION ALL SELECT c.gid, c.idx, 0.2 * c.y + 0.3 * r.y1 + 0.5 * r.z - 0.25 * r.z1, r.z, c.y FROM r JOIN c ON c.gid = r.gid AND c.idx = r.idx + 1)
SELECT gid, idx, round(z, 6) + 0.0 z FROM r""")
def recursive_filter(spark, sf):
    """A second-order recursive filter along every vector."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gid"), F.transform("embedding", lambda v: v.cast("double")).alias("y"))
    done = ordered.iir(rows, [0.4, 0.6], [2.0, -1.0, 0.5])
    return out(done.select("gid", F.posexplode("z").alias("idx", "z")), ["gid", "idx"], "z")


RULES = """p AS (SELECT p_partkey set_id, p_size FROM part),
e AS (SELECT set_id, 'v1' "name", CASE WHEN p_size % 2 = 1 THEN 'v2 + 1' ELSE '2 * x' END "expr" FROM p
UNION ALL SELECT set_id, 'v2', 'v3 * v4' FROM p
UNION ALL SELECT set_id, 'v3', CASE WHEN p_size % 5 = 0 THEN 'v1 / 2' ELSE 'x' END FROM p
UNION ALL SELECT set_id, 'v4', 'x + 1' FROM p
UNION ALL SELECT set_id, 'v5', 'v1 - v3' FROM p)"""


def rules(spark, sf):
    size, rule = F.col("p_size"), lambda n, e: F.struct(F.lit(n).alias("name"), e.alias("expr"))
    made = F.array(
        rule("v1", F.when(size % 2 == 1, "v2 + 1").otherwise("2 * x")),
        rule("v2", F.lit("v3 * v4")),
        rule("v3", F.when(size % 5 == 0, "v1 / 2").otherwise("x")),
        rule("v4", F.lit("x + 1")),
        rule("v5", F.lit("v1 - v3")),
        rule("x", F.lit(None).cast("string")),
    )
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("set_id"), (size / 4).alias("start"), F.posexplode(made).alias("pos", "r"))
    none = F.lit(None).cast("double")
    return rows.select("set_id", "pos", "r.name", F.when(F.col("r.expr").isNull(), "vary").otherwise("expr").alias("kind"), F.when(F.col("r.expr").isNull(), F.col("start")).alias("value"), none.alias("min"), none.alias("max"), "r.expr")


@query(f"""WITH RECURSIVE {RULES}, u AS (SELECT a.set_id, a."name" a, b."name" b FROM e a JOIN e b ON a.set_id = b.set_id AND list_contains(regexp_extract_all(a."expr", '[a-z][a-z0-9]*'), b."name")),
r AS (SELECT set_id, "name" n, 1 l FROM e UNION ALL SELECT u.set_id, u.a, l + 1 FROM r JOIN u ON u.set_id = r.set_id AND u.b = r.n WHERE l < 6),
d AS (SELECT set_id, n, max(l) l FROM r GROUP BY ALL),
t AS (SELECT set_id, a, b FROM u UNION SELECT t.set_id, t.a, u.b FROM t JOIN u ON u.set_id = t.set_id AND u.a = t.b),
c AS (SELECT DISTINCT set_id, a FROM t WHERE a = b)
SELECT d.set_id, n "name", CASE WHEN l < 6 THEN l::INT END "level", CASE WHEN l < 6 THEN 'ok' WHEN c.a IS NULL THEN 'after' ELSE 'cycle' END status FROM d LEFT JOIN c ON c.set_id = d.set_id AND c.a = d.n""")
def constraint_order(spark, sf):
    """The order of five constraints for every part, with cycles in some."""
    return param_sets.order(rules(spark, sf))


@query("""WITH p AS (SELECT p_partkey set_id, p_size / 4::DOUBLE x, p_size % 2 = 1 odd, p_size % 5 = 0 five FROM part), g AS (SELECT * FROM p WHERE NOT (odd AND five)),
a AS (SELECT *, CASE WHEN odd THEN x * (x + 1) + 1 ELSE 2 * x END v1 FROM g), b AS (SELECT *, CASE WHEN five THEN v1 / 2 ELSE x END v3 FROM a)
SELECT set_id, unnest(['x', 'v1', 'v2', 'v3', 'v4', 'v5']) "name", round(unnest([x, v1, v3 * (x + 1), v3, x + 1, v1 - v3]), 6) + 0.0 "value", 'ok' status FROM b
UNION ALL SELECT set_id, NULL, NULL, 'failed' FROM p WHERE odd AND five""")
def constraint_values(spark, sf):
    found = param_sets.resolve(rules(spark, sf))
    return found.select("set_id", "name", (F.round("value", 6) + 0.0).alias("value"), "status")


#: Sites on both sides of a rounding border, far closer to each other than the tolerance
NEAR = "SELECT p_partkey site_id, p_size element, (p_partkey % 8) * 0.125::DOUBLE + (p_partkey % 2) * 0.000001::DOUBLE + 0.00005 fx, (p_partkey % 3) * 0.25::DOUBLE fy, (p_size % 5) * 0.2::DOUBLE fz FROM part"


@query(f"""WITH RECURSIVE s AS ({NEAR}), o(op, sx, t) AS (VALUES (0, 1, 0.0::DOUBLE), (1, -1, 0.0::DOUBLE), (2, 1, 0.5::DOUBLE)),
i AS (SELECT element, site_id, op, sx * fx + t fx, sx * fy + t fy, fz + t fz FROM s, o),
w AS (SELECT element, fx - floor(fx) fx, fy - floor(fy) fy, fz - floor(fz) fz, row_number() OVER (PARTITION BY element ORDER BY site_id, op) n FROM i),
k AS (SELECT element, 1::BIGINT n, [{{x: fx, y: fy, z: fz}}] kept FROM w WHERE n = 1
UNION ALL SELECT w.element, w.n, CASE WHEN len(list_filter(kept, lambda q: abs(q.x - fx - round(q.x - fx)) < 1e-4 AND abs(q.y - fy - round(q.y - fy)) < 1e-4 AND abs(q.z - fz - round(q.z - fz)) < 1e-4)) = 0
  THEN list_append(kept, {{x: fx, y: fy, z: fz}}) ELSE kept END FROM k JOIN w ON w.element = k.element AND w.n = k.n + 1),
z AS (SELECT element, unnest(arg_max(kept, n)) q FROM k GROUP BY element)
SELECT element, round(q.x, 5) + 0.0 fx, round(q.y, 5) + 0.0 fy, round(q.z, 5) + 0.0 fz FROM z""")
def symmetry_within(spark, sf):
    """Images of sites without those within a tolerance of an earlier one."""
    k, s = F.col("p_partkey"), F.col("p_size")
    sites = table(spark, sf, "part").select(k.alias("site_id"), s.alias("element"), (k % 8 * 0.125 + k % 2 * 0.000001 + 0.00005).alias("fx"), (k % 3 * 0.25).alias("fy"), (s % 5 * 0.2).alias("fz"))
    one = lambda i, a, t: (i, [a, 0.0, 0.0, 0.0, a, 0.0, 0.0, 0.0, 1.0], [t, t, t])
    ops = spark.createDataFrame([one(0, 1.0, 0.0), one(1, -1.0, 0.0), one(2, 1.0, 0.5)], "op int, rotation array<double>, shift array<double>")
    rows = lattice.expand_within(sites, ops)
    return rows.select("element", *((F.round(c, 5) + 0.0).alias(c) for c in ("fx", "fy", "fz")))
